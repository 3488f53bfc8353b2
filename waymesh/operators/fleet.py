"""Trackers in step: those whose rows a task holds go through their frames side by side, with the tracks of all in the same arrays.

A frame of one tracker is a few rows, so that a tracker alone spends its time on calls, not on
numbers. Here a call serves the same batch of the same frame, counted from its first, of as many
trackers as are held. The rows are those of tracking.Tracker, tracker after tracker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from waymesh.functions.geometry import gated_of, iou_of, least_overlap
from waymesh.operators import tracking as T

#: Rows that a task holds, and pairs of a track and a detection that are looked at, at a time.
HELD, PAIRS = 1 << 18, 1 << 20


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    return np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))


class Fleet:
    """Live tracks of many trackers. `owner` is the tracker of a track, as its place among those held; the tracks of one tracker stand in order of birth."""

    STATE = ("owner", "ids", "boxes", "x", "p", "steps", "seen", "updated", "gates")

    def __init__(self, cleanup: float, compat: bool, mode: int, distance: str) -> None:
        if distance not in ("iou", "gated_euclidean"):
            raise ValueError(f"unknown distance {distance!r}")
        self.rules, self.cleanup, self.compat, self.mode, self.distance = T.Tracker(0, cleanup, compat, mode, distance), cleanup, compat, mode, distance
        self.key, self.open, self.open_id = None, None, 0  # the tracker whose rows may go on, its tracks and its next number
        self._clear()

    def _clear(self) -> None:
        n, whole = T.SIZE[self.mode], np.zeros(0, np.int64)
        self.owner, self.ids, self.steps = whole, whole, whole
        self.boxes, self.x, self.p, self.gates = np.zeros((0, 3)), np.zeros((0, n)), np.zeros((0, n, n)), np.zeros((0, 5))
        self.seen = self.updated = np.zeros(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []  # tracks and the rows that they took, batch by batch

    def _keep(self, kept: np.ndarray) -> None:
        place = np.cumsum(kept) - 1
        for name in self.STATE:
            setattr(self, name, getattr(self, name)[kept])
        self.waiting = [(place[i[kept[i]]], r[kept[i]]) for i, r in self.waiting]

    def run(self, run: np.ndarray, number: np.ndarray, frame: np.ndarray, t: np.ndarray, values: np.ndarray, members: bool = False) -> Iterator[list[np.ndarray]]:
        """Whole frames in order of run, number, frame, batch and row; the last tracker may go on in the next call. Columns of tracks, and of their members, frame by frame."""
        batch = np.nan_to_num(values[:, 9], nan=-1)
        starts = [_changes(run, number), _changes(run, number, frame), _changes(run, number, frame, batch)]
        self.group, of_frame, of_batch = (np.cumsum(s) - 1 for s in starts)
        first, frames = np.flatnonzero(starts[0]), np.flatnonzero(starts[1])
        step, turn = of_frame - of_frame[first][self.group], of_batch - of_batch[frames][of_frame]
        self.values, self.number, n = values, number[first].astype(np.int64), len(first)
        self.next_id, length = np.zeros(n, np.int64), np.bincount(self.group[frames], minlength=n)
        self._clear()
        if self.open is not None and self.key == (run[0], number[0]):
            for name, column in self.open.items():
                setattr(self, name, column)
            self.next_id[0] = self.open_id
        by_step = np.argsort(step[frames], kind="stable")
        firsts = np.split(frames[by_step], np.flatnonzero(np.diff(step[frames][by_step])) + 1)  # of each step, the first row of every tracker's frame
        order = np.lexsort((self.group, turn, step))
        edges = [*np.flatnonzero(_changes(step[order], turn[order])).tolist(), len(order)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            k, rows = int(step[order[a]]), order[a:b]
            if turn[rows[0]] == 0:
                here = self.group[firsts[k]]
                self.now = np.full(n, np.nan)
                self.now[here] = t[firsts[k]]
                self.gates = self._gates(slice(None))
            self._observe(rows)
            if b < len(order) and step[order[b]] == k:
                continue
            at = np.zeros(n, np.int64)
            at[here] = firsts[k]
            yield from self._fused(members, run, frame, at)
            over = here[length[here] == k + 1]
            if over.size:
                if over[-1] == n - 1:
                    last = self.owner == n - 1
                    self.key, self.open_id = (run[-1], number[-1]), int(self.next_id[-1])
                    self.open = {name: getattr(self, name)[last] for name in self.STATE}
                    self.open["owner"] = np.zeros(int(last.sum()), np.int64)
                self._keep(~np.isin(self.owner, over))

    def _gates(self, at: slice) -> np.ndarray:
        now = self.now[self.owner[at]]
        return self.rules.predicted(now - self.updated[at], self.x[at], self.p[at], self.boxes[at])

    def _observe(self, rows: np.ndarray) -> None:
        """The next batch of the trackers that have one."""
        present = np.zeros(len(self.number), bool)
        present[self.group[rows]] = True
        rows = rows[~np.isnan(self.values[rows, 0])]
        if rows.size:
            new = np.ones(rows.size, bool)
            if self.owner.size:
                i, j, known = self._matches(*self._near(rows))
                self.waiting.append((i, rows[j]))
                self.seen[i] = self.now[self.owner[i]]
                new[known] = False
            self._born(rows[new])
        keep = ~present[self.owner] | (self.seen > self.now[self.owner] - self.cleanup)
        if not keep.all():
            self._keep(keep)

    def _near(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tracks and detections (as places in rows) of one tracker that are below the gate, with their distances."""
        dets, group = self.values[rows, :5], self.group[rows]
        wide, reach = np.hypot(self.gates[:, 2], self.gates[:, 3]), np.hypot(dets[:, 2], dets[:, 3])
        if self.distance == "iou":
            by_owner, low, high = self._abreast(dets, group, wide, reach)
        else:
            by_owner = np.argsort(self.owner, kind="stable")
            low, high = (np.searchsorted(self.owner[by_owner], group, side) for side in ("left", "right"))
        count = high - low
        total = np.cumsum(count)
        parts, a = [], 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(total, total[a] - count[a] + PAIRS, "right")))
            n = count[a:b]
            j = np.repeat(np.arange(a, b), n)
            i = by_owner[np.arange(len(j)) + np.repeat(low[a:b] - (np.cumsum(n) - n), n)]
            near = np.hypot(self.gates[i, 0] - dets[j, 0], self.gates[i, 1] - dets[j, 1]) <= (wide[i] + reach[j]) / 2
            i, j = i[near], j[near]
            if self.distance == "gated_euclidean":
                d = gated_of(self.gates[i], dets[j])
            else:
                can = least_overlap(self.gates[i], dets[j], 1 - T.GATE)
                i, j = i[can], j[can]
                overlap = iou_of(self.gates[i], dets[j])
                d = np.where(overlap <= 0, 1, 1 - overlap)
            below = d < T.GATE
            parts.append((i[below], j[below], d[below]))
            a = b
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def _abreast(self, dets: np.ndarray, group: np.ndarray, wide: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tracks in order of tracker and x, and of each detection where those begin and end whose circles can meet its own. Gates whose area is too far from that of every detection are left out."""
        size, own = self.gates[:, 2] * self.gates[:, 3], dets[:, 2] * dets[:, 3]
        least = (1 - T.GATE) * (1 - 1e-9)
        able = np.flatnonzero((size > own.min() * least) & (size * least < own.max()) & np.isfinite(self.gates).all(axis=1))
        if not able.size:
            return able, *np.zeros((2, len(dets)), np.int64)
        x = self.gates[able, 0]
        middle, bound = x.min(), (wide[able].max() + reach) / 2
        span = 2 * (x.max() - middle + bound.max() + 1)  # trackers stand so far from each other on one line
        place = self.owner[able] * span + (x - middle)
        order = np.argsort(place, kind="stable")
        slack = bound + 1e-6 + 1e-12 * span * len(self.number)
        at = np.clip(dets[:, 0] - middle, -span / 4, span * 3 / 4)
        low, high = np.searchsorted(place[order], group * span + at - slack), np.searchsorted(place[order], group * span + at + slack, "right")
        return able[order], low, np.maximum(low, high)

    def _matches(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matched tracks and detections, and the detections that start no track. Pairs that are the only ones of both sides match; others are dealt with in order."""
        known = np.unique(j)
        if not i.size:
            return i, j, known
        alone = (np.bincount(i)[i] == 1) & (np.bincount(j)[j] == 1)
        rest = ~alone
        if not rest.any():
            return i, j, known
        pairs = (T.claimed if self.compat else T.one_to_one)(i[rest], j[rest], d[rest])
        more = np.array(pairs, np.int64).reshape(-1, 2)
        return np.concatenate((i[alone], more[:, 0])), np.concatenate((j[alone], more[:, 1])), known

    def _born(self, rows: np.ndarray) -> None:
        n = len(rows)
        if not n:
            return
        owner, dets, size = self.group[rows], self.values[rows], T.SIZE[self.mode]
        count, start = np.bincount(owner, minlength=len(self.number)), np.flatnonzero(_changes(owner))
        rank = np.arange(n) - np.repeat(start, np.diff([*start, n]))
        ids = T.IDS * self.number[owner] + (self.next_id[owner] + rank) % (T.IDS + 1)
        self.next_id = (self.next_id + count) % (T.IDS + 1)
        x, p = np.zeros((n, size)), np.zeros((n, size, size))
        p[:, 0, 0] = p[:, 1, 1] = 1
        if not self.compat:
            x[:, :2] = dets[:, :2]
            p[:, :2, :2] = dets[:, [5, 6, 6, 7]].reshape(-1, 2, 2)
        old = len(self.owner)
        now = self.now[owner]
        for name, column in (("owner", owner), ("ids", ids), ("boxes", dets[:, 2:5]), ("x", x), ("p", p), ("steps", np.zeros(n, np.int64)), ("seen", now), ("updated", now)):
            setattr(self, name, np.concatenate((getattr(self, name), column)))
        self.gates = np.concatenate((self.gates, self._gates(slice(old, None))))
        self.waiting.append((np.arange(old, old + n), rows))

    def _fused(self, members: bool, run: np.ndarray, frame: np.ndarray, at: np.ndarray) -> Iterator[list[np.ndarray]]:
        """One step of every track; `at` is a row of each tracker's frame."""
        none = np.zeros(0, np.int64)
        track, rows = (np.concatenate([none, *c]) for c in (zip(*self.waiting, strict=True) if self.waiting else ((), ())))
        order = np.argsort(track, kind="stable")
        track, rows = track[order], rows[order]
        counts = np.bincount(track, minlength=len(self.owner))
        start = np.cumsum(counts) - counts
        fresh = self.steps == 0
        self._first(np.flatnonzero(fresh), counts, start, rows)
        old = np.flatnonzero(~fresh)
        if old.size:
            measured = (self.values[rows[start[old[has]] + k]] for k in range(int(counts[old].max(initial=0))) for has in (counts[old] > k,))
            which = (np.flatnonzero(counts[old] > k) for k in range(int(counts[old].max(initial=0))))
            self.x[old], self.p[old] = self.rules.updated_by(self.x[old], self.p[old], zip(which, measured, strict=True))
        self.steps = self.steps + 1
        self.updated = self.now[self.owner]
        self.waiting = []
        shown = np.flatnonzero(self.steps > T.SHOW_AFTER)
        if not shown.size:
            return
        x, p, owner = self.x[shown], self.p[shown], self.owner[shown]
        lost = (p[:, 0, 0] == 0) & (p[:, 0, 1] == 0)
        cov = [np.where(lost, other, p[:, a, b]) for other, a, b in ((1.0, 0, 0), (0.0, 0, 1), (1.0, 1, 1), (2.0, 2, 2), (0.0, 2, 3), (2.0, 3, 3))]
        dx, dy = (x[:, 2] * np.cos(x[:, 3]), x[:, 2] * np.sin(x[:, 3])) if self.mode == 2 else (x[:, 2], x[:, 3])
        key = [run[at[owner]], self.number[owner], frame[at[owner]], self.now[owner], self.ids[shown]]
        out = [*key, x[:, 0], x[:, 1], *cov[:3], dx, dy, *cov[3:], counts[shown], *self.boxes[shown].T, self.seen[shown], self.steps[shown]]
        if not members:
            yield out
            return
        yield [*out, *[np.full(len(shown), -1)] * 2]
        mine = self.steps[track] > T.SHOW_AFTER
        if mine.any():
            track, rows = track[mine], rows[mine]
            owner = self.owner[track]
            blank = [np.full(len(track), v) for v in T.BLANK]
            yield [run[at[owner]], self.number[owner], frame[at[owner]], self.now[owner], self.ids[track], *blank, self.values[rows, 9], self.values[rows, 10]]

    def _first(self, fresh: np.ndarray, counts: np.ndarray, start: np.ndarray, rows: np.ndarray) -> None:
        """The first place and covariance of tracks, of the measurements of their first frame."""
        if not fresh.size:
            return
        z = self.values[rows[start[fresh]]]
        self.x[fresh] = 0
        self.x[fresh, :2], self.p[fresh, :2, :2] = z[:, :2], z[:, [5, 6, 6, 7]].reshape(-1, 2, 2)
        several = fresh[counts[fresh] > 1]
        if not several.size:
            return
        total, place = np.zeros((several.size, 2, 2)), np.zeros((several.size, 2))
        for k in range(int(counts[several].max())):
            has = np.flatnonzero(counts[several] > k)
            z = self.values[rows[start[several[has]] + k]]
            c = z[:, [5, 6, 6, 7]].reshape(-1, 2, 2)
            c = c if self.compat else np.linalg.pinv(c)
            total[has] += c
            place[has] += (c @ z[:, :2, None])[:, :, 0]
        total = total if self.compat else np.linalg.pinv(total)
        self.x[several, :2], self.p[several, :2, :2] = (total @ place[:, :, None])[:, :, 0], total
