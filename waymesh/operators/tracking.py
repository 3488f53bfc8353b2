"""Multi-object tracking: association of detections to tracks, Kalman fusion, births and expiry.

Only a tracker's own frames are sequential. Rows are dealt by (run, tracker) and sorted; a task goes
through them frame by frame and holds a batch of rows, the live tracks of one tracker in arrays, and
no history. The same step drives the batch job and the stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from waymesh import scratch
from waymesh.functions import geometry as G
from waymesh.functions.geometry import gated_of, iou_of
from waymesh.operators import scoring

#: Fixed values of the filter, the gate, and the trust from which measurements are left out.
PROCESS, NOISE, STEP, GATE, SHOW_AFTER, IDS, UNTRUSTED = 0.9, 0.7, 0.1, 0.5, 4, 10000, 1.2
TRACKS = "run_id int, tracker_id long, frame int, t double, track_id long, x double, y double, c00 double, c01 double, c11 double, dx double, dy double, d00 double, d01 double, d11 double, n_meas int, width double, length double, angle double, last_seen double, steps int"
#: Which measurements went into a mature track.
MEMBERS = "run_id int, tracker_id long, frame int, track_id long, batch_ord int, det_ord int"
INPUT = ["run_id", "tracker_id", "frame", "t", "batch_ord", "det_ord", "cx", "cy", "width", "length", "angle", "c00", "c01", "c11", "trust"]
VALUES = [*INPUT[6:], "batch_ord", "det_ord"]
PLACES = [INPUT.index(c) for c in VALUES]
#: Rows of tracks that are handed on at a time.
OUT = 1 << 15
SIZE = {0: 4, 1: 6, 2: 5}
#: Both, with batch_ord and det_ord below zero in rows of tracks; and a member's values of a track's.
BOTH = f"{TRACKS}, batch_ord int, det_ord int"
BLANK = (*[np.nan] * 10, 0, *[np.nan] * 4, 0)


def transition(dt: float, mode: int = 1) -> np.ndarray:
    """Constant velocity (0) or acceleration (1); the latter moves by a dt^2, without the half."""
    f = np.eye(SIZE[mode])
    f[0, 2] = f[1, 3] = dt
    if mode == 1:
        f[0, 4] = f[1, 5] = dt * dt
        f[2, 4] = f[3, 5] = dt
    return f


def transitions(dt: np.ndarray, mode: int) -> np.ndarray:
    """One transition for each time."""
    f = np.repeat(np.eye(SIZE[mode])[None], dt.size, axis=0)
    f[:, 0, 2] = f[:, 1, 3] = dt
    if mode == 1:
        f[:, 0, 4] = f[:, 1, 5] = dt * dt
        f[:, 2, 4] = f[:, 3, 5] = dt
    return f


def inverses(c: np.ndarray) -> np.ndarray:
    """Inverses of n symmetric 2 x 2 matrices; the pseudo-inverse of one that is all but singular."""
    det = c[:, 0, 0] * c[:, 1, 1] - c[:, 0, 1] * c[:, 1, 0]
    flat = np.abs(det) <= 1e-12 * np.maximum(np.abs(c[:, 0, 0]), np.abs(c[:, 1, 1])) ** 2
    out = np.empty_like(c)
    safe = np.where(flat, 1.0, det)
    out[:, 0, 0], out[:, 1, 1], out[:, 0, 1], out[:, 1, 0] = c[:, 1, 1] / safe, c[:, 0, 0] / safe, -c[:, 0, 1] / safe, -c[:, 1, 0] / safe
    if flat.any():
        out[flat] = np.linalg.pinv(c[flat])
    return out


#: What stands for the motion of a track whose heading, or turn rate, is exactly zero in the online filter; a fixed value.
UNKNOWN = 999.9


def _arcs(x: np.ndarray, dt: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of turning tracks (rows of x, y, speed, heading, turn rate) that turn, the rate, and sine and cosine of the heading before and after."""
    turns = np.abs(x[:, 4]) >= 1e-9
    rate = np.where(turns, x[:, 4], 1.0)
    after = x[:, 3] + dt * x[:, 4]
    return turns, rate, np.sin(x[:, 3]), np.cos(x[:, 3]), np.sin(after), np.cos(after)


def turned(x: np.ndarray, dt: np.ndarray) -> np.ndarray:
    """Turning tracks some time later, along arcs; straight where they do not turn."""
    turns, rate, s0, c0, s1, c1 = _arcs(x, dt)
    out, v = x.copy(), x[:, 2]
    out[:, 0] += np.where(turns, v / rate * (s1 - s0), v * dt * c0)
    out[:, 1] += np.where(turns, v / rate * (c0 - c1), v * dt * s0)
    out[:, 3] += dt * x[:, 4]
    return out


def turnings(x: np.ndarray, dt: np.ndarray, online: bool = False) -> np.ndarray:
    """The derivative of turned() by the state, of each track. The online filter takes it for the motion itself, with UNKNOWN for what it cannot say."""
    turns, rate, s0, c0, s1, c1 = _arcs(x, dt)
    v, f = x[:, 2], np.repeat(np.eye(5)[None], len(x), axis=0)
    f[:, 3, 4] = dt
    f[:, 0, 2], f[:, 1, 2] = np.where(turns, (s1 - s0) / rate, dt * c0), np.where(turns, (c0 - c1) / rate, dt * s0)
    f[:, 0, 3], f[:, 1, 3] = np.where(turns, v / rate * (c1 - c0), -v * dt * s0), np.where(turns, v / rate * (s1 - s0), v * dt * c0)
    f[:, 0, 4] = np.where(turns, v * dt / rate * c1 - v / rate**2 * (s1 - s0), -v * dt**2 / 2 * s0)
    f[:, 1, 4] = np.where(turns, v * dt / rate * s1 - v / rate**2 * (c0 - c1), v * dt**2 / 2 * c0)
    if online:
        f[x[:, 3] == 0, :2, 2:4] = UNKNOWN
        f[x[:, 4] == 0, :2, 4] = UNKNOWN
    return f


def process_noise(mode: int = 1, online: bool = False) -> np.ndarray:
    """Of the turning model a diagonal one, or that of the online filter, which couples places with speed and heading."""
    q, n = PROCESS, NOISE
    if mode == 0:
        three, two = q * n**3 / 3, q * n**2 / 2
        return np.array([[three, 0, two, 0], [0, three, 0, two], [two, 0, q, 0], [0, two, 0, q]])
    if mode == 2 and online:
        four, three, two = q * n**4 / 4, q * n**3 / 2, q * n**2
        return np.array([[four, 0, three, 0, 0], [0, four, 0, three, 0], [three, three, two, 0, 0], [0, 0, 0, two, 0], [0, 0, 0, 0, two]])
    if mode == 2:
        return np.diag([q * n**4 / 4, q * n**4 / 4, q * n**2, q * n**2, q * n])
    five, four, three, two = q * n**5 / 8, q * n**4 / 4, q * n**3 / 2, q * n**2
    out = np.zeros((6, 6))
    for a in range(2):
        out[a, a], out[a, a + 2], out[a + 2, a], out[a + 2, a + 2], out[a + 2, a + 4], out[a + 4, a + 2], out[a + 4, a + 4] = five, four, four, three, three, three, two
    return out


def deviations(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half axes of the one-deviation ellipses of n covariances."""
    mean, spread = (p[:, 0, 0] + p[:, 1, 1]) / 2, np.hypot((p[:, 0, 0] - p[:, 1, 1]) / 2, p[:, 0, 1])
    axes = (np.sqrt(np.maximum(np.nan_to_num(mean + s * spread, nan=0, posinf=0, neginf=0), 0)) for s in (1, -1))
    return tuple(axes)


def one_to_one(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of track i and detection j at distance d, nearest first, each if neither side is taken."""
    taken, used, pairs = set(), set(), []
    order = np.lexsort((j, i, d))
    for track, det in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if track not in taken and det not in used:
            taken.add(track)
            used.add(det)
            pairs.append((track, det))
    return pairs


def claimed(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
    """Pairs as the online tracker finds them: tracks in order, each with its detections by distance, then number."""
    claims: list[list] = []  # detection, track or None, distance; the first claim of a detection counts
    first_claim: dict[int, int] = {}
    order = np.lexsort((j, d, i))
    settled = -1  # the last track that has its detection
    for track, det, far in zip(i[order].tolist(), j[order].tolist(), d[order].tolist(), strict=True):
        claim = first_claim.get(det)
        if track == settled:
            if claim is None:
                first_claim[det] = len(claims)
                claims.append([det, None, 1.0])
        elif claim is None:
            first_claim[det] = len(claims)
            claims.append([det, track, far])
            settled = track
        elif claims[claim][2] > far:
            claims[claim][1:] = [None, 1.0]
            claims.append([det, track, far])
            settled = track
    return [(track, det) for det, track, _ in claims if track is not None]


@dataclass
class Tracker:
    """compat: as the online tracker does it, where a track stands at the origin until its first fusion, several tracks can claim a detection that was taken over, and a first fusion of several measurements multiplies by the sum of their covariances. Otherwise tracks start at their detection, pairs are one to one, and the first fusion is the information mean."""

    tracker_id: int
    cleanup: float = 0.3
    compat: bool = True
    mode: int = 1
    distance: str = "iou"
    next_id: int = 0
    ids: list[int] = field(default_factory=list)
    boxes: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    x: np.ndarray | None = None
    p: np.ndarray | None = None
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0))
    updated: np.ndarray = field(default_factory=lambda: np.zeros(0))
    waiting: list[list[np.ndarray]] = field(default_factory=list)
    gates: tuple[float, np.ndarray] | None = None
    #: Track, batch and number of each measurement of the last step that went into a mature track.
    members: list[tuple[int, int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        n = SIZE[self.mode]
        self.x = np.zeros((0, n)) if self.x is None else self.x
        self.p = np.zeros((0, n, n)) if self.p is None else self.p

    def _gates(self, t: float) -> np.ndarray:
        """Predicted boxes (x, y, width, length, angle), larger by three deviations. Those of earlier batches of the frame are kept; tracks born since are added."""
        if self.gates is None or self.gates[0] != t:
            self.gates = (t, np.zeros((0, 5)))
        if (n := len(self.gates[1])) < len(self.ids):
            self.gates = (t, np.concatenate((self.gates[1], self._predicted(t, n))))
        return self.gates[1]

    def _predicted(self, t: float, n: int) -> np.ndarray:
        return self.predicted(t - self.updated[n:], self.x[n:], self.p[n:], self.boxes[n:])

    def predicted(self, dt: np.ndarray, x: np.ndarray, p: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """Boxes of the given tracks some time after their last update, larger by three deviations."""
        if self.mode != 2 or not self.compat:  # the online filter gates turning tracks where they were last
            later = dt >= 0
            if self.mode != 2 and not dt.any():  # nothing has moved, as of tracks just born
                moved, grown = x, p + process_noise(self.mode)
            else:
                f = turnings(x, np.where(later, dt, 0)) if self.mode == 2 else transitions(np.where(later, dt, 0), self.mode)
                moved = turned(x, np.where(later, dt, 0)) if self.mode == 2 else (f @ x[:, :, None])[:, :, 0]
                grown = f @ p @ f.transpose(0, 2, 1) + process_noise(self.mode)
            x, p = np.where(later[:, None], moved, x), np.where(later[:, None, None], grown, p)
        a, b = deviations(p)
        return np.column_stack((x[:, 0], x[:, 1], boxes[:, 0] + 3 * a, boxes[:, 1] + 3 * b, boxes[:, 2]))

    def _distances(self, gates: np.ndarray, dets: np.ndarray) -> np.ndarray:
        """One less the overlap of boxes, or for "gated_euclidean" a hundredth of the distance inside a detection's box; else one.

        Overlaps are computed where circles meet and areas are near enough for a distance below the gate; only those below it matter."""
        out = np.ones((len(gates), len(dets)))
        reach = (np.hypot(gates[:, 2], gates[:, 3])[:, None] + np.hypot(dets[:, 2], dets[:, 3])) / 2
        apart = np.hypot(gates[:, None, 0] - dets[:, 0], gates[:, None, 1] - dets[:, 1])
        i, j = np.nonzero(apart <= reach)
        if self.distance == "gated_euclidean":
            out[i, j] = gated_of(gates[i], dets[j])
        elif self.distance == "iou":
            one, two = gates[i, 2] * gates[i, 3], dets[j, 2] * dets[j, 3]
            can = np.minimum(one, two) > (1 - GATE) * (1 - 1e-9) * np.maximum(one, two)
            i, j = i[can], j[can]
            overlap = iou_of(gates[i], dets[j, :5])
            out[i, j] = np.where(overlap <= 0, 1, 1 - overlap)
        else:
            raise ValueError(f"unknown distance {self.distance!r}")
        return out

    def _matches(self, distances: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Pairs of track and detection, and the detections that start no track."""
        i, j = np.nonzero(distances < GATE)
        return (claimed if self.compat else one_to_one)(i, j, distances[i, j]), set(np.unique(j).tolist())

    def observe(self, t: float, dets: np.ndarray) -> None:
        """A batch: rows of cx, cy, width, length, angle, c00, c01, c11 in order, and as far as they are given trust, batch_ord and det_ord. An empty one only expires tracks."""
        if len(dets):
            pairs, known = self._matches(self._distances(self._gates(t), dets)) if self.ids else ([], set())
            for track, det in pairs:
                self.waiting[track].append(dets[det])
                self.seen[track] = t
            self._born(t, dets[[j for j in range(len(dets)) if j not in known]])
        keep = self.seen > t - self.cleanup
        if not keep.all():
            self.gates = None
            self.waiting = [w for w, k in zip(self.waiting, keep, strict=True) if k]
            self.ids = [i for i, k in zip(self.ids, keep, strict=True) if k]
            for name in ("boxes", "x", "p", "steps", "seen", "updated"):
                setattr(self, name, getattr(self, name)[keep])

    def _born(self, t: float, dets: np.ndarray) -> None:
        n, size = len(dets), SIZE[self.mode]
        if not n:
            return
        for _ in range(n):
            self.ids.append(IDS * self.tracker_id + self.next_id)
            self.next_id = self.next_id + 1 if self.next_id < IDS else 0
        x, p = np.zeros((n, size)), np.zeros((n, size, size))
        p[:, 0, 0] = p[:, 1, 1] = 1
        if not self.compat:
            x[:, :2] = dets[:, :2]
            p[:, :2, :2] = dets[:, [5, 6, 6, 7]].reshape(-1, 2, 2)
        self.x, self.p = np.concatenate((self.x, x)), np.concatenate((self.p, p))
        self.boxes = np.concatenate((self.boxes, dets[:, 2:5]))
        self.steps, self.seen, self.updated = np.append(self.steps, np.zeros(n, int)), np.append(self.seen, np.full(n, t)), np.append(self.updated, np.full(n, t))
        self.waiting += [[d] for d in dets]

    def _first(self, group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        covs = [np.array([[d[5], d[6]], [d[6], d[7]]]) for d in group]
        if len(group) == 1:
            return group[0][:2], covs[0]
        if self.compat:
            total = sum(covs)
            return total @ sum(c.T @ d[:2] for c, d in zip(covs, group, strict=True)), total
        inverse = [np.linalg.pinv(c) for c in covs]
        total = np.linalg.pinv(sum(inverse))
        return total @ sum(c @ d[:2] for c, d in zip(inverse, group, strict=True)), total

    def updated_by(self, x: np.ndarray, p: np.ndarray, measured: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Tracks a step later, updated by the first measurement of those that have one, then by the second, and so on: (places among the tracks, measurements)."""
        dt = np.full(len(x), STEP)
        f = turnings(x, dt, self.compat) if self.mode == 2 else transition(STEP, self.mode)[None]
        p = f @ p @ f.transpose(0, 2, 1) + process_noise(self.mode, self.compat)
        x = turned(x, dt) if self.mode == 2 and not self.compat else (f @ x[:, :, None])[:, :, 0]
        for has, z in measured:
            trust = z[:, 8] if z.shape[1] > 8 else np.ones(len(z))
            has, z, trust = has[trust < UNTRUSTED], z[trust < UNTRUSTED], trust[trust < UNTRUSTED]
            if not has.size:
                continue
            r = z[:, [5, 6, 6, 7]].reshape(-1, 2, 2) * trust[:, None, None]
            gain = p[has][:, :, :2] @ inverses(p[has][:, :2, :2] + r)
            x[has] += (gain @ (z[:, :2] - x[has][:, :2])[:, :, None])[:, :, 0]
            p[has] -= gain @ p[has][:, :2, :]
        return x, p

    def fuse(self, t: float) -> list[tuple]:
        """One step of every track; rows of the mature ones."""
        fresh, counts = self.steps == 0, np.array([len(w) for w in self.waiting], int)
        for i in np.flatnonzero(fresh).tolist():
            self.x[i] = 0
            self.x[i, :2], self.p[i, :2, :2] = self._first(self.waiting[i])
        old = np.flatnonzero(~fresh)
        if old.size:
            measured = ((has, np.array([self.waiting[old[i]][k] for i in has])) for k in range(int(counts[old].max(initial=0))) for has in (np.flatnonzero(counts[old] > k),))
            self.x[old], self.p[old] = self.updated_by(self.x[old], self.p[old], measured)
        self.steps += 1
        self.updated[:] = t
        self.gates = None
        shown = np.flatnonzero(self.steps > SHOW_AFTER).tolist()
        self.members = [(self.ids[i], int(d[9]), int(d[10])) for i in shown for d in self.waiting[i] if len(d) > 10]
        self.waiting = [[] for _ in self.waiting]
        out = []
        for i in shown:
            x, p = self.x[i], self.p[i]
            lost = p[0, 0] == 0 and p[0, 1] == 0
            c, d = ((1.0, 0.0, 1.0), (2.0, 0.0, 2.0)) if lost else ((p[0, 0], p[0, 1], p[1, 1]), (p[2, 2], p[2, 3], p[3, 3]))
            dx, dy = (x[2] * np.cos(x[3]), x[2] * np.sin(x[3])) if self.mode == 2 else x[2:4]
            out.append((self.ids[i], x[0], x[1], *c, dx, dy, *d, int(counts[i]), *self.boxes[i], self.seen[i], int(self.steps[i])))
        return out

    def run(self, rows: pd.DataFrame, members: bool = False) -> Iterator[tuple]:
        """Whole frames in order, sorted by batch and number; rows without a batch only say that the frame is there. Rows of tracks; with members also a row for each of them, of the track's id and otherwise nothing but its batch and number."""
        values = rows[VALUES].to_numpy(float)
        frame, batch, t = rows["frame"].to_numpy(), np.nan_to_num(values[:, 9], nan=-1), rows["t"].to_numpy(float)
        edges = np.flatnonzero(np.concatenate(([True], (frame[1:] != frame[:-1]) | (batch[1:] != batch[:-1])))).tolist() + [len(rows)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            part = values[a:b]
            self.observe(t[a], part[~np.isnan(part[:, 0])])
            if k + 2 == len(edges) or frame[edges[k + 1]] != frame[a]:
                found = self.fuse(t[a])
                yield from ((frame[a], t[a], *row, *((-1, -1) if members else ())) for row in found)
                if members:
                    yield from ((frame[a], t[a], i, *BLANK, *at) for i, *at in self.members)

    def saved(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def restored(cls, state: bytes) -> Tracker:
        found = cls.__new__(cls)
        found.__dict__.update(pickle.loads(state))
        return found


ORDER = ["frame", "batch_ord", "det_ord"]
_KINDS = {"int": "int32", "long": "int64", "double": "float64", "string": "object", "boolean": "bool", "binary": "object"}


def table_of(schema: str, rows: list[tuple]) -> pd.DataFrame:
    kinds = dict(c.split() for c in schema.split(", "))
    return pd.DataFrame(rows, columns=list(kinds)).astype({c: _KINDS[k] for c, k in kinds.items()})


def with_calendar(detections: DataFrame, calendar: DataFrame, batches: list[Column] | None = None) -> DataFrame:
    """Detections of each tracker, and a row without a batch for each frame (run_id, tracker_id, frame, t) that has none: tracks move and expire there too. Without a column trust all are trusted.

    With batches, the order that a frame's batches stand in, they are numbered here. Rows are dealt once, as
    the tracker wants them: frames are rows beside the detections, and what a frame has is found where it is."""
    if "trust" not in detections.columns:
        detections = detections.withColumn("trust", F.lit(1.0))
    c = F.col
    frames = calendar.select("run_id", "tracker_id", "frame", c("t").alias("_t"), F.lit(True).alias("_frame"))
    rows = detections.drop("t").unionByName(frames, allowMissingColumns=True).repartition("run_id", "tracker_id")
    frame = Window.partitionBy("run_id", "tracker_id", "frame")
    if batches is not None:
        number = F.dense_rank().over(frame.orderBy(c("_frame").asc_nulls_first(), *batches)) - 1
        rows = rows.withColumn("batch_ord", F.when(c("_frame").isNull(), number))
    found = F.max(c("_frame").isNull()).over(frame)
    rows = rows.withColumns({"t": F.max("_t").over(frame), "_known": F.max("_frame").over(frame), "_found": found})
    return rows.where("_known AND (_frame IS NULL OR NOT _found)").select(*INPUT)


def _stepped(detections: DataFrame, schema: str, members: bool, cleanup: float, compat: bool, mode: int, distance: str) -> DataFrame:
    from waymesh.operators import fleet  # which is made of this module's steps

    kinds, most = [c.split()[1] for c in schema.split(", ")], fleet.HELD
    names = [c.split()[0] for c in schema.split(", ")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trackers, held = fleet.Fleet(cleanup, compat, mode, distance), np.zeros((0, len(INPUT)))
        waiting, count = [], 0

        def due(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            parts, n = [], 0
            for part in trackers.run(rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64), rows[:, 2].astype(np.int64), rows[:, 3], rows[:, PLACES], members):
                parts.append(part)
                n += len(part[0])
                if n >= OUT:
                    yield table(parts)
                    parts, n = [], 0
            if parts:
                yield table(parts)

        def table(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            columns = (np.concatenate(c).astype(_KINDS[k]) for c, k in zip(zip(*parts, strict=True), kinds, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for batch in batches:
            waiting.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
            count += batch.num_rows
            if count < most:
                continue
            held = np.concatenate((held, *waiting))
            differs = np.flatnonzero((held[:, :3] != held[-1, :3]).any(axis=1))
            last = int(differs[-1]) + 1 if differs.size else 0  # the last frame may go on in the next batch
            if last:
                yield from due(held[:last])
            held, waiting, count = held[last:], [], 0
        held = np.concatenate((held, *waiting))
        if len(held):
            yield from due(held)

    dealt = detections.select(*INPUT).repartition("run_id", "tracker_id")
    return dealt.sortWithinPartitions("run_id", "tracker_id", *ORDER).mapInArrow(step, schema)


def tracks(detections: DataFrame, cleanup: float = 0.3, compat: bool = True, mode: int = 1, distance: str = "iou") -> DataFrame:
    """Fused rows of mature tracks. Trackers run in parallel; memory is bounded by a batch and a frame, whatever the length of a run.

    distance: "iou" or "gated_euclidean". Measurements with a trust of UNTRUSTED or more are left out
    of updates; the trust of others multiplies their covariance."""
    return _stepped(detections, TRACKS, False, cleanup, compat, mode, distance)


def with_members(detections: DataFrame, cleanup: float = 0.3, compat: bool = True, mode: int = 1, distance: str = "iou") -> tuple[DataFrame, DataFrame]:
    """tracks(), and the measurements (batch_ord, det_ord) that went into each of them in each frame, from one pass that is written."""
    both = scratch.written(_stepped(detections, BOTH, True, cleanup, compat, mode, distance), "tracks")
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    return both.where("batch_ord < 0").select(*names(TRACKS)), both.where("batch_ord >= 0").select(*names(MEMBERS))


def consistency(found: DataFrame, joined: DataFrame, detections: DataFrame) -> DataFrame:
    """For each track and frame, how its sensors agree with it: sensors (sensor_id, score) and trust (sensor_id, confidence), both in order of sensor_id, batch and number.

    found: rows of tracks; joined: their members; detections: sensor_id and confidence besides the
    tracker's input. The score is a measurement's distance from the fused place, over what its own
    one-deviation ellipse reaches beyond the track's axes; null where that is nothing. A track
    without correlation or variance has no axes."""
    keys = ["run_id", "tracker_id", "frame"]
    c = F.col
    a, b, phi = G.ellipse(c("m00"), c("m01"), c("m11"), 1.0)
    ex, ey = G.radius_at(a, b, phi, F.lit(0.0)), G.radius_at(a, b, phi, F.pi() / 2)
    ga, gb, _ = G.ellipse(c("c00"), c("c01"), c("c11"), 1.0)
    fused = F.when((c("c00") != 0) & (c("c01") != 0), F.sqrt(ga * ga + gb * gb)).otherwise(0.0)
    seen = detections.select(*keys, "batch_ord", "det_ord", "sensor_id", "confidence", c("cx").alias("mx"), c("cy").alias("my"), c("c00").alias("m00"), c("c01").alias("m01"), c("c11").alias("m11"))
    rows = joined.join(found.select(*keys, "track_id", "x", "y", "c00", "c01", "c11"), [*keys, "track_id"]).join(seen, [*keys, "batch_ord", "det_ord"])
    off = F.sqrt((c("mx") - c("x")) * (c("mx") - c("x")) + (c("my") - c("y")) * (c("my") - c("y")))
    rows = rows.withColumn("score", F.try_divide(off, F.sqrt(ex * ex + ey * ey) - fused))
    order = F.array_sort(F.collect_list(F.struct("sensor_id", "batch_ord", "det_ord", "score", "confidence")))
    rows = rows.groupBy(*keys, "track_id").agg(order.alias("of"))
    return rows.select(*keys, "track_id", F.transform("of", lambda x: F.struct(x["sensor_id"], x["score"])).alias("sensors"), F.transform("of", lambda x: F.struct(x["sensor_id"], x["confidence"])).alias("trust"))


def twins(found: DataFrame) -> DataFrame:
    """Pairs of tracks of one tracker and frame (a_id below b_id) whose boxes nearly coincide, and the loser: that of scoring.duplicate_loser."""
    keys = ["run_id", "tracker_id", "frame"]
    found = scratch.written(found, "tracks")  # the sides of the join and their levels are read from it, so that trackers run once
    names = {"x": "x", "y": "y", "w": "width", "l": "length", "angle": "angle", "id": "track_id", "last": "last_seen", "steps": "steps"}
    a, b = (found.select(*keys, *(F.col(c).alias(f"{side}_{k}") for k, c in names.items())) for side in "ab")
    pairs = scoring.with_iou(scoring.candidates(a, b, keys).where("a_id < b_id"))
    return scoring.duplicate_loser(pairs.withColumn("distance", G.iou_distance(F.col("iou")))).select(*keys, "a_id", "b_id", "distance", "loser")


def lifetimes(found: DataFrame) -> DataFrame:
    """First and last frame and number of rows of each track."""
    return found.groupBy("run_id", "tracker_id", "track_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("frames"))


def pooled(measurements: DataFrame, keys: list[str], information: bool = False) -> DataFrame:
    """The first measurement of a track from several: C = sum of C_i and C (sum of C_i z_i), or the proper information mean. One measurement stays itself."""
    c = F.col
    if information:
        det = c("c00") * c("c11") - c("c01") * c("c01")
        i00, i01, i11 = c("c11") / det, -c("c01") / det, c("c00") / det
    else:
        i00, i01, i11 = c("c00"), c("c01"), c("c11")
    sums = {"s00": i00, "s01": i01, "s11": i11, "u": i00 * c("cx") + i01 * c("cy"), "v": i01 * c("cx") + i11 * c("cy")}
    rows = measurements.groupBy(*keys).agg(*(F.sum(e).alias(k) for k, e in sums.items()), *(F.first(k).alias(f"one_{k}") for k in ("cx", "cy", "c00", "c01", "c11")), F.count("*").alias("n"))
    if information:
        det = c("s00") * c("s11") - c("s01") * c("s01")
        p00, p01, p11 = c("s11") / det, -c("s01") / det, c("s00") / det
    else:
        p00, p01, p11 = c("s00"), c("s01"), c("s11")
    of = {"x": p00 * c("u") + p01 * c("v"), "y": p01 * c("u") + p11 * c("v"), "c00": p00, "c01": p01, "c11": p11}
    one = {"x": "one_cx", "y": "one_cy", "c00": "one_c00", "c01": "one_c01", "c11": "one_c11"}
    return rows.select(*keys, "n", *(F.when(c("n") == 1, c(one[k])).otherwise(e).alias(k) for k, e in of.items()))
