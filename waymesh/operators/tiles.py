"""One tracker's frames over several tasks: tracks that cannot meet are followed apart.

A detection and a track touch only where the track's gate overlaps the detection by half, which
bounds how far the gate's centre is off. So the detections of a block of frames fall into components:
those whose surroundings share a cell of the plane. A component is a task of its own, which takes up
the live tracks whose last measurement is in it and hands on those that it ends with. A block is
valid if no gate of a component came near a detection of another in the same frame; where one did,
the two are joined and the block is run again. Tracks are named by their first detections, and get
their numbers at the end, in the order of their births."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from waymesh import scratch
from waymesh.operators.tracking import IDS, INPUT, ORDER, STEP, TRACKS, VALUES, Tracker, table_of

#: Side of a cell in metres, frames of a block, and how far a gate's centre can be off a detection that it overlaps by half, in diagonals of the detection:
#: half of its own, and half of the gate's, whose longer side is below twice that diagonal and whose area is below twice the detection's.
CELL, BLOCK, REACH = 32.0, 100, 2.5
KEYS = ["run_id", "tracker_id"]
BIRTH, LAST = ("birth_frame", "birth_batch", "birth_det"), ("last_frame", "last_batch", "last_det")
_VALUES = [c for c in TRACKS.split(", ") if c.split()[0] not in (*KEYS, "track_id")]
#: Rows that a component gives: tracks, births, states to hand on, and cells of gates.
TRACK, BORN, STATE, GATE = range(4)
OUT = ", ".join(["run_id int, tracker_id long, kind int, component long", *(f"{c} int" for c in (*BIRTH, *LAST)), *_VALUES, "gate_x long, gate_y long, state binary"])
_NAMES = [c.split()[0] for c in OUT.split(", ")]
#: Values of a row that is no track's.
BLANK = tuple(np.nan if c.split()[1] == "double" else 0 for c in _VALUES)


def _labels(item: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """The least number among the items that are connected over shared cells."""
    label, changed = np.arange(n), True
    while changed:
        least = np.full(int(cell.max(initial=0)) + 1, n)
        np.minimum.at(least, cell, label[item])
        new = label.copy()
        np.minimum.at(new, item, least[cell])
        new = new[new]
        changed, label = bool((new != label).any()), new
    return label


def _components(rows: pd.DataFrame) -> pd.DataFrame:
    x0, x1, y0, y1 = (rows[c].to_numpy() for c in ("x0", "x1", "y0", "y1"))
    wide, high = x1 - x0 + 1, y1 - y0 + 1
    item = np.repeat(np.arange(len(rows)), wide * high)
    k = np.arange(item.size) - np.repeat(np.cumsum(wide * high) - wide * high, wide * high)
    cells = np.stack((x0[item] + k % wide[item], y0[item] + k // wide[item]), axis=1)
    _, cell = np.unique(cells, axis=0, return_inverse=True)
    return rows.assign(component=_labels(item, cell.ravel(), len(rows)).astype(np.int64))


class _Component:
    """A tracker over a component's frames of one block, which notes what a whole tracker would not."""

    def __init__(self, key: tuple, options: tuple, states: pd.DataFrame, cells: set[tuple[int, int]]) -> None:
        self.cells = cells
        self.key, self.tracker, self.birth, self.last, self.rows = key, Tracker(int(key[1]), *options), {}, {}, []
        states = states.sort_values(list(BIRTH), kind="stable")
        kept = [pickle.loads(s) for s in states["state"]]
        if kept:
            t = self.tracker
            t.ids, t.next_id, t.waiting = list(range(len(kept))), len(kept), [[] for _ in kept]
            for name in ("boxes", "x", "p", "steps", "seen", "updated"):
                setattr(t, name, np.array([k[name] for k in kept]))
            self.birth = dict(enumerate(states[list(BIRTH)].itertuples(index=False, name=None)))
            self.last = dict(enumerate(states[list(LAST)].itertuples(index=False, name=None)))

    def near(self, frame: int, t: float) -> None:
        """Notes where gates are outside the component's own cells, which no other component has."""
        places = set(map(tuple, np.floor(self.tracker._gates(t)[:, :2] / CELL).astype(np.int64).tolist())) if self.tracker.ids else set()
        for place in places - self.cells:
            self.rows.append((*self.key[:2], GATE, self.key[2], frame, 0, 0, 0, 0, 0, *BLANK, *place, b""))

    def observe(self, frame: int, t: float, dets: np.ndarray) -> None:
        known = set(self.tracker.ids)
        self.tracker.observe(t, dets)
        for i, waiting in zip(self.tracker.ids, self.tracker.waiting, strict=True):
            if i not in known:
                self.birth[i] = (frame, int(waiting[0][9]), int(waiting[0][10]))
                self.rows.append((*self.key[:2], BORN, self.key[2], *self.birth[i], 0, 0, 0, *BLANK, 0, 0, b""))
            if waiting:
                self.last[i] = (frame, int(waiting[-1][9]), int(waiting[-1][10]))

    def frame(self, frame: int, t: float, first_batch: float, dets: np.ndarray) -> None:
        """dets are sorted by batch and number. Where the frame's first batch is another component's, tracks expire before the first of this one."""
        self.near(frame, t)
        batches = [dets[dets[:, 9] == b] for b in np.unique(dets[:, 9])]
        if not batches or batches[0][0, 9] != first_batch:
            self.observe(frame, t, dets[:0])
        for batch in batches:
            self.observe(frame, t, batch)
        self.near(frame, t)
        for row in self.tracker.fuse(t):
            self.rows.append((*self.key[:2], TRACK, self.key[2], *self.birth[row[0]], 0, 0, 0, frame, t, *row[1:], 0, 0, b""))

    def handed_on(self) -> None:
        t = self.tracker
        for k, i in enumerate(t.ids):
            state = pickle.dumps({name: getattr(t, name)[k] for name in ("boxes", "x", "p", "steps", "seen", "updated")})
            self.rows.append((*self.key[:2], STATE, self.key[2], *self.birth[i], *self.last[i], *BLANK, 0, 0, state))


def _followed(*options):
    def followed(key: tuple, dets: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        """dets of a component; states: one row with the block's frames, and the live tracks."""
        heads = states[states["frames"].notna()]
        spans = set(dets[["x0", "x1", "y0", "y1"]].itertuples(index=False, name=None))
        cells = {(x, y) for x0, x1, y0, y1 in spans for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
        component = _Component(key, options, states[states["state"].notna()], cells)
        dets = dets.sort_values(ORDER, kind="stable")
        frames, values = dets["frame"].to_numpy(), dets[VALUES].to_numpy(float)
        for f in heads["frames"].iloc[0]:
            a, b = np.searchsorted(frames, (f["frame"], f["frame"] + 1))
            component.frame(f["frame"], f["t"], -1 if f["first_batch"] is None else f["first_batch"], values[a:b])
        component.handed_on()
        return table_of(OUT, component.rows)[_NAMES]

    return followed


def tracks(detections: DataFrame, cleanup: float = 0.3, compat: bool = True, mode: int = 1, distance: str = "iou", block: int = BLOCK) -> DataFrame:
    """The rows of tracking.tracks(), with each tracker's components as tasks of their own, block after block of frames.

    Frames are STEP apart, as the filter takes them to be. What a task holds is a component's rows of one
    block; a block's rows of one tracker meet once, by place alone. Where all of a scene is one component
    it is followed by one task, as tracking.tracks() does. In the compatible mode new tracks stand at the
    origin until their frame ends, so that what is near it joins all components with births in its frames."""
    c = F.col
    rows = scratch.written(detections.select(*INPUT).withColumn("block", F.floor(c("frame") / block).cast("long")), "tiles-rows")
    calendar = rows.groupBy(*KEYS, "block", "frame").agg(F.max("t").alias("t"), F.min("batch_ord").alias("first_batch"))
    calendar = scratch.written(calendar.groupBy(*KEYS, "block").agg(F.array_sort(F.collect_list(F.struct("frame", "t", "first_batch"))).alias("frames")), "tiles-frames")
    reach = REACH * F.sqrt(c("width") * c("width") + c("length") * c("length"))
    cells = {f"{a}{k}": F.floor((c(f"c{a}") + s * reach) / CELL) for a in "xy" for k, s in ((0, -1), (1, 1))}
    dets = rows.where("cx IS NOT NULL").withColumns(cells)
    before = math.ceil(cleanup / STEP) + 1  # frames in which a live track was measured
    over = F.floor((c("frame") + before) / block).cast("long")
    placed = dets.withColumns({"own": c("block"), "block": F.explode(F.array_distinct(F.array("block", over)))})
    schema = placed.withColumn("component", F.lit(0).cast("long")).schema
    placed = scratch.written(placed.groupBy(*KEYS, "block").applyInPandas(_components, schema), "tiles-components")
    last = rows.agg(F.min("block"), F.max("block")).head()
    found, states = None, None
    for b in range(last[0] or 0, (last[1] if last[1] is not None else -1) + 1):
        joined: dict[tuple, int] = {}
        here = placed.where(c("block") == b)
        while True:
            part = here
            if joined:
                moved = rows.sparkSession.createDataFrame([(*k, v) for k, v in joined.items()], "run_id int, tracker_id long, component long, _to long")
                part = here.join(moved, [*KEYS, "component"], "left").withColumn("component", F.coalesce("_to", "component")).drop("_to")
            own = part.where(c("own") == b)
            live = None
            if states is not None:
                at = part.select(*KEYS, *(c(x).alias(y) for x, y in zip(ORDER, LAST, strict=True)), "component")
                live = states.drop("component").join(at, [*KEYS, *LAST]).select(*KEYS, "component", *BIRTH, *LAST, "state")
            heads = own.select(*KEYS, "component")
            heads = (heads if live is None else heads.unionByName(live.select(*KEYS, "component"))).distinct().join(calendar.where(c("block") == b).drop("block"), KEYS)
            given = heads if live is None else heads.unionByName(live, allowMissingColumns=True)
            kinds = dict(x.split() for x in OUT.split(", "))
            given = given.withColumns({x: F.lit(None).cast(kinds[x]) for x in (*BIRTH, *LAST, "state") if x not in given.columns})
            given = scratch.written(given, "tiles-given")  # it must share no columns with what it is grouped with
            groups = own.groupBy(*KEYS, "component").cogroup(given.groupBy(*KEYS, "component"))
            out = scratch.written(groups.applyInPandas(_followed(cleanup, compat, mode, distance), OUT), "tiles-tracks")
            gates = out.where(c("kind") == GATE).select(*KEYS, c("birth_frame").alias("frame"), "gate_x", "gate_y", "component")
            near = own.select(*KEYS, "frame", c("component").alias("other"), F.explode(F.sequence("x0", "x1")).alias("gate_x"), "y0", "y1").withColumn("gate_y", F.explode(F.sequence("y0", "y1")))
            pairs = gates.join(near, [*KEYS, "frame", "gate_x", "gate_y"]).where(c("component") != c("other")).select(*KEYS, "component", "other").distinct().collect()
            if not pairs:
                break
            joined = _joined(joined, pairs)
        found = out if found is None else found.unionByName(out)
        states = out.where(c("kind") == STATE)
    if found is None:
        return rows.sparkSession.createDataFrame([], TRACKS)
    order = Window.partitionBy(*KEYS).orderBy(*BIRTH)
    births = found.where(c("kind") == BORN).select(*KEYS, *BIRTH).withColumn("track_id", IDS * c("tracker_id") + (F.row_number().over(order) - 1) % (IDS + 1))
    return found.where(c("kind") == TRACK).join(births, [*KEYS, *BIRTH]).select(*(x.split()[0] for x in TRACKS.split(", ")))


def _joined(before: dict[tuple, int], pairs: list) -> dict[tuple, int]:
    """Components that touch, as (run, tracker, component) to the least of those that it goes with; what was joined before stays so."""
    parent: dict[tuple, tuple] = {}

    def root(k: tuple) -> tuple:
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    links = [((*k[:2], k[2]), (*k[:2], v)) for k, v in before.items()] + [((r.run_id, r.tracker_id, r.component), (r.run_id, r.tracker_id, r.other)) for r in pairs]
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {k: root(k)[2] for k in list(parent)}
