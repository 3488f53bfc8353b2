"""The tracker and the safety counts on streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from waymesh.operators import safety
from waymesh.operators.tracking import INPUT, ORDER, TRACKS, Tracker, table_of
from waymesh.sources.telemetry import FIRST_MS, FRAME_MS

LATE = "1 second"


#: Rows of live_rows(): tracks, and detections that came too late, with their own place and covariance.
ROWS = f"{TRACKS}, late boolean"
_KEPT = {"x": "cx", "y": "cy", "c00": "c00", "c01": "c01", "c11": "c11", "width": "width", "length": "length", "angle": "angle"}


class TrackingProcessor(StatefulProcessor):
    """Holds back each tracker's rows by frame until the watermark has passed it, then steps through the frames in order; a timer reads and removes its own frame only. Rows of a frame that was stepped through already go out as they are."""

    def __init__(self, cleanup: float = 0.3, compat: bool = True, mode: int = 1, distance: str = "iou") -> None:
        self.options = (cleanup, compat, mode, distance)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracker = handle.getValueState("tracker", "state binary, done int")
        self.held = handle.getMapState("held", "frame int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.tracker.get()[1] if self.tracker.exists() else None
        late = []
        for part in rows:
            for frame, more in part[INPUT[2:]].groupby("frame"):
                name = (int(frame),)
                if done is not None and name[0] <= done:
                    late.append(more[more["batch_ord"].notna()])
                    continue
                if self.held.containsKey(name):
                    more = pd.concat((pickle.loads(self.held.getValue(name)[0]), more))
                else:
                    self.handle.registerTimer(int(frame) * FRAME_MS + FIRST_MS)
                self.held.updateValue(name, (pickle.dumps(more),))
        yield _late(key, pd.concat(late)) if late else table_of(ROWS, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        name = ((expiredTimerInfo.getExpiryTimeInMs() - FIRST_MS) // FRAME_MS,)
        if self.held.containsKey(name):
            due = pickle.loads(self.held.getValue(name)[0]).sort_values(ORDER, kind="stable", na_position="first")
            self.held.removeKey(name)
            tracker = Tracker.restored(self.tracker.get()[0]) if self.tracker.exists() else Tracker(int(key[1]), *self.options)
            found = table_of(ROWS, [(int(key[0]), int(key[1]), *r, False) for r in tracker.run(due)])
            self.tracker.update((tracker.saved(), int(name[0])))
            yield found

    def close(self) -> None:
        pass


def _late(key, rows: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in ROWS.split(", ")]
    fixed = {"run_id": int(key[0]), "tracker_id": int(key[1]), "track_id": -1, "n_meas": 0, "steps": 0, "late": True}
    found = {n: fixed[n] if n in fixed else rows[_KEPT.get(n, n)].to_numpy() if _KEPT.get(n, n) in rows else np.full(len(rows), np.nan) for n in names}
    return table_of(ROWS, list(zip(*(np.broadcast_to(found[n], len(rows)).tolist() for n in names), strict=True)))


def live_rows(detections: DataFrame, cleanup: float = 0.3, compat: bool = True, mode: int = 1, distance: str = "iou", late: str = LATE) -> DataFrame:
    """tracks() on a stream with event time ts, once the watermark has passed a frame, and the detections that came after it (late, with a track_id of -1): none is dropped uncounted.

    Spark would drop rows behind the watermark before the state sees them. So the event time stays
    with the watermark alone; what is late is decided by the frames that a tracker has stepped
    through. Needs the RocksDB state store."""
    timed = detections.withWatermark("ts", late).drop("ts")
    processor = TrackingProcessor(cleanup, compat, mode, distance)
    return timed.groupBy("run_id", "tracker_id").transformWithStateInPandas(processor, outputStructType=ROWS, outputMode="Append", timeMode="EventTime")


def live_tracks(detections: DataFrame, cleanup: float = 0.3, compat: bool = True, mode: int = 1, distance: str = "iou", late: str = LATE) -> DataFrame:
    """The tracks of live_rows() alone: the same rows as tracks()."""
    return live_rows(detections, cleanup, compat, mode, distance, late).where("NOT late").drop("late")


OBJECTS = "run_id int, frame int, object_id string, object_type string, length double, width double, arrived boolean, departed boolean"


class PresenceProcessor(StatefulProcessor):
    """An object's static attributes, read in the frame in which it arrives and forgotten when it departs. A frame is due when the watermark has passed the one after it, as only then its departure is known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.here = handle.getValueState("here", "object_type string, length double, width double, frame int")
        self.held = handle.getMapState("held", "frame int", "object_type string, length double, width double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.here.get()[3] if self.here.exists() else None
        for part in rows:
            for r in part[["frame", "object_type", "length", "width"]].itertuples(index=False):
                name = (int(r.frame),)
                if (done is None or name[0] > done) and not self.held.containsKey(name):
                    self.held.updateValue(name, (r.object_type, float(r.length), float(r.width)))
                    self.handle.registerTimer((name[0] + 1) * FRAME_MS + FIRST_MS)
        yield table_of(OBJECTS, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frame = int((expiredTimerInfo.getExpiryTimeInMs() - FIRST_MS) // FRAME_MS) - 1
        if self.held.containsKey((frame,)):
            read = tuple(self.held.getValue((frame,)))
            self.held.removeKey((frame,))
            before = self.here.get() if self.here.exists() else None
            arrived = before is None or before[3] != frame - 1
            departed = not self.held.containsKey((frame + 1,))
            known = read if arrived else tuple(before[:3])
            if departed:
                self.here.clear()
            else:
                self.here.update((*known, frame))
            yield table_of(OBJECTS, [(int(key[0]), frame, key[1], *known, arrived, departed)])

    def close(self) -> None:
        pass


def live_objects(telemetry: DataFrame, late: str = LATE) -> DataFrame:
    """Each row of a telemetry stream with its object's attributes as they were when it arrived, and whether it arrived or departs in this frame. State is kept for objects that are present only. Needs the RocksDB state store."""
    rows = telemetry.select("run_id", "object_id", "frame", "object_type", "length", "width", "ts").withWatermark("ts", late)
    return rows.groupBy("run_id", "object_id").transformWithStateInPandas(PresenceProcessor(), outputStructType=OBJECTS, outputMode="Append", timeMode="EventTime")


def live_violations(pairs: DataFrame, late: str = LATE) -> DataFrame:
    """Violations of each run, platform and frame of a stream of ego pairs, in tumbling windows of one frame."""
    counts = [F.count_if(safety.breaks_envelope(F.col("rho"), F.col("decel_min"))).alias("envelope"), F.count_if(safety.will_collide()).alias("ttc")]
    found = pairs.withWatermark("ts", late).groupBy(F.window("ts", f"{FRAME_MS} milliseconds"), "run_id", "ego_id").agg(*counts)
    return found.select("run_id", F.col("ego_id"), F.floor((F.unix_millis("window.start") - FIRST_MS) / FRAME_MS).cast("int").alias("frame"), "envelope", "ttc")
