"""Truth rows of moving objects and fixed sites, and who comes and goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from waymesh.functions import geometry as G, kinematics as K


def static_attributes(telemetry: DataFrame) -> DataFrame:
    """Type, length and width of each object, as first seen in its run."""
    first = F.min_by(F.struct("object_type", "length", "width"), "frame").alias("s")
    return telemetry.groupBy("run_id", "object_id").agg(first).select("run_id", "object_id", "s.*")


def state(telemetry: DataFrame) -> DataFrame:
    """cx, cy, angle, vx and vy of every row; the stored angle is half a turn off the course."""
    course = K.heading(F.col("angle_deg"))
    vx, vy = K.velocity(F.col("speed"), course)
    cx, cy = K.centroid(F.col("front_x"), F.col("front_y"), F.col("length"), course)
    return telemetry.withColumns({"vx": vx, "vy": vy, "angle": course + F.pi(), "cx": cx, "cy": cy}).drop("front_x", "front_y", "speed", "angle_deg")


def with_box(rows: DataFrame, order=G.TRUTH_CORNERS, turn_back: bool = True) -> DataFrame:
    """Adds bbox, the corner list; truth boxes turn by the course, tracks by the stored angle."""
    angle = F.col("angle") - F.pi() if turn_back else F.col("angle")
    return rows.withColumn("bbox", G.polygon(G.corners(F.col("cx"), F.col("cy"), F.col("width"), F.col("length"), angle, order)))


def site_truth(sites: DataFrame) -> DataFrame:
    """A site as a resting object: a square of 100 m around it."""
    rows = sites.select(F.col("site_id").alias("object_id"), F.lit("traffic_light").alias("object_type"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    rows = rows.withColumns({c: F.lit(v) for c, v in {"vx": 0.0, "vy": 0.0, "angle": 0.0, "width": 100.0, "length": 100.0}.items()})
    return with_box(rows, turn_back=False)


def changes(rows: DataFrame) -> DataFrame:
    """arrived, departed: whether the object was absent in the frame before, is absent in the next; per run."""
    w = Window.partitionBy("run_id", "object_id").orderBy("frame")
    before, after = F.lag("frame").over(w), F.lead("frame").over(w)
    return rows.withColumns({"arrived": before.isNull() | (before < F.col("frame") - 1), "departed": after.isNull() | (after > F.col("frame") + 1)})


def still_active(known: DataFrame, present: DataFrame) -> DataFrame:
    """The known (run, frame, object) rows whose object is present in the frame."""
    return known.join(present.select("run_id", "frame", "object_id"), ["run_id", "frame", "object_id"], "left_semi")
