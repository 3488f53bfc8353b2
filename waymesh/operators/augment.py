"""Seeded sampling, detections from truth, and injected faults, as table jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymesh.functions import geometry as G, seeded as S

SHIFT, TURN = 1.0, 0.17


def sampled_roles(objects: DataFrame, probability: float, seed: int) -> DataFrame:
    """The distinct (run, object) pairs that become instrumented."""
    rows = objects.select("run_id", "object_id").distinct()
    return rows.where((S.uniform(seed, "role", "run_id", "object_id") <= probability) & F.lit(probability > 0))


def chosen_packages(rows: DataFrame, packages: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Draws a package (name, weight) for each row: bounds from cumulated weights, the last also taking what rounding leaves."""
    order = Window.orderBy("name")  # over the few rows of the catalogue
    high = F.sum("weight").over(order) / F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bounds = packages.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0))).withColumn("last", F.lead("name").over(order).isNull())
    drawn = rows.withColumn("u", S.uniform(seed, "package", *keys))
    return drawn.join(F.broadcast(bounds.select("name", "low", "high", "last")), (F.col("u") >= F.col("low")) & ((F.col("u") < F.col("high")) | F.col("last"))).drop("low", "high", "last", "weight")


def thinned(pairs: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Visible pairs that are detected: a uniform up to the probability at their distance."""
    return pairs.where(S.uniform(seed, "detect", *keys) <= F.col("probability"))


def perturbed(pairs: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Moves centroids by the extents of an ellipse of drawn errors (never negative), and draws errors of width and length (of the box's corners only)."""
    along, across = F.col("distance_error") * S.normal(seed, "along", *keys), F.col("radial_error") * S.normal(seed, "across", *keys)
    rows = pairs.withColumns(dict(zip(("_c00", "_c01", "_c11"), G.turned_covariance(along * along, across * across, F.col("bearing")), strict=True)))
    dx, dy = G.extents(F.col("_c00"), F.col("_c01"), F.col("_c11"))
    return rows.withColumns(
        {"cx": F.col("cx") + dx, "cy": F.col("cy") + dy, "box_width": F.col("width") + F.col("bbox_error") * S.normal(seed, "width", *keys), "box_length": F.col("length") + F.col("bbox_error") * S.normal(seed, "length", *keys)}
    ).drop("_c00", "_c01", "_c11")


def numbered(detections: DataFrame, order: str = "det_ord") -> DataFrame:
    """detection_id: the truth id and the row's number among those of its platform, sensor and frame."""
    w = Window.partitionBy("run_id", "frame", "platform_id", "sensor_idx").orderBy(order)
    return detections.withColumn("detection_id", F.concat_ws("_", "truth_id", F.row_number().over(w) - 1))


def _offsets(seed: int, name: str, drawn: Column, *keys: str) -> dict[str, Column]:
    draw = lambda c, most: F.when(drawn, S.between(-most, most, S.uniform(seed, f"{name}.{c}", *keys))).otherwise(0.0)
    return {"dx": F.col("dx") + draw("x", SHIFT), "dy": F.col("dy") + draw("y", SHIFT), "dyaw": F.col("dyaw") + draw("yaw", TURN)}


def extrinsics_fault(sensors: DataFrame, seed: int, single: bool) -> DataFrame:
    """With the run's probability, one sensor of a platform (the one of least draw) or all of them are off by up to a metre and 0.17 rad; all by the same."""
    hit = S.uniform(seed, "fault", "run_id", "platform_id") < F.col("probability")
    if not single:
        return sensors.withColumns(_offsets(seed, "all", hit, "run_id", "platform_id"))
    w = Window.partitionBy("run_id", "platform_id").orderBy(S.uniform(seed, "pick", "run_id", "platform_id", "sensor_idx"), "sensor_idx")
    rows = sensors.withColumn("_pick", F.row_number().over(w) == 1)
    return rows.withColumns(_offsets(seed, "one", hit & F.col("_pick"), "run_id", "platform_id")).drop("_pick")


def localization_fault(poses: DataFrame, seed: int) -> DataFrame:
    """With the run's probability a frame's pose is off, by an offset that the probability also scales."""
    keys = ("run_id", "platform_id", "frame")
    hit = S.uniform(seed, "fault", *keys) < F.col("probability")
    off = lambda c, most: F.when(hit, S.between(-most, most, S.uniform(seed, f"pose.{c}", *keys)) * F.col("probability")).otherwise(0.0)
    return poses.withColumns({"x": F.col("x") + off("x", SHIFT), "y": F.col("y") + off("y", SHIFT), "yaw": F.col("yaw") + off("yaw", TURN)})


SENSOR_FRAME = ("run_id", "frame", "platform_id", "sensor_idx")


def _struck(seed: int) -> Column:
    """Both draws of a fault, as injecting and each fault draw once."""
    return (S.uniform(seed, "inject", *SENSOR_FRAME) < F.col("probability")) & (S.uniform(seed, "fault", *SENSOR_FRAME) < F.col("probability"))


def removal_fault(detections: DataFrame, seed: int) -> DataFrame:
    """Drops one detection, that of least draw, of each struck sensor frame."""
    w = Window.partitionBy(*SENSOR_FRAME).orderBy(S.uniform(seed, "victim", *SENSOR_FRAME, "det_ord"), "det_ord")
    return detections.withColumn("_n", F.row_number().over(w)).where(~(_struck(seed) & (F.col("_n") == 1))).drop("_n")


def fake_rows(frames: DataFrame, seed: int, region: tuple[float, float] | None = None) -> DataFrame:
    """One made-up detection for each struck sensor frame; within a square where a region is given."""
    draw = lambda name, low, high: S.between(low, high, S.uniform(seed, f"fake.{name}", *SENSOR_FRAME))
    low, high = region or (-100.0, 100.0)
    return frames.where(_struck(seed)).withColumns(
        {
            "detection_id": F.concat(F.lit("fake_"), (100000 + F.floor(S.uniform(seed, "fake.id", *SENSOR_FRAME) * 900000)).cast("string")),
            "cx": draw("x", low, high), "cy": draw("y", low, high), "width": draw("w", 1.5, 2.5), "length": draw("l", 3.0, 5.0), "angle": draw("angle", 0.0, 2 * math.pi),
            "vx": draw("vx", -5.0, 5.0), "vy": draw("vy", -5.0, 5.0), "c00": draw("c00", 0.1, 0.5), "c11": draw("c11", 0.1, 0.5),
        }
    )


def dispatched_poses(platforms: DataFrame, sensors: DataFrame, runs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The platforms' poses and their own sensors under each run's fault: poses of localization runs, one or all sensors of a platform of extrinsics runs, others as they are."""
    of = lambda *kinds: F.when(F.col("error_type").isin(*kinds), F.col("_level")).otherwise(0.0)
    rows = platforms.join(runs.select("run_id", "error_type", F.col("probability").alias("_level")), "run_id")
    poses = localization_fault(rows.withColumn("probability", of("LOCALIZATION")), seed).drop("error_type", "_level", "probability")
    own = rows.select("run_id", "platform_id", "kind", "error_type", "_level").distinct().join(F.broadcast(sensors), "kind")  # a row for each sensor of a kind
    own = extrinsics_fault(own.withColumn("probability", of("SINGLE_SENSOR_EXTRINSICS")), seed, single=True)
    own = extrinsics_fault(own.withColumn("probability", of("MULTI_SENSOR_EXTRINSICS")), seed, single=False)
    return poses, own.drop("error_type", "_level", "probability")


def dispatched(detections: DataFrame, runs: DataFrame, seed: int) -> DataFrame:
    """Each run's own fault on its detections: removal, addition anywhere or in the region, or none. Faults of poses and sensors are in the detections already; see dispatched_poses."""
    rows = detections.join(runs, "run_id")
    kind = F.col("error_type")
    kept = removal_fault(rows.where(kind == "MALICIOUS_REMOVAL"), seed).unionByName(rows.where(kind != "MALICIOUS_REMOVAL"))
    frames = rows.select(*SENSOR_FRAME, "error_type", "probability").distinct()
    fakes = fake_rows(frames.where(kind == "MALICIOUS_ADDITION"), seed).unionByName(fake_rows(frames.where(kind == "MALICIOUS_CONVOY"), seed, (20.0, 40.0)))
    return kept.unionByName(fakes, allowMissingColumns=True)
