"""Queries on tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymesh import scratch
from waymesh.functions import kinematics as K
from waymesh.operators import tracking

from . import views as V
from . import perception
from .registry import query

#: Sites' trackers are numbered from here; one more is the tracker of all platforms.
SITES, EVERYWHERE = 1000, 9999


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as trackers take them, with the sensor that made them and the probability it had to."""
    sensor = F.concat_ws("/", "platform_id", "sensor_idx")
    return V.measured(spark, sf_dir).withColumns({"det_ord": F.col("slot"), "sensor_id": sensor, "confidence": F.least("probability", F.lit(1.0))})


def _platform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).withColumns({"tracker_id": _number(), "batch_ord": F.col("sensor_idx")})


def _number() -> Column:
    return K.integer_in(F.col("platform_id")) + F.when(F.col("kind") == "CIS", SITES).otherwise(0)


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.platforms(spark, sf_dir).withColumn("tracker_id", _number()).select("run_id", "tracker_id", "frame", "t")


def platform_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each platform's batches, one a sensor, and its frames without any."""
    return tracking.with_calendar(_platform_rows(spark, sf_dir), _calendar(spark, sf_dir))


def global_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measured(spark, sf_dir).withColumn("tracker_id", F.lit(EVERYWHERE).cast("long"))
    calendar = V.raw(spark, sf_dir).select("run_id", F.lit(EVERYWHERE).cast("long").alias("tracker_id"), "frame", "t").distinct()
    return tracking.with_calendar(rows, calendar, batches=perception.batch_order())


@query()
def platform_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.tracks(platform_detections(spark, sf_dir))


@query()
def global_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.tracks(global_detections(spark, sf_dir), cleanup=0.5)


@query()
def global_track_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Global rows of frame_metrics with the fused tracks of all platforms as what is seen; tracks stand for objects of their own, so that an ego's own track counts."""
    tracks = tracking.tracks(global_detections(spark, sf_dir), cleanup=0.5)
    seen = tracks.select("run_id", "frame", F.col("track_id").cast("string").alias("object_id"), (F.col("track_id") % tracking.IDS).cast("int").alias("det_ord"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("dx").alias("vx"), F.col("dy").alias("vy"), "width", "length")
    return perception.global_metrics(spark, sf_dir, scratch.written(seen, "seen"))


@query()
def kalman_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform tracks that start at their detections and pair one to one."""
    return tracking.tracks(platform_detections(spark, sf_dir), compat=False)


@query()
def track_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.lifetimes(tracking.tracks(platform_detections(spark, sf_dir)))


@query()
def track_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sensors of each platform's tracks agree with them, and with which confidence they measured."""
    rows = scratch.written(_platform_rows(spark, sf_dir), "measured")
    return tracking.consistency(*tracking.with_members(tracking.with_calendar(rows, _calendar(spark, sf_dir))), rows)


@query()
def track_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of all platforms together that nearly coincide, and which of two is to go."""
    return tracking.twins(tracking.tracks(global_detections(spark, sf_dir), cleanup=0.5))
