"""Telemetry tables and streams, sites, and the sinks of reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

TELEMETRY = "run_id int, frame int, t double, object_id string, object_type string, front_x double, front_y double, speed double, angle_deg double, length double, width double"
FRAMES_A_RUN, SLOTS = 200, 20
#: Milliseconds of a frame, and of the first one: not the epoch, where a stream's first watermark stands and after which rows must come.
FRAME_MS, FIRST_MS = 100, 100


def read(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Telemetry in parquet, csv (with a header) or json."""
    return spark.read.schema(TELEMETRY).options(**({"header": "true"} if kind == "csv" else {})).format(kind).load(path)


def read_stream(spark: SparkSession, path: str, kind: str = "parquet", files_a_batch: int = 1) -> DataFrame:
    """The same as a stream, with the event time ts taken from the integer frame."""
    rows = spark.readStream.schema(TELEMETRY).option("maxFilesPerTrigger", files_a_batch).format(kind).load(path)
    return with_time(rows)


def with_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_millis(F.col("frame").cast("long") * FRAME_MS + FIRST_MS))


def from_events(events: DataFrame) -> DataFrame:
    """The telemetry that an event table stands for: twenty objects a frame, which move along wrapping tracks. event_type and value stay."""
    event = F.col("event_id")
    slot, frame = (event % SLOTS).cast("int"), F.floor(event / SLOTS).cast("int")
    lap = 1 + slot % 7
    return events.select(
        F.floor(event / (SLOTS * FRAMES_A_RUN)).cast("int").alias("run_id"),
        frame.alias("frame"),
        (frame / F.lit(10.0)).alias("t"),
        slot.alias("slot"),
        F.concat(F.lit("veh"), slot.cast("string")).alias("object_id"),
        F.when(slot % 4 == 3, "truck").otherwise("veh_passenger").alias("object_type"),
        (((slot * 37 + frame * lap) % 400) / F.lit(4.0)).alias("front_x"),
        (((slot * 53) % 100) / F.lit(2.0)).alias("front_y"),
        (lap * F.lit(2.5)).alias("speed"),
        (slot * F.lit(18.0)).alias("angle_deg"),
        F.lit(4.5).alias("length"),
        F.lit(1.8).alias("width"),
        "event_type",
        "value",
    )


def sites_from_regions(regions: DataFrame) -> DataFrame:
    """Raw fixed sites: an id as the map names it, a junction, a place."""
    key = F.col("r_regionkey")
    name = F.when(key == 4, F.concat(F.lit("GS_joined_"), key.cast("string"))).otherwise(F.concat(F.lit("GS_"), key.cast("string")))
    return regions.select(name.alias("site_id"), F.concat(F.lit("J"), key.cast("string")).alias("junction_id"), (F.lit(20.0) * key).alias("x"), F.lit(25.0).alias("y"))


def site_junctions(sites: DataFrame, junctions: DataFrame | None = None) -> DataFrame:
    """Sites that are not joined ones, without their prefix, at their junction's place (their own where none is given)."""
    rows = sites.where(~F.contains("site_id", F.lit("joined"))).withColumn("site_id", F.regexp_replace("site_id", "^GS_", ""))
    if junctions is None:
        return rows
    return rows.drop("x", "y").join(junctions, "junction_id")


def write_totals(totals: DataFrame, path: str) -> None:
    """The long report as CSV with a header."""
    totals.write.mode("overwrite").option("header", True).csv(path)


def write_tracks(tracks: DataFrame, path: str) -> None:
    """Tracks by run; the runs that are written replace theirs, other runs stay."""
    tracks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def stream_tracks(tracks: DataFrame, path: str, checkpoint: str, done: Callable[[int], None] | None = None, **trigger: object) -> StreamingQuery:
    """A stream of tracks into a table by micro-batch and run, each row once.

    A micro-batch that is run again after a failure has the same rows and replaces its own
    partitions, so that nothing is lost and nothing doubles. done is called after a batch is written."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch_id", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "run_id").parquet(path)
        if done is not None:
            done(batch)

    return tracks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def alive(events_telemetry: DataFrame) -> Column:
    """Whether an object of the fixture is present in a frame."""
    return events_telemetry["event_type"] != "error"
