"""Streams give what the batch jobs give."""

import pytest
from pyspark.sql import functions as F

from waymesh.operators import tracking
from waymesh.plans import perception, tracks, views
from waymesh.sources import catalogs, telemetry
from waymesh.streaming import live

SF = "/root/testdata/sf0.001"


def run(stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return query


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_tracker_on_a_stream(spark, tmp_path, rocks):
    rows = tracks.platform_detections(spark, SF).where("tracker_id < 10")
    upto = rows.agg(F.max("frame")).first()[0]
    # One file a slice of frames, in order; a last frame later on lets the watermark pass all others.
    parts = rows.withColumn("part", F.floor(F.col("frame") / 20)).cache()
    for k in sorted(r.part for r in parts.select("part").distinct().collect()):
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = parts.drop("part").limit(1).withColumn("frame", F.lit(upto + 1000).cast("int")).withColumn("tracker_id", F.lit(77).cast("long"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = telemetry.with_time(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")))
    run(live.live_tracks(stream), "tracks", tmp_path)
    columns = ["run_id", "tracker_id", "frame", "track_id", "x", "y", "c00", "dx", "n_meas"]
    got = spark.table("tracks").where("tracker_id <> 77").select(*columns).collect()
    want = tracking.tracks(rows).select(*columns).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_counts_on_a_stream(spark, tmp_path):
    pairs = perception._pairs(spark, SF).crossJoin(catalogs.envelopes(spark).where("category = 'Aggressive'"))
    pairs.withColumn("part", F.floor(F.col("frame") / 25)).repartition(1).sortWithinPartitions("frame").drop("part").write.parquet(str(tmp_path / "in"))
    end = pairs.limit(1).withColumn("frame", F.lit(100_000).cast("int"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = telemetry.with_time(spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in")))
    run(live.live_violations(stream), "counts", tmp_path)
    got = {(r.run_id, r.frame, r.ego_id): (r.envelope, r.ttc) for r in spark.table("counts").collect()}
    want = {(r.run_id, r.frame, r.ego_id): (r.envelope_truth, r.ttc_truth) for r in perception._counts(spark, SF).collect() if r.envelope_truth or r.ttc_truth}
    assert {k: v for k, v in got.items() if k[1] < 100_000 and any(v)} == want


def test_views_have_event_time(spark):
    row = telemetry.with_time(views.raw(spark, SF).where("frame = 3").limit(1)).first()
    assert row.ts.timestamp() == pytest.approx(0.4)


def files(rows, path, size, order="frame"):
    """Rows as one file for each slice of frames, in order."""
    parts = rows.withColumn("part", F.floor(F.col(order) / size)).cache()
    for k in sorted(r.part for r in parts.select("part").distinct().collect()):
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(path))


def test_late_rows_are_kept_and_counted(spark, tmp_path, rocks):
    rows = tracks.platform_detections(spark, SF).where("tracker_id < 10 AND frame < 120").cache()
    files(rows, tmp_path / "in", 40)
    # Detections of frames that are over by now, for a tracker that has seen frames since; then a last frame.
    late = rows.where("batch_ord IS NOT NULL AND frame BETWEEN 10 AND 14").cache()
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = rows.limit(1).withColumn("frame", F.lit(5000)).withColumn("tracker_id", F.lit(77).cast("long"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = telemetry.with_time(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run(live.live_rows(stream, late="500 milliseconds"), "rows", tmp_path)
    got = spark.table("rows").where("tracker_id <> 77")
    kept = got.where("late")
    assert sorted((r.run_id, r.tracker_id, r.frame, round(r.x, 9), round(r.c00, 9)) for r in kept.collect()) == sorted((r.run_id, r.tracker_id, r.frame, round(r.cx, 9), round(r.c00, 9)) for r in late.collect())
    columns = ["run_id", "tracker_id", "frame", "track_id", "x", "y", "n_meas"]
    want = tracking.tracks(rows).select(*columns).collect()
    assert want and sorted(map(tuple, got.where("NOT late").select(*columns).collect())) == sorted(map(tuple, want))


def test_options_of_the_tracker_on_a_stream(spark, tmp_path, rocks):
    rows = tracks.platform_detections(spark, SF).where("tracker_id < 3 AND frame < 60").cache()
    files(rows, tmp_path / "in", 30)
    rows.limit(1).withColumn("frame", F.lit(5000)).withColumn("tracker_id", F.lit(77).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = telemetry.with_time(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run(live.live_tracks(stream, compat=False, mode=0, distance="gated_euclidean"), "options", tmp_path)
    columns = ["run_id", "tracker_id", "frame", "track_id", "x", "y"]
    want = tracking.tracks(rows, compat=False, mode=0, distance="gated_euclidean").select(*columns).collect()
    assert want and sorted(map(tuple, spark.table("options").where("tracker_id <> 77").select(*columns).collect())) == sorted(map(tuple, want))


def test_presence_and_attributes_on_a_stream(spark, tmp_path, rocks):
    rows = views.raw(spark, SF).where("event_type <> 'error'").select(*(c.split()[0] for c in telemetry.TELEMETRY.split(", "))).cache()
    files(rows, tmp_path / "in", 25)
    rows.limit(1).withColumn("frame", F.lit(90_000)).withColumn("object_id", F.lit("end")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(live.live_objects(telemetry.read_stream(spark, str(tmp_path / "in"), files_a_batch=3)), "objects", tmp_path)
    got = spark.table("objects").where("object_id <> 'end'")
    changed = {(r.run_id, r.frame, r.object_id, r.arrived, r.departed) for r in got.where("arrived OR departed").collect()}
    assert changed == {tuple(r) for r in perception.arrivals_departures(spark, SF).select("run_id", "frame", "object_id", "arrived", "departed").collect()}
    from waymesh.operators import truth

    want = rows.select("run_id", "frame", "object_id").join(truth.static_attributes(rows), ["run_id", "object_id"]).select("run_id", "frame", "object_id", "object_type", "length", "width")
    assert sorted(map(tuple, got.drop("arrived", "departed").collect())) == sorted(map(tuple, want.collect()))


def test_a_sink_that_is_restarted(spark, tmp_path, rocks):
    """A batch that was written when the query died is run again, and stands once."""
    rows = tracks.platform_detections(spark, SF).where("tracker_id < 10 AND frame < 50").cache()
    files(rows, tmp_path / "in", 12)
    rows.limit(1).withColumn("frame", F.lit(5000)).withColumn("tracker_id", F.lit(77).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    written = []

    def die(batch):
        written.append(batch)
        if len(written) == 3:
            raise RuntimeError("stopped after writing")

    def start(done):
        stream = telemetry.with_time(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        return telemetry.stream_tracks(live.live_tracks(stream), str(tmp_path / "out"), str(tmp_path / "state"), done)

    with pytest.raises(Exception, match="stopped after writing"):
        start(die).awaitTermination(240)
    start(written.append).awaitTermination(240)
    assert written.count(written[2]) == 2  # that batch was written twice
    columns = ["run_id", "tracker_id", "frame", "track_id", "x", "y"]
    got = spark.read.parquet(str(tmp_path / "out")).where("tracker_id <> 77").select(*columns).collect()
    want = tracking.tracks(rows).select(*columns).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))
