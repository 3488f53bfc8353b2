"""What queries shuffle and leave on disk on their way."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh import scratch
from waymesh.operators import safety, scoring, tracking as T
from waymesh.plans import perception, registry, tracks as plans, views
from waymesh.sources import catalogs

SF = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_what_was_shuffled_for_a_table_is_freed(spark):
    before = shuffle_files(spark)
    with scratch.cleaned(spark):
        rows = scratch.written(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "freed")
        for _ in range(100):  # files are removed in the background
            if not shuffle_files(spark) - before:
                break
            time.sleep(0.1)
        assert not shuffle_files(spark) - before
        assert rows.count() == 7
    assert spark.conf.get(scratch._FREED) == "false"


def test_boxes_of_a_join_are_spread_little(spark):
    rng = np.random.default_rng(9)
    rows = [(1, *map(float, r)) for r in rng.uniform(-2000, 2000, (2000, 2))]
    cars = spark.createDataFrame(rows, "k int, a_x double, a_y double").withColumns({"a_w": F.lit(1.8), "a_l": F.lit(4.5)})
    assert scoring._spread(cars, "a").count() < 1.5 * len(rows)


def test_rows_of_trackers_are_dealt_once(spark):
    plan = T.tracks(plans.global_detections(spark, SF), cleanup=0.5)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(run_id#\d+, tracker_id#\d+L?, \d", plan)) == 1
    assert not re.findall(r"Exchange hashpartitioning\(run_id#\d+, (?:tracker_id#\d+L?, )?frame#\d+, \d", plan)


def tables(df):
    """Names of the written tables and files that a result still reads."""
    return {f.split("/")[-2].split("-")[0] if "-" in f.split("/")[-2] else f.split("/")[-1] for f in df.inputFiles()}


def settled(spark, before):
    for _ in range(100):
        if not shuffle_files(spark) - before:
            return True
        time.sleep(0.1)
    return False


@pytest.mark.parametrize("name", ["frame_metrics", "run_totals", "totals_long"])
def test_reports_count_in_steps(spark, name):
    """What each platform sees is counted and scored by then, a step after the other, and the steps' own tables are gone."""
    before = shuffle_files(spark)
    with scratch.cleaned(spark):
        since = len(scratch._open)
        df = registry.QUERIES[name](spark, SF)
        assert settled(spark, before)
        assert "own" in tables(df) and "sightings" not in tables(df)
        left = [p.split("/")[-1].split("-")[0] for p in scratch._open[since:]]
        assert left.count("truth") == 1  # of all platforms together; each one's own has been counted


def test_own_sides_are_dealt_once(spark):
    """Truth and detections of a platform are one row of one exchange, and the same rows as each for itself."""
    with scratch.cleaned(spark):
        sightings = views.sightings(spark, SF)
        sides = perception._own_sides(sightings)
        assert len(re.findall(r"Exchange hashpartitioning\(", sides._jdf.queryExecution().executedPlan().toString())) == 1
        columns = [*perception.EGO, "object_id", "cx", "cy", "vx", "vy"]
        for side, want in (("truth", perception._truth_of(sightings, perception.EGO)), ("seen", perception._seen_by_each(sightings))):
            got = sides.where(F.col("side") == side).select(*columns)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_counts_of_each_platform_shuffle_objects_once(spark):
    with scratch.cleaned(spark):
        sightings = views.sightings(spark, SF)
        egos = perception._as_egos(views.platforms(spark, SF))
        counts = safety.violations(egos.drop("kind"), perception._own_sides(sightings), perception.EGO, catalogs.envelopes(spark).where("category = 'Aggressive'"))
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert not re.findall(r"Exchange hashpartitioning\([^\n]*(side|_rx|_packet)", plan)


def test_scores_write_no_covariances(spark):
    with scratch.cleaned(spark):
        since = len(scratch._open)
        registry.QUERIES["detection_f1"](spark, SF)
        written = {p.split("/")[-1].split("-")[0]: p for p in scratch._open[since:]}
        assert not {"c00", "c01", "c11"} & set(spark.read.parquet(written["sightings"]).columns)


def test_metrics_of_tracks_write_no_sightings(spark):
    with scratch.cleaned(spark):
        since = len(scratch._open)
        df = registry.QUERIES["global_track_metrics"](spark, SF)
        assert {p.split("/")[-1].split("-")[0] for p in scratch._open[since:]} == {"seen", "truth", "pairs"}
        assert df.where("f1 > 0").count() > 0


def written_for(spark, name):
    since = len(scratch._open)
    df = registry.QUERIES[name](spark, SF)
    return df, {p.split("/")[-1].split("-")[0] for p in scratch._open[since:]}


def test_mean_scores_count_no_violations(spark):
    with scratch.cleaned(spark):
        df, names = written_for(spark, "mean_f1")
        assert "scores" in names and "own" not in names
        assert "members" not in df._jdf.queryExecution().optimizedPlan().toString()  # of packets, of the Global counts


def test_progress_needs_no_scores(spark):
    with scratch.cleaned(spark):
        _, names = written_for(spark, "progress_report")
        assert "own" in names and not {"scores", "pairs"} & names
