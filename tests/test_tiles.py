"""One tracker over several tasks gives the rows of one task."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh import scratch
from waymesh.operators import tiles, tracking as T
from waymesh.plans import tracks as plans

SF = "/root/testdata/sf0.001"
SCHEMA = "run_id int, tracker_id long, frame int, t double, batch_ord int, det_ord int, cx double, cy double, width double, length double, angle double, c00 double, c01 double, c11 double, trust double"


def scene(seed, groups, size, frames, away=1000.0, wide=900):
    """Groups of objects that drive about near each other, far from other groups now and then; with misses and empty frames."""
    rng = np.random.default_rng(seed)
    place = rng.uniform(0, wide, (groups, 1, 2)) + rng.uniform(-40, 40, (groups, size, 2)) + away
    speed = rng.uniform(-18, 18, (groups, 1, 2)) + rng.normal(0, 1, (groups, size, 2))
    rows = []
    for f in range(frames):
        place = place + 0.1 * speed
        seen = 0
        for b in range(2):
            for k, (x, y) in enumerate(place.reshape(-1, 2)):
                if f % 17 != 5 and rng.random() < 0.8 and (k + b) % 3:
                    rows.append((0, 5, f, f / 10, b, k, float(x + rng.normal(0, 0.1)), float(y + rng.normal(0, 0.1)), 1.8, 4.5, 0.3, 0.05, 0.0, 0.06, 1.0))
                    seen += 1
        if not seen:
            rows.append((0, 5, f, f / 10, *[None] * 10, 1.0))
    return rows


def same(found, want):
    a, b = (sorted(map(tuple, df.collect())) for df in (found, want))
    assert len(a) == len(b) and a
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and np.allclose(x[5:], y[5:], rtol=1e-9, atol=1e-9), (x, y)


@pytest.mark.parametrize("compat", [True, False])
def test_components_give_the_rows_of_one_task(spark, compat):
    df = spark.createDataFrame(scene(3, 6, 5, 70), SCHEMA).repartition(3)
    with scratch.cleaned(spark):
        same(tiles.tracks(df, 0.5, compat, block=25), T.tracks(df, 0.5, compat))


def test_a_scene_about_the_origin_and_several_trackers(spark):
    rows = plans.global_detections(spark, SF).where("run_id = 0 AND frame < 14")
    other = rows.withColumns({"tracker_id": F.lit(3).cast("long"), "cx": F.col("cx") * 9 + 400, "cy": F.col("cy") * 9 + 400})
    both = rows.unionByName(other).cache()
    with scratch.cleaned(spark):
        same(tiles.tracks(both, 0.5, block=7), T.tracks(both, 0.5))
        assert tiles.tracks(both.where("false")).collect() == []


def test_components_meet_and_part(spark):
    """Two objects that drive through each other: one component where they meet, two before and after."""
    rows = []
    for f in range(60):
        for k, x in enumerate((100 + 3.0 * f, 280 - 3.0 * f)):
            rows.append((0, 1, f, f / 10, 0, k, x, 50.0 + 0.4 * k, 1.8, 4.5, 0.0, 0.05, 0.0, 0.05, 1.0))
    df = spark.createDataFrame(rows, SCHEMA)
    with scratch.cleaned(spark):
        same(tiles.tracks(df, 0.3, False, block=10), T.tracks(df, 0.3, False))


def test_touching_components_are_joined():
    from collections import namedtuple

    Pair = namedtuple("Pair", "run_id tracker_id component other")
    one = tiles._joined({}, [Pair(0, 1, 5, 3), Pair(0, 1, 9, 5), Pair(0, 2, 5, 7)])
    assert one == {(0, 1, 3): 3, (0, 1, 5): 3, (0, 1, 9): 3, (0, 2, 5): 5, (0, 2, 7): 5}
    assert tiles._joined(one, [Pair(0, 1, 3, 1)])[0, 1, 9] == 1
    assert tiles._labels(np.array([0, 1, 1, 2, 3]), np.array([0, 0, 1, 1, 2]), 4).tolist() == [0, 0, 0, 3]


if __name__ == "__main__":  # seconds of one task and of components
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    frame = session.createDataFrame(scene(1, 16, 50, 120, 5000.0, 4000), SCHEMA).repartition(8).cache()
    print(frame.count(), "rows")
    T.tracks(frame.limit(9), 0.5).count()
    for name, run in (("one task", lambda: T.tracks(frame, 0.5, False)), ("components", lambda: tiles.tracks(frame, 0.5, False, block=60))):
        begin = time.perf_counter()
        n = run().count()
        print(name, n, "rows in", round(time.perf_counter() - begin, 1), "s", flush=True)
