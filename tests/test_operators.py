"""Goldens and properties of the perception operators."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from waymesh.functions import geometry as G, kinematics as K
from waymesh.operators import report, safety, scoring, sensing, tracking
from waymesh.sources import catalogs, telemetry


@pytest.mark.parametrize(
    "others,category,expected",
    [([(200, 200), (300, 300)], "Aggressive", 0), ([(105, 100), (300, 300)], "Aggressive", 1), ([(105, 100), (110, 100)], "Aggressive", 2), ([(105, 100), (300, 300)], "Conservative", 1)],
)
def test_envelope_goldens(spark, others, category, expected):
    ego = spark.createDataFrame([(1, "veh1", 100.0, 100.0, 0.0, 0.0, 0.0)], "frame int, ego_id string, x double, y double, yaw double, evx double, evy double")
    rows = [(1, f"veh{i + 2}", float(x), float(y), 0.0, 0.0) for i, (x, y) in enumerate(others)] + [(1, "veh1", 100.0, 100.0, 0.0, 0.0)]
    pairs = safety.ego_pairs(ego, spark.createDataFrame(rows, "frame int, object_id string, cx double, cy double, vx double, vy double"), ["frame"])
    found = safety.counts(pairs, ego.select("frame", "ego_id"), ["frame", "ego_id"], catalogs.envelopes(spark).where(F.col("category") == category)).first()
    assert (found.envelope, found.ttc) == (expected, 0)


def test_time_to_collision(spark):
    rows = spark.createDataFrame([(5.0, 10.0), (5.0, 0.0), (5.0, -10.0), (-5.0, -10.0), (20.0, 10.0)], "dlong double, vlong double")
    assert [r[0] for r in rows.select(safety.will_collide()).collect()] == [True, False, False, True, False]
    assert [r[0] for r in rows.select(safety.will_collide(closing_only=True)).collect()] == [False, False, False, True, False]


boxes = st.tuples(st.floats(-5, 5), st.floats(-5, 5), st.floats(0.5, 6), st.floats(0.5, 6), st.floats(-4, 4))


@settings(max_examples=60, deadline=None)
@given(boxes, boxes, st.floats(-4, 4))
def test_iou_properties(a, b, turn):
    one, two = np.array([a]), np.array([b])
    iou = G.iou_of(one, two)[0]
    assert 0 <= iou <= 1 + 1e-9 and abs(iou - G.iou_of(two, one)[0]) < 1e-7
    assert abs(G.iou_of(one, one)[0] - 1) < 1e-9

    def turned(x):
        c, s = math.cos(turn), math.sin(turn)
        return np.array([[x[0] * c - x[1] * s, x[0] * s + x[1] * c, x[2], x[3], x[4] + turn]])

    assert abs(iou - G.iou_of(turned(a), turned(b))[0]) < 1e-6
    flipped = two + np.array([0, 0, 0, 0, math.pi])
    assert abs(iou - G.iou_of(one, flipped)[0]) < 1e-6


def test_iou_against_a_grid():
    rng = np.random.default_rng(4)
    a, b = (np.column_stack((rng.uniform(-1, 1, (20, 2)), rng.uniform(1, 3, (20, 2)), rng.uniform(-3, 3, 20))) for _ in range(2))
    xs = np.stack(np.meshgrid(np.linspace(-4, 4, 600), np.linspace(-4, 4, 600)), axis=-1).reshape(-1, 2)

    def inside(box):
        d = xs - box[:2]
        u, v = d @ [math.cos(box[4]), math.sin(box[4])], d @ [-math.sin(box[4]), math.cos(box[4])]
        return (abs(u) <= box[2] / 2) & (abs(v) <= box[3] / 2)

    for i, iou in enumerate(G.iou_of(a, b)):
        p, q = inside(a[i]), inside(b[i])
        assert abs(iou - (p & q).sum() / (p | q).sum()) < 0.02


def test_ellipse_equals_eigenvalues(spark):
    rng = np.random.default_rng(5)
    m = [x @ x.T for x in rng.normal(size=(50, 2, 2))]
    df = spark.createDataFrame([(float(x[0, 0]), float(x[0, 1]), float(x[1, 1])) for x in m], "c00 double, c01 double, c11 double")
    got = df.select(*G.ellipse(F.col("c00"), F.col("c01"), F.col("c11"), 1.0, deviation=False)).collect()
    for x, (a, b, phi) in zip(m, got, strict=True):
        values, vectors = np.linalg.eigh(x)
        assert np.allclose([b, a], values, atol=1e-12)
        assert abs(abs(vectors[:, 1] @ [math.cos(phi), math.sin(phi)]) - 1) < 1e-9


def test_range_join_equals_brute_force(spark):
    rng = random.Random(6)
    sensors = [(f, f"p{i}", rng.uniform(-60, 60), rng.uniform(-60, 60)) for f in range(5) for i in range(6)]
    objects = [(f, f"o{i}", rng.uniform(-60, 60), rng.uniform(-60, 60)) for f in range(5) for i in range(40)]
    got = sensing.within_range(spark.createDataFrame(sensors, "frame int, platform_id string, x double, y double"), spark.createDataFrame(objects, "frame int, object_id string, cx double, cy double"), 15.0, ("frame",)).collect()
    want = {(f, p, o) for f, p, x, y in sensors for g, o, cx, cy in objects if f == g and math.sqrt((cx - x) ** 2 + (cy - y) ** 2) <= 15}
    assert {(r.frame, r.platform_id, r.object_id) for r in got} == want and len(got) == len(want)


def test_greedy_matching_equals_the_double_loop(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for f in range(60):
        iou = {(d, g): rng.random() for d in range(rng.randint(1, 6)) for g in range(rng.randint(1, 6))}
        rows += [(f, d, g, v) for (d, g), v in iou.items()]
        taken = set()
        for d in sorted({d for d, _ in iou}):
            for g in sorted({g for _, g in iou}):
                if iou.get((d, g), 0) > 0.5 and g not in taken:
                    taken.add(g)
                    break
        want[f] = len(taken)
    got = {r.frame: r.matches for r in scoring.greedy_matches(spark.createDataFrame(rows, "frame int, det_ord int, gt_ord int, iou double"), ["frame"]).collect()}
    assert {f: n for f, n in want.items() if n} == got


def test_polynomial_and_ids(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2.0, "GS_12_3"), ([], 2.0, "none")], "c array<double>, x double, name string")
    assert [tuple(r) for r in df.select(K.polynomial(F.col("c"), F.col("x")), K.polynomial([1, 2, 3], F.col("x")), K.integer_in(F.col("name"))).collect()] == [(17.0, 17.0, 12), (0.0, 17.0, None)]


def test_totals_are_written(spark, tmp_path):
    totals = spark.createDataFrame([(0, "CAV", 3, 1.5)], "run_id int, source string, hits long, f1_sum double")
    long = report.long_totals(totals, catalogs.sweep(spark, ["NONE"], [0]))
    telemetry.write_totals(long, str(tmp_path / "t"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "t")).collect()
    assert sorted((r.error_type, r.metric, float(r.total)) for r in rows) == [("NONE", "CAV f1_sum", 1.5), ("NONE", "CAV hits", 3.0)]


def det(x, y, var=0.01):
    return np.array([x, y, 2.0, 4.0, 0.0, var, 0.0, var])


def test_a_track_by_hand():
    t = tracking.Tracker(7)
    shown = []
    for k in range(8):
        t.observe(k / 10, np.array([det(10.0, 5.0)]))
        shown.append(t.fuse(k / 10))
    assert [len(s) for s in shown] == [0, 0, 0, 0, 1, 1, 1, 1]  # shown after more than four steps
    assert shown[-1][0][0] == 70000 and np.allclose(shown[-1][0][1:3], [10, 5], atol=1e-6) and shown[-1][0][11] == 1
    t.observe(0.99, np.zeros((0, 8)))
    assert t.ids == [70000]  # last seen at 0.7, kept for less than 0.3 s
    t.observe(1.0, np.zeros((0, 8)))
    assert t.ids == []


def test_second_batch_of_the_birth_frame():
    for compat, n in ((True, 2), (False, 1)):
        t = tracking.Tracker(1, compat=compat)
        t.observe(0.0, np.array([det(10.0, 5.0)]))
        t.observe(0.0, np.array([det(10.1, 5.0)]))
        assert len(t.ids) == n


def test_first_fusion_of_two_measurements():
    old, new = tracking.Tracker(1, compat=True), tracking.Tracker(1, compat=False)
    group = [det(10.0, 5.0, 0.5), det(11.0, 5.0, 0.25)]
    z, c = old._first(group)
    assert np.allclose(c, np.eye(2) * 0.75) and np.allclose(z, 0.75 * np.array([0.5 * 10 + 0.25 * 11, 0.75 * 5]))
    z, c = new._first(group)
    assert np.allclose(c, np.eye(2) / 6) and np.allclose(z, [(2 * 10 + 4 * 11) / 6, 5])


def test_claims():
    t = tracking.Tracker(1)
    pairs, known = t._matches(np.array([[0.3, 0.4, 1.0], [0.2, 1.0, 1.0], [0.45, 1.0, 1.0]]))
    assert sorted(pairs) == [(1, 0), (2, 0)] and known == {0, 1}  # a detection that was taken over is free for later tracks
    assert sorted(tracking.Tracker(1, compat=False)._matches(np.array([[0.3, 0.4, 1.0], [0.2, 1.0, 1.0]]))[0]) == [(0, 1), (1, 0)]


@pytest.mark.parametrize("mode", [0, 1, 2])
def test_constant_speed_is_followed(mode):
    t = tracking.Tracker(1, compat=False, mode=mode)
    for k in range(40):
        t.observe(k / 10, np.array([det(10.0 + 0.5 * k, 5.0)]))
        rows = t.fuse(k / 10)
    assert len(rows) == 1 and abs(rows[0][1] - 29.5) < 0.2 and abs(rows[0][2] - 5) < 0.1
    if mode < 2:
        assert abs(rows[0][6] - 5) < 0.5


def test_pooled(spark):
    rows = spark.createDataFrame([(1, 10.0, 5.0, 0.5, 0.0, 0.5), (1, 11.0, 5.0, 0.25, 0.0, 0.25), (2, 1.0, 2.0, 0.1, 0.0, 0.1)], "k int, cx double, cy double, c00 double, c01 double, c11 double")
    got = {r.k: r for r in tracking.pooled(rows, ["k"]).collect()}
    assert (round(got[1].x, 9), got[1].c00, got[2].x) == (round(0.75 * 7.75, 9), 0.75, 1.0)
    got = {r.k: r for r in tracking.pooled(rows, ["k"], information=True).collect()}
    assert abs(got[1].x - 64 / 6) < 1e-9 and abs(got[1].c00 - 1 / 6) < 1e-9


def test_running_totals_in_two_levels(spark):
    rng = random.Random(3)
    rows = [(run, "a" if f % 3 else "b", f, rng.choice([None, rng.randrange(9)])) for run in (1, 2) for f in range(0, 7000, run * 7)] + [(3, "a", 12_300, 5)]
    df = spark.createDataFrame(rows, "run_id int, source string, frame int, n long")
    got = {(r.run_id, r.source, r.frame): r.n for r in report.running(df, ["n"], keys=("run_id", "source")).collect()}
    want = {(k, s, f): sum(m or 0 for kk, ss, ff, m in rows if (kk, ss) == (k, s) and ff <= f) for k, s, f, _ in rows if f % 100 == 0}
    assert got == want


def test_faults_of_poses_and_sensors_by_run(spark):
    from waymesh.operators import augment
    from waymesh.plans import views

    kinds = ["NONE", "LOCALIZATION", "SINGLE_SENSOR_EXTRINSICS", "MULTI_SENSOR_EXTRINSICS", "MALICIOUS_REMOVAL"]
    runs = catalogs.sweep(spark, kinds, [50])
    rows = [(run, f, f / 10, f"veh{p}", "CAV", 1.0 * p, 2.0, 0.3) for run in range(5) for p in range(40) for f in range(3)]
    platforms = spark.createDataFrame(rows, "run_id int, frame int, t double, platform_id string, kind string, x double, y double, yaw double")
    poses, sensors = augment.dispatched_poses(platforms, views.sensor_table(spark), runs, 7)
    moved = {k: [] for k in range(5)}
    for r in poses.collect():
        moved[r.run_id].append((r.x - float(r.platform_id[3:]), r.y - 2, r.yaw - 0.3))
    assert all(not any(map(any, moved[k])) for k in (0, 2, 3, 4)) and len(moved[1]) == 120
    off = [m for m in moved[1] if any(m)]
    assert 35 < len(off) < 85 and all(abs(x) <= 0.5 and abs(y) <= 0.5 and abs(a) <= 0.085 for x, y, a in off)
    of = {}
    for r in sensors.collect():
        of.setdefault((r.run_id, r.platform_id), []).append((r.dx, r.dy, r.dyaw))
    assert len(of) == 200 and all(len(v) == 2 for v in of.values())
    assert not any(any(d) for (run, _), v in of.items() if run in (0, 1, 4) for d in v)
    single, multi = ([v for (run, _), v in of.items() if run == k and any(map(any, v))] for k in (2, 3))
    assert 10 < len(single) < 30 and all(sum(map(any, v)) == 1 for v in single)
    assert 10 < len(multi) < 30 and all(v[0] == v[1] and abs(v[0][0]) <= 1 for v in multi)
    placed = {(r.run_id, r.frame, r.platform_id, r.sensor_idx): r.yaw for r in sensing.sensor_poses(poses, sensors).collect()}
    assert len(placed) == 5 * 40 * 3 * 2


def test_range_joins_are_dealt_whatever_the_files(spark):
    """A few rows in one file, with the objects broadcast: pairs are still made by many tasks."""
    rows = spark.range(400).coalesce(1).selectExpr("0 as run_id", "cast(id as int) as frame", "0.0D as x", "0.0D as y", "1.0D as cx", "1.0D as cy")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = sensing.within_range(rows.select("run_id", "frame", "x", "y"), F.broadcast(rows.select("run_id", "frame", "cx", "cy")), 5.0)
        assert pairs.count() == 400 and pairs.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
