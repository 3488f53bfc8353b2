"""Joins by boxes' own extents, matching by rounds and counts without pairs, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh import scratch
from waymesh.functions import geometry as G
from waymesh.operators import safety, scoring
from waymesh.sources import catalogs

BOX = "x double, y double, w double, l double, angle double"


def boxes(rng, n, where):
    size = np.exp(rng.uniform(math.log(1), math.log(60), (n, 2)))
    return np.column_stack((rng.uniform(-90, 90, (n, 2)) + where, size, rng.uniform(-3, 3, n)))


@pytest.mark.parametrize("where", [0.0, 3e5])
def test_overlap_join_of_boxes_of_all_sizes(spark, where):
    rng = np.random.default_rng(6)
    sides = [boxes(rng, 150, where), boxes(rng, 130, where)]
    sides[0] = np.vstack((sides[0], [[where, where, 4000, 3000, 0.3], [where, where, 0, 0, 0], [where + 8, where, 1e-3, 1e-3, 0]]))
    tables = []
    for side, rows in zip("ab", sides, strict=True):
        schema = "k int, id int, " + ", ".join(f"{side}_{c}" for c in BOX.split(", "))
        tables.append(spark.createDataFrame([(i % 2, i, *map(float, r)) for i, r in enumerate(rows)], schema).withColumnRenamed("id", f"{side}_id"))
    found = {(r.a_id, r.b_id): r.iou for r in scoring.with_iou(scoring.candidates(*tables, ["k"])).collect()}
    assert len(found) == scoring.candidates(*tables, ["k"]).count()
    want = {}
    for i, a in enumerate(sides[0]):
        for j, b in enumerate(sides[1]):
            if i % 2 == j % 2 and math.hypot(*(a[:2] - b[:2])) <= (math.hypot(a[2], a[3]) + math.hypot(b[2], b[3])) / 2:
                want[i, j] = round(G.iou_of(a[None], b[None])[0], 9)
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 2e-9 for k in want)
    swapped = scoring.candidates(*(t.withColumnsRenamed({c: c.replace(f"{s}_", f"{o}_") for c in t.columns}) for t, s, o in zip(tables[::-1], "ba", "ab", strict=True)), ["k"])
    assert {(r.b_id, r.a_id) for r in swapped.collect()} == want.keys()


def test_places_of_a_long_pair_do_not_matter(spark):
    """Two boxes of forty metres, nine apart, wherever they stand on the grid."""
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-500, 500, (60, 2)))]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    a, b = (df.select("k", F.expr(f"x + {off}").alias(f"{s}_x"), F.col("y").alias(f"{s}_y"), F.lit(40.0).alias(f"{s}_w"), F.lit(3.0).alias(f"{s}_l"), F.lit(0.0).alias(f"{s}_angle")) for s, off in (("a", 0), ("b", 9)))
    assert scoring.candidates(a, b, ["k"]).count() == 60


def test_no_boxes(spark):
    a, b = (spark.createDataFrame([], "k int, " + ", ".join(f"{s}_{c}" for c in BOX.split(", "))) for s in "ab")
    assert scoring.candidates(a, b, ["k"]).count() == 0


def test_rounds_make_the_greedy_matching(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        n = int(rng.integers(1, 40))
        rows += [(k, int(d), int(g), 0.9) for d, g in rng.integers(0, n + 2, (3 * n, 2))]
    rows += [(99, i, i + j, 0.9) for i in range(9) for j in (0, 1)] + [(99, 3, 50, 0.5)]  # a chain, and one at the bound
    df = spark.createDataFrame(rows, "k int, det_ord int, gt_ord int, iou double")
    want, count = set(), {}
    dets, gts = set(), set()
    for k, d, g, iou in sorted(set(rows)):
        if iou > 0.5 and (k, d) not in dets and (k, g) not in gts:
            dets.add((k, d))
            gts.add((k, g))
            want.add((k, d, g))
            count[k] = count.get(k, 0) + 1
    with scratch.cleaned(spark):
        assert set(map(tuple, scoring.first_pairs(df.where("iou > 0.5").drop("iou"), ["k"]).collect())) == want
        assert {r.k: r.matches for r in scoring.greedy_matches(df, ["k"]).collect()} == count


def test_matching_of_a_large_frame(spark):
    """20,000 boxes in one frame, each near two others."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("det_ord"), F.explode(F.array(F.col("id").cast("int"), F.pmod(F.col("id") * 7919 + 13, F.lit(20_000)).cast("int"))).alias("gt_ord"))
    with scratch.cleaned(spark):
        found = {r.det_ord: r.gt_ord for r in scoring.first_pairs(df, ["k"]).collect()}
    taken, want = set(), {}
    for d, g in sorted((r.det_ord, r.gt_ord) for r in df.collect()):
        if d not in want and g not in taken:
            want[d] = g
            taken.add(g)
    assert found == want


def plain_counts(egos, objects, rho, decel):
    out = {}
    for k, ego, x, y, yaw, evx, evy in egos:
        n = dict.fromkeys(("envelope_truth", "ttc_truth", "envelope_seen", "ttc_seen"), 0)
        c, s = math.cos(yaw), math.sin(yaw)
        for kk, side, i, cx, cy, vx, vy in objects:
            if kk != k or i is None or i == ego:
                continue
            dlong, dlat = (cx - x) * c + (cy - y) * s, -(cx - x) * s + (cy - y) * c
            vlong, vlat = (vx - evx) * c + (vy - evy) * s, -(vx - evx) * s + (vy - evy) * c
            brake = decel * rho * rho / 2
            n[f"envelope_{side}"] += dlong < math.sqrt(evx * evx + evy * evy) * rho + brake + vlong * rho or dlat < brake + vlat * rho
            n[f"ttc_{side}"] += vlong != 0 and 0 < dlong / vlong <= 1
        out[k, ego] = n
    return out


def test_counts_without_pairs(spark):
    rng = np.random.default_rng(12)
    objects, egos = [], []
    for k, n in ((1, 1500), (2, 3), (3, 0)):
        for i in range(n):
            for side in ("truth", "seen"):
                objects.append((k, side, f"o{i}", *map(float, rng.uniform(-700, 700, 2)), *map(float, rng.normal(0, 15, 2))))
        egos += [(k, f"o{i}", *map(float, rng.uniform(-500, 500, 2)), float(rng.uniform(-4, 4)), *map(float, rng.normal(0, 12, 2))) for i in range(0, 40, 3)]
    objects += [(1, "seen", "o3", 1.0, 2.0, 0.0, 0.0), (1, "seen", "o3", 1.0, 2.0, 0.0, 0.0), (1, "truth", None, 0.0, 0.0, 0.0, 0.0)]
    a = spark.createDataFrame(egos, "k int, ego_id string, x double, y double, yaw double, evx double, evy double")
    b = spark.createDataFrame(objects, "k int, side string, object_id string, cx double, cy double, vx double, vy double")
    category = catalogs.envelopes(spark).where("category = 'Conservative'")
    found = safety.violations(a, b, ["k"], category)
    assert {(r.k, r.ego_id): {c: r[c] for c in found.columns[2:]} for r in found.collect()} == plain_counts(egos, objects, 1.9, 4.1)


def test_packets_are_decided_whole(spark):
    """Most packets of a large frame are counted without a look at their members."""
    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.lit("truth").alias("side"), F.col("id").cast("string").alias("object_id"), ((F.col("id") % 200) * 10.0).alias("cx"), (F.floor(F.col("id") / 200) * 10.0).alias("cy"), (F.col("id") % 3).cast("double").alias("vx"), F.lit(0.0).alias("vy"))
    made = safety.packets(rows, ["k"])
    n, most = made.agg(F.count("*"), F.max("n")).first()
    assert most <= safety.PACKET and n < 20_000 / safety.PACKET * 2
    ego = spark.createDataFrame([(1, "e", 1000.0, 500.0, 0.4, 3.0, 1.0)], "k int, ego_id string, x double, y double, yaw double, evx double, evy double")
    looked = ego.join(made.withColumn("members", F.array().cast("array<struct<object_id:string,cx:double,cy:double,vx:double,vy:double>>")), "k")
    bare = looked.withColumns({"_c": F.cos("yaw"), "_s": F.sin("yaw")}).select(F.sum(safety._of_packet(F.lit(0.5), F.lit(4.6))[0])).first()[0]
    whole = safety.violations(ego, rows, ["k"], catalogs.envelopes(spark).where("category = 'Aggressive'")).first().envelope_truth
    assert 0.85 * whole <= bare <= whole
