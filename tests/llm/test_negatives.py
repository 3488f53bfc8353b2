import math
import random

import numpy as np
import pytest

from waymesh.llm import negatives as N


def brute(rows, every=50):
    kept = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in whole) < 2**62:
            kept.append((i, whole, label))
    out = []
    for i, a, label in {(i, tuple(v), k) for i, v, k in kept if i % every == 0}:
        scored = [(-sum(x * y for x, y in zip(a, v, strict=False)), j, k) for j, v, k in kept if j != i]
        for p, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fit = sorted(x for x in scored if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(i, j, r, m, -p, -s) for r, (s, m, _) in enumerate(fit, 1)]
    return sorted(out)


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 24).tolist(), int(rng.integers(4))) for i in range(900)]
    rows += [(1000 + i, (np.array(rows[i % 7 * 50][1]) + rng.normal(0, 0.03, 24)).tolist(), i % 4) for i in range(200)]
    rows += [(2000 + i, rows[3][1], 2) for i in range(40)] + [(50, rows[5][1], 1)] * 2
    rows += [(2100, None, 1), (2150, [0.0] * 24, 1), (2200, [1.0, None], 2), (2250, [math.nan] * 24, 2), (2300, [math.inf] + [0.0] * 23, 2), (2350, rows[1][1], None), (None, rows[1][1], 1), (2400, [], 3), (2450, [0.5] * 3, 3), (2500, [3e7] + [1.0] * 23, 0), (2501, [2e7] + [1.0] * 23, 1), (2550, [9e30] * 24, 0), (2552, [2e7] * 30, 0)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as n", "3 as rank").repartition(6)
    assert sorted(map(tuple, N.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute(rows)


def test_groups_of_anchors_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i * 25, rng.normal(0, 0.3, 8).tolist(), int(rng.integers(2))) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(N, "GROUP_BYTES", 1500)
    found = sorted(map(tuple, N.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert found and found == brute([(i, np.float32(v).astype(float).tolist(), k) for i, v, k in rows])


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 1)], [(0, None, None)], [(0, [1.0], 1), (50, [2.0], 1)]])
def test_too_few_rows(spark, rows):
    assert N.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect() == []


def test_a_scan_leaves_what_its_bounds_allow():
    rng = np.random.default_rng(1)
    values = rng.integers(-100, 100, (500, 32))
    block = N.Block(np.arange(500), np.zeros(500, np.int64), values.T.astype(float), values.min(0).astype(float), values.max(0).astype(float))
    anchor = rng.integers(-90, 90, 32)
    looked = []

    def keep(lower, upper):
        looked.append(lower.size)
        return upper >= np.sort(lower)[-5]

    rows, scores = N.scan(block, anchor, np.arange(500), keep)
    exact = values @ anchor
    assert (scores == exact[rows]).all() and set(np.argsort(-exact)[:5]) <= set(rows.tolist())
    assert looked[-1] < looked[0]
