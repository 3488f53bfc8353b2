import math

import numpy as np
import pyarrow as pa
import pytest

from waymesh.llm import neighbours as N


def cos(a, b):
    dot = sa = sb = 0.0
    for x, y in zip(a + [0.0] * len(b), b + [0.0] * len(a), strict=True):
        dot, sa, sb = dot + x * y, sa + x * x, sb + y * y
    return dot / (math.sqrt(sa) * math.sqrt(sb))


def brute(rows, n=5):
    ok = [(i, v) for i, v in {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            best = sorted((-cos(list(a), list(b)), i) for i, b in ok if i != q)[:n]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, kind="double", columns=("*",)):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr(*columns)
    return sorted(map(tuple, N.nearest(df).collect()))


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 12).tolist()) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(120)] + [(600 + i, [2 * x for x in rows[9][1]]) for i in range(3)]
    rows += [(700, None), (750, [0.0] * 12), (800, [1.0, None]), (850, [math.nan] * 12), (900, [math.inf] * 12), (None, rows[1][1]), (950, []), (1000, [0.5] * 3), (1050, [1e200] * 12), (0, rows[0][1])]
    got, want = found(spark, rows, columns=("*", "1 as id", "2 as node", "3 as key")), brute(rows[:-2] + [(1050, [1.0] * 12)])
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-14)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 2.0])]])
def test_too_few_rows(spark, rows):
    assert [r[:3] for r in found(spark, rows)] == [r[:3] for r in brute(rows)]


def test_recall_against_brute_force(spark):
    """Of isotropic vectors, which have no structure to go by, and of a dense cluster in them."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (6000, 32)).astype(np.float32)
    x[4000:5500] = x[17] + rng.normal(0, 0.2, (1500, 32))
    got = {}
    for q, _, i, _ in found(spark, [(i, v.tolist()) for i, v in enumerate(x)], "float"):
        got.setdefault(q, set()).add(i)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
        assert len(got[q]) == 5
    assert hits / 600 >= 0.97


def test_lists_keep_the_best_and_known_are_not_new():
    batch = N._lists(np.array([1, 1, 1, 1, 2]), np.array([5, 6, 5, 7, 9]), np.array([0.5, 0.1, 0.5, 0.9, 0.3], np.float32), np.array([True, True, False, True, True]), 2)
    assert batch.to_pylist() == [{"node": 1, "others": [7, 5], "likeness": pytest.approx([0.9, 0.5]), "new": [True, False]}, {"node": 2, "others": [9], "likeness": pytest.approx([0.3]), "new": [True]}]
    halves = [batch.slice(0, 1), N._lists(np.array([1, 2]), np.array([8, 3]), np.array([0.7, 0.2], np.float32), np.array([True, True]), 2)]
    rows = [r for b in N._merged(2)(iter(halves)) for r in b.to_pylist()]
    assert [(r["node"], r["others"]) for r in rows] == [(1, [7, 8]), (2, [3])]
    assert isinstance(batch.column("others"), pa.ListArray)
