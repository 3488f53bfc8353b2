import time
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.llm import quality as Q
from waymesh.llm import queries


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    x, doc = rng.normal(size=(9, Q.FEATURES)), np.array([0, 0, 0, 0, 1, 2, 2, 2, 3])
    field = Q.Field(rng.normal(size=Q.FEATURES), rng.normal(size=(2, 2)))
    p, pairs, total = Q.marginals(field, x, doc)
    want, want_pairs, want_total = np.zeros(9), np.zeros((2, 2)), 0.0
    for d in range(4):
        at = np.flatnonzero(doc == d)
        weights = {y: np.exp(sum(v * (x[i] @ field.weights) for v, i in zip(y, at)) + sum(field.transition[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=at.size)}
        z = sum(weights.values())
        want_total += np.log(z)
        for y, w in weights.items():
            want[at] += np.array(y) * w / z
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / z
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(total, want_total)


def test_features_of_lines():
    x, doc, size = Q.line_features(*joined(["ABC def\n\nthe the the", "", "É É\na | b !!"]))
    assert doc.tolist() == [0, 0, 0, 1, 2, 2] and size.tolist() == [7, 0, 11, 0, 5, 8]
    assert np.isclose(x[0, 1], 0.5) and np.isclose(x[2, 4], 2 / 3) and x[1, 12] == 1 and x[4, 1] == 1
    assert np.allclose(x[4, 1 + Q.OWN + Q.AROUND :], x[5, [1, 2, 4, 6]]) and not x[3, 1 + Q.OWN :].any()


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op7_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score", "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.97
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "word " * 50000), (4, "\n\n"), (5, "a\n" * 3000)], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("quality", F.lit(9))
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (77, 1)], "doc_id long, quality int")
    rows = Q.with_quality(docs, Q.train(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    none = Q.train(docs, labels.where("false"))
    assert np.allclose([r.score for r in Q.with_quality(docs, none).collect()], 0.5, atol=1e-6)
    assert Q.with_quality(docs.where("false"), none).collect() == []


def test_training_sample_is_bounded(spark):
    """Repeated ids give one text, and texts of very many lines none: the field is that of the rest."""
    good, bad = "A plain line of words.\nAnd one more of them.", "!! $$ ##\n!! $$ ##"
    few = [(i, good if i % 2 else bad) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    want = Q.train(make(few), labels, lines=2000)
    got = Q.train(make(few * 3 + [(50, "x\n" * 5000), (51, "x\n" * 30)]), labels, lines=2000)
    assert np.allclose(want.weights, got.weights) and np.allclose(want.transition, got.transition)
    fewer = Q.train(make(few), labels, lines=10)
    assert np.isfinite(fewer.weights).all()


@pytest.mark.parametrize("segment", [1, 2, 7, 512])
def test_segments_give_the_same_marginals(monkeypatch, segment):
    rng = np.random.default_rng(segment)
    doc = np.repeat(np.arange(7), [1, 40, 3, 14, 7, 1, 22])
    x = rng.normal(size=(doc.size, Q.FEATURES)) * 3
    field = Q.Field(rng.normal(size=Q.FEATURES), rng.normal(size=(2, 2)) * 2)
    monkeypatch.setattr(Q, "SEGMENT", segment)
    assert np.allclose(Q.line_marginals(field, x, doc), Q.marginals(field, x, doc)[0], atol=1e-9)


def test_a_text_of_very_many_lines():
    field = Q.Field(np.linspace(-1, 1, Q.FEATURES), np.array([[0.5, -0.2], [0.1, 0.3]]))
    data, starts = joined(["short line\n!!\n" * 250_000, "one", "a\nb"])
    begin = time.perf_counter()
    found = Q.document_scores(field, data, starts)
    assert time.perf_counter() - begin < 15
    x, doc, size = Q.line_features(*joined(["short line\n!!\n" * 2000]))
    few = Q.document_scores(field, *joined(["short line\n!!\n" * 2000]))[0]
    assert abs(found[0] - few) < 0.01 and np.isclose(found[1], Q.document_scores(field, *joined(["one"]))[0])
