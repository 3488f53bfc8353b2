import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.llm import decontaminate as D
from waymesh.llm import queries


def test_common_subsequence_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert D.common_subsequence(a, b) == t[-1][-1]


def test_windows_count_a_term_once():
    rng = np.random.default_rng(1)
    ids, terms = rng.integers(0, 6, 30 * D.STEP).astype(np.int32), rng.normal(size=(5, 3)).astype(np.float32)
    got = D._windows(ids, 5, 30, terms)
    want = [sum((terms[t] for t in set(ids[r * D.STEP : (r + D.STEPS) * D.STEP].tolist()) - {5}), np.zeros(3)) for r in range(30)]
    assert np.allclose(got, want, atol=1e-4)


def test_singular_vectors(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(60, 5)) @ np.diag([9, 7, 5, 3, 1]) @ rng.normal(size=(5, 40))
    rows = [(list(range(40)), r.tolist()) for r in a]
    v = D.randomised_svd(spark.createDataFrame(rows, "terms array<int>, weights array<double>").repartition(3), 40, 5)
    want = np.linalg.svd(a)[2][: v.shape[1]]
    assert np.allclose(np.abs(np.sum(v.T * want, axis=1)), 1, atol=1e-6)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    stems = ["".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randint(2, 7))) for _ in range(3000)]
    words = lambda n: [stems[min(int(rng.expovariate(0.004)), 2999)] for _ in range(n)]
    items = [(i, words(rng.randint(15, 60))) for i in range(40)] + [(40, words(300))]
    docs, leaked = [], set()
    for d in range(400):
        w = words(rng.randint(0, 500))
        if d % 8 == 0:
            i, item = items[d // 8 % 41]
            item = list(item)
            if d % 16 == 0:  # paraphrased: a quarter of the words are others, in the first three quarters
                for k in rng.sample(range(len(item) * 3 // 4), len(item) // 5):
                    item[k] = "other"
            at = rng.randint(0, len(w))
            w[at:at] = item
            leaked.add((d, i))
        docs.append((d, " ".join(w).upper() if d % 3 == 0 else ", ".join(w)))
    return docs, [(i, " ".join(w) + ".") for i, w in items], leaked


def test_leaks_equal_brute_force(spark, corpus):
    docs, items, leaked = corpus
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaked

    def near(item, text):
        return max(D.common_subsequence(item, text[a : a + int(1.3 * len(item)) + 4]) for a in range(max(1, len(text)))) >= D.COMMON * len(item)

    texts, queries_ = {d: D.words(t) for d, t in docs}, {i: D.words(t) for i, t in items}
    sample = [d for d in texts if d % 4 == 0][:60]
    assert {(d, i) for d in sample for i in queries_ if near(queries_[i], texts[d])} == {x for x in leaked if x[0] in sample}


def test_small_blocks_give_the_same(spark, corpus, monkeypatch):
    docs, items, leaked = corpus
    monkeypatch.setattr(D, "BLOCK", 15)
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == leaked


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 60_000 + item), (None, item), (5, item), (5, item)], "doc_id long, text string").withColumns({"item_id": F.lit("x"), "term": F.lit(1)})
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "..."), (None, "quite other words stand in this one")], "item_id long, text string")
    got = D.leaks(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == [(3, 7), (5, 7), (5, 7), (None, 7)]
    assert D.leaks(docs.where("false"), bench).collect() == [] and D.leaks(docs, bench.where("false")).collect() == []


def test_verbatim_items_of_the_sample_are_found(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_benchmark_decontamination"](spark, sf).collect()}
    items = [(r.item_id, " ".join(D.words(r.text))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, " ".join(D.words(r.text))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got >= {(d, i) for d, t in docs for i, x in items if f" {x} " in f" {t} "} and got


def test_whole_long_items_and_numbers(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghiklmnoprstuvw", k=6))
    item = [word() for _ in range(5000)]
    question, other = "how many of the grey boats came back that evening", " ".join(word() for _ in range(200))
    bench = [(1, " ".join(item)), (2, question + " 4711 815 29 63"), (3, "12 + 34 = 46; 46 - 17 = 29"), (4, "what is 7919 * 6841 - 5501")]
    docs = [
        (1, other + " " + " ".join(item)),
        (2, " ".join(item[2000:])),  # 60 % of its words, the last included
        (3, " ".join(item[:4096]) + " " + other * 3),  # what was once the whole query, without the answer
        (4, question + " 4711 815 29 63"),
        (5, question + " 1 2 3 4"),
        (6, "see 12 + 34 = 46; 46 - 17 = 29 here"),
        (7, "and what is " + other),
        (8, other),
    ]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (4, 2), (6, 3)}


def test_paraphrases_are_found(spark):
    """Up to 35 % of an item's words are others: at least nine in ten of what brute force over all stretches finds."""
    rng = random.Random(9)
    stems = ["".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randint(2, 7))) for _ in range(2000)]
    words = lambda n: [stems[min(int(rng.expovariate(0.004)), 1999)] for _ in range(n)]
    items, docs = [words(rng.randint(20, 90)) for _ in range(300)], []
    for d in range(600):
        item, w = list(items[d % 300]), words(rng.randint(50, 400))
        for k in rng.sample(range(len(item)), int(len(item) * rng.choice((0.15, 0.25, 0.35)))):
            item[k] = rng.choice(stems)
        at = rng.randint(0, len(w))
        docs.append(w[:at] + item + w[at:])

    def has(item, text):  # an item's share in order, and its answer's there
        answer, n = item[-max(3, -(-len(item) // 4)) :], len(item)
        parts = [text[a : a + int(1.3 * n) + 4] for a in range(max(1, len(text) - n // 2))]
        return any(D.common_subsequence(item, p) >= D.COMMON * n and D.common_subsequence(answer, p) >= D.ANSWER * len(answer) for p in parts)

    want = {(d, d % 300) for d in range(600) if has(items[d % 300], docs[d])}
    got = D.leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(want) > 500 and len(want & found) >= 0.9 * len(want)
    assert all(has(items[i], docs[d]) for d, i in found - want)


def test_one_scan_serves_many_blocks(spark, corpus, monkeypatch):
    docs, items, leaked = corpus
    monkeypatch.setattr(D, "BLOCK", 15)
    monkeypatch.setattr(D, "SCAN_TERMS", 900)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert 1 < len(list(D._scans(bench))) <= len(list(D.blocks(bench)))
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == leaked
