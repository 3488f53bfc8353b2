import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.llm import induced as I
from waymesh.llm import repeats as R


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    often = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (k, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if often[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((k, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(n))
    passages = [word(rng.randint(20, 120)) for _ in range(6)]
    rows = [(i, word(rng.randint(0, 60)) + " " + rng.choice(passages) + " " + word(rng.randint(0, 60))) for i in range(50)]
    rows += [(100 + i, rows[3 * i][1]) for i in range(5)]
    for i in range(10):
        t = list(rows[i][1])
        t[rng.randrange(len(t))] = "X"
        rows.append((200 + i, "".join(t)))
    p = passages[0]
    rows += [(300, "a" * 3000), (301, "ab" * 700), (302, p + p), (303, None), (304, ""), (305, "short"), (305, word(90)), (None, p), (None, word(80)), (306, word(70)), (306, rows[0][1])]
    rows += [rows[7]] * 2
    return rows


@pytest.mark.parametrize("length,gram", [(400, 128), (60, 20)])
def test_equals_brute_force(spark, length, gram):
    rows = corpus(length)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "tag": F.lit(1.5), "_id": F.lit(2), "anchor": F.lit(3), "kept": F.lit(0)})
    got = R.without_repeats(df, length=length, gram=gram).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_small_shards_and_one_large_anchor(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARD", 3000)
    strings = [t.encode() for _, t in corpus(1) if t and len(t) > 60]
    raw, starts = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
    want = R.repeated_windows(raw, starts, 60)
    assert np.array_equal(np.concatenate(R._marked(strings, 60)), want)
    often = Counter(s[i : i + 60] for s in strings for i in range(len(s) - 59))
    assert want.tolist() == [i + 60 <= len(s) and often[s[i : i + 60]] > 1 for s in strings for i in range(len(s))]


def test_no_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in R.without_repeats(df).collect()) == [0, 0]
    assert R.without_repeats(df.where("false")).collect() == []


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(150):
        x = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 200))).astype(np.int16)
        want = sorted(range(x.size), key=lambda i: x[i:].tolist())
        assert I.suffix_array(x).tolist() == want
        before, common = I.common_prefixes(x.astype(np.uint8), np.array(want, np.int32), np.full(x.size, x.size))
        for i, j in zip(want[1:], want[:-1], strict=True):
            m = 0
            while max(i, j) + m < x.size and x[i + m] == x[j + m]:
                m += 1
            assert (before[i], common[i]) == (j, m)


def test_texts_longer_than_the_places_of_anchors(monkeypatch):
    rng = random.Random(6)
    again = "".join(rng.choices("abcdefgh", k=90))
    strings = ["".join(rng.choices("abcdefgh", k=n)) for n in (40, 900, 0, 3000, 61)]
    strings[3] = strings[3][:200] + again + strings[3][200:2500] + again + strings[3][2500:]
    data, starts = np.frombuffer("".join(strings).encode(), np.uint8), np.cumsum([0, *map(len, strings)])

    def of_windows():
        text, anchor, place, low, high = R.anchors(data, starts, 60, 20)
        return {(t, s): (a, p) for t, a, p, x, y in zip(text.tolist(), anchor.tolist(), place.tolist(), low.tolist(), high.tolist(), strict=True) for s in range(x, y + 1)}

    for bits in (9, 24):
        monkeypatch.setattr(R, "_PLACE", np.uint64((1 << bits) - 1))
        got = of_windows()
        assert got.keys() == {(t, s) for t, x in enumerate(strings) for s in range(len(x) - 59)}
        assert all(s <= p <= s + 40 for (_, s), (_, p) in got.items())
        assert all(got[3, 200 + k][0] == got[3, 2590 + k][0] for k in range(31))


def test_hot_anchors_are_not_taken_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARD", 2000)

    def _shards(length, words=0, real=R._shards):
        def shard(group):
            by = {}
            for a, x in zip(group.column("anchor").to_pylist(), group.column("bytes").to_pylist(), strict=True):
                by[a] = by.get(a, 0) + len(x)
            assert max(by.values()) <= R.HOT * R.SHARD
            return real(length, words)(group)

        return shard

    monkeypatch.setattr(R, "_shards", _shards)
    rng = random.Random(3)
    word = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(n))
    footer, wide = word(8)[:40], word(20)
    rows = [(i, word(20) + footer + word(20)) for i in range(150)] + [(200 + i, word(20) + wide + word(20)) for i in range(150)]
    rows += [(400, rows[0][1]), (401, rows[1][1][20:-20]), (402, footer * 9), (403, rows[2][1][:150]), (None, wide)]
    got = R.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=60, gram=20).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 60)


@pytest.mark.parametrize("hot", [False, True])
def test_passages_by_words(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(R, "SHARD", 300)
    rng = random.Random(5)
    word = lambda n, m: " ".join("".join(rng.choices("abcdefé", k=rng.randint(1, m))) for _ in range(n))
    short, cut, long = word(51, 3), word(50, 3), word(60, 9)
    rows = [(i, word(40, 9) + "\n" * (1 + i % 2) + p + " " + word(30, 9)) for i, p in enumerate([short, cut, long] * 12)]
    rows += [(100, short), (101, short.replace(" ", "  ", 1)), (102, "x" + short + "y"), (103, " " + short + "  " + short), (104, "a b " * 80), (105, None), (106, " \n "), (107, short + "\t" + word(3, 2)), (107, word(200, 2))]
    got = R.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=300, gram=96, words=51).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, 300)  # these columns are about bytes alone
    texts = [(t or "").encode() for _, t in rows]
    spans = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    windows = [[(s[k][0], s[k + 50][1]) for k in range(len(s) - 50)] + [(k, k + 300) for k in range(len(t) - 299)] for t, s in zip(texts, spans, strict=True)]
    of_words = Counter(t[x:y] for t, s in zip(texts, spans, strict=True) for x, y in [(s[k][0], s[k + 50][1]) for k in range(len(s) - 50)])
    of_bytes = Counter(t[k : k + 300] for t in texts for k in range(len(t) - 299))
    want = []
    for (i, _), t, s, every in zip(rows, texts, spans, windows, strict=True):
        gone, n = bytearray(len(t)), max(0, len(s) - 50)
        for k, (x, y) in enumerate(every):
            if (of_words if k < n else of_bytes)[t[x:y]] > 1:
                gone[x:y] = b"\1" * (y - x)
        want.append((i, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    assert sorted(((r.doc_id, bytes(r.kept)) for r in got), key=str) == sorted(want, key=str)
    removed = {r.doc_id: r.n_bytes - len(r.kept) for r in got}
    assert len(short.encode()) < 300 and removed[0] == removed[100] == len(short.encode()) and removed[1] == 0


def test_a_row_that_stands_very_often(spark):
    """Copies of one row, id and all, are cut once, and go like other repeats."""
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.range(3000).selectExpr("7 as doc_id", f"'{text}' as text").unionByName(spark.createDataFrame([(8, "x" + text), (9, "other")], "doc_id int, text string"))
    rows = R.without_repeats(df).groupBy("doc_id", "n_bytes", "n_removed").count().collect()
    n = len(text)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r["count"]) for r in rows} == {(7, n, n, 3000), (8, n + 1, n, 1), (9, 5, 0, 1)}
    path = R._repeated_ranges(R._rows(df, "doc_id", "text", ["doc_id"]), 400, 128, 0)
    assert path.count() == 2
