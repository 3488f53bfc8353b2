import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.llm import digests as D


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda n: " ".join("".join(rng.choices("abcdefghiéü", k=rng.randint(1, 9))) for _ in range(n))
    return [word(rng.randint(0, 400)) for _ in range(30)] + ["", "x", "seven b", "a" * 500, "a" * 40, word(10), word(12), word(9000)]


def joined(raw):
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)


def level(window):
    total = sum(round((f(k) - f(k - 1)) * 65536) for n in Counter(window).values() for k in range(1, n + 1) for f in [lambda x: x * math.log2(x) if x else 0.0])
    return int((1 - total / (32 * 5 * 65536)) * 511 + 0.5)


def test_levels_counts_and_features_equal_brute_force():
    raw = [t.encode() for t in texts()]
    data, starts = joined(raw)
    per_text = [[level(t[i : i + 32]) for i in range(len(t) - 31)] for t in raw]
    want = np.bincount([x for t in per_text for x in t], minlength=D.LEVELS)
    assert np.array_equal(D.level_counts(data, starts), want)
    rank = D.ranks(want)
    text, h = D.features(data, starts, rank)
    for i, (t, levels) in enumerate(zip(raw, per_text, strict=True)):
        if len(t) >= 64:
            points = Counter(min(range(w, w + 32), key=lambda p: (rank[levels[p]], p)) for w in range(len(levels) - 31))
            places = sorted(p for p, n in points.items() if n >= 8 and levels[p] > 0)
            alone = D.features(*joined([t]), rank)[1]
            assert np.array_equal(h[text == i], alone)
            assert (text == i).sum() == len(places)
        else:
            assert (text == i).sum() == 0


def test_likeness():
    raw = [t.encode() for t in texts(2)]
    rank = D.ranks(D.level_counts(*joined(raw)))
    found = D.digests_of(raw, rank)
    assert all(D.likeness(d, d) == 1 for d in found)
    long = [i for i, t in enumerate(raw) if len(t) > 600 and len(set(t)) > 5]
    apart = [D.likeness(found[i], found[j]) for i in long for j in long if i < j]
    assert np.mean(apart) < 0.1
    half = [D.likeness(found[i], D.digests_of([raw[i][: len(raw[i]) // 2] + raw[j][: len(raw[i]) // 2]], rank)[0]) for i, j in zip(long, long[1:])]
    assert min(half) > 0.2 and np.mean(half) > 0.35
    assert D.likeness(found[30], found[0]) == 0 and not len(found[30][0]) and not len(found[30][1])
    for t, d in zip(raw, found, strict=True):
        few = D.features(*joined([t]), rank)[1].size < 4
        grams = {(b"\0" * 7 + t)[i : i + 8] for i in range(len(t))}
        assert D.small_windows(np.frombuffer(t, np.uint8)).size == len(grams)
        assert len(d[1]) == (-(-len(grams) // D.FEATURES) if len(t) <= 256 or few else 0)


@pytest.mark.parametrize("partitions", [1, 5])
def test_rows_equal_brute_force(spark, partitions):
    t = texts(3)
    rows = [(i * 3, x) for i, x in enumerate(t)] + [(7, None), (9, t[3]), (9, "tie"), (None, "last"), (None, None)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("x"), "lead": F.lit(1), "id": F.lit(None)}).repartition(partitions)
    got = D.edited_likeness(df).collect()
    order = sorted(((i, x or "") for i, x in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for (i, x), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        e = x[: len(x) - len(x) // 2] + n[: len(x) // 2]
        want.append((i, len(x), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    rank = D.corpus_ranks(df)
    data, starts = joined([(x or "").encode() for _, x in rows])
    assert np.array_equal(rank, D.ranks(D.level_counts(data, starts)))
    prints = Counter((i, D.fingerprint(D.digests_of([x.encode()], rank)[0])) for i, x in order)
    assert Counter((r.doc_id, r.fingerprint) for r in got) == prints
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(4, "abc" * 50)], "doc_id long, text string")
    assert [(r.near_next, r.n_chars) for r in D.edited_likeness(df).collect()] == [(1.0, 150)]
    assert D.edited_likeness(df.where("false")).collect() == []


def test_texts_without_a_feature_differ():
    rng = random.Random(9)
    raw = [("T" + "".join(rng.choices("abcdefg hi", k=rng.randint(63, 99)))).encode() for _ in range(300)] + [b"T" + b"abc" * 30, b"T" + b"abd" * 30, b"T" * 80]
    rank = D.ranks(D.level_counts(*joined(raw)))
    found = D.digests_of(raw, rank)
    assert len({D.fingerprint(d) for d in found}) == len(set(raw))
    assert [D.fingerprint(D.digests_of([t], rank)[0]) for t in raw] == [D.fingerprint(d) for d in found]
    bare = [i for i, t in enumerate(raw[:300]) if len(t) < 70]
    assert all(D.likeness(found[i], found[j]) < 0.5 for i in bare for j in bare if i < j)
    x = raw[bare[0]]
    assert 0.5 < D.likeness(found[bare[0]], D.digests_of([x[:-1] + b"X"], rank)[0]) < 1


def test_one_byte_more_changes_little_at_every_length():
    rng = random.Random(4)
    kinds = ["abcdefghijklmnop qrstuvwxyz", "ab ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,;"]
    raw, more = [], []
    for n in range(1, 301):
        for letters in kinds:
            raw.append("".join(rng.choices(letters, k=n)).encode())
            more.append(raw[-1] + b"x")
    rank = D.ranks(D.level_counts(*joined([("".join(rng.choices(kinds[0], k=4000))).encode() for _ in range(20)])))
    one, two = D.digests_of(raw, rank), D.digests_of(more, rank)
    low = [len(t) for t, a, b in zip(raw, one, two, strict=True) if D.likeness(a, b) < 0.5]
    assert not low
    assert all(D.likeness(a, b) < 0.35 for t, a, b in zip(raw, one, one[9:], strict=False) if len(t) > 30 and len(set(t)) > 20)


def test_many_empty_and_short_texts_of_one_range(spark):
    """A range's rows are held by number as well as by length."""
    rank = D.ranks(np.ones(D.LEVELS))
    batch = spark.range(100_000).selectExpr("0 as part", "id = 99999 as lead", "id", "'' as text").toArrow()
    seen = [b.num_rows for b in D._compared(rank)(iter(batch.to_batches()))]
    assert sum(seen) == 99_999 and max(seen) <= D.ROWS


def test_many_documents_without_an_id_are_split(spark):
    rows = [(None, f"{'common head ' * (i % 2)}{i} " + "x" * (i % 50)) for i in range(600)] + [(i, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    parts = Counter(r.part for r in D.with_next(df).where("NOT lead").select("part").collect())
    assert len(parts) >= 8 and max(parts.values()) < 300 and sum(parts.values()) == 900
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = Counter(x[: len(x) - len(x) // 2] + n[: len(x) // 2] for (_, x), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    assert Counter(r.edited_sha256 for r in D.edited_likeness(df).collect()) == Counter({hashlib.sha256(e.encode()).hexdigest(): n for e, n in want.items()})
