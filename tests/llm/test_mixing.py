import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from waymesh.llm import mixing as M


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        t = {s: 2 * sizes[s] for s in capped} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 2 * sizes[s]}
        if not over:
            return t
        capped |= over


def checked(rows, docs):
    sizes = defaultdict(int)
    for _, s, t in docs:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, got, source = brute_targets(sizes), defaultdict(int), {d: s for d, s, _ in docs}
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 2 * r.size
        got[s] += r.taken
    return want, got


def test_taken_comes_near_the_target(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["a", "a", "a", "B", "é", "z", None]), "w " * rng.randint(0, 400)) for i in range(1500)]
    docs += [(5000, "empty", None), (5001, "", "one"), (5002, "a", "x\x0by " * 9000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"size": F.lit("x"), "target": F.lit(1), "shard": F.lit(2)})
    rows = M.mix(df).collect()
    want, got = checked(rows, docs)
    for s in want:
        assert abs(got[s] - want[s]) <= max(0.02 * want[s], 300), (s, got[s], want[s])
    assert sorted(rows, key=str) == sorted(M.mix(df.repartition(7)).collect(), key=str)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_TOKENS", 20_000)
    monkeypatch.setattr(M, "SEATS", 500)
    rng = random.Random(5)
    docs = [(i, rng.choice("aaaaaaabcdefg"), "w " * rng.randint(1, 300)) for i in range(2000)]
    rows = M.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    want, got = checked(rows, docs)
    for s in want:
        assert abs(got[s] - want[s]) <= 0.02 * want[s], (s, got[s], want[s])


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (None, None, "z"), (2, None, None)], "doc_id long, source string, text string")
    assert len(M.mix(df).collect()) == 4
    assert M.mix(df.where("false")).collect() == []
    assert {r.taken for r in M.mix(df.where("doc_id = 2")).collect()} == {0}


def test_small_sources_and_repeated_rows(spark, monkeypatch):
    """Sources of a thousandth of the corpus come near their targets too; a third of the rows are one row, without an id."""
    monkeypatch.setattr(M, "SHARD_TOKENS", 5_000)
    monkeypatch.setattr(M, "SEATS", 400)
    rng = random.Random(6)
    docs = [(i, "big", "w " * rng.randint(20, 90)) for i in range(3000)] + [(10_000 + i, f"tiny{i % 4}", "w " * rng.randint(20, 60)) for i in range(80)]
    docs += [(None, "rep", "w " * 50)] * 1500
    rows = M.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    want, got = checked(rows, docs)
    for s in want:
        assert abs(got[s] - want[s]) <= 0.03 * want[s] + 60, (s, got[s], want[s])
    assert sum(r.doc_id is None for r in rows) == 1500


def test_sources_of_less_than_a_block(spark):
    rng = random.Random(8)
    docs = [(i, "big", "w " * 2000) for i in range(500)] + [(1000 + i, "ten", "w") for i in range(10)] + [(2000 + i, "some", "w " * rng.randint(1, 30)) for i in range(100)]
    docs += [(10_000 + i, f"s{i // 2}", "w " * 10) for i in range(6000)] + [(9000, "none", ""), (9001, None, "w w")]
    rows = M.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    want, got = checked(rows, docs)
    for s in want:
        assert abs(got[s] - want[s]) <= max(0.05 * want[s], 10), (s, got[s], want[s])
    off = [abs(got[s] - want[s]) / want[s] for s in want if want[s]]
    assert sum(off) / len(off) < 0.03


def test_places_of_sources():
    goal = {"a": 1e6, "b": 20.0, "c": 3000.0, "d": 0.0}
    found = M.places(goal, 3, 700)
    assert found["a"] == (700, 0, 3, 3)
    assert all(found[s][0] <= max(1, goal[s] / 64) and found[s][1] >= 3 and found[s][3] == 1 for s in "bcd")
    assert M.places(goal, 1, 1)["b"] == (1, 0, 1, 1)


def test_taken_equals_brute_force(spark):
    """In one shard: seats by the highest quotients, then consecutive blocks on each source's ring from some block on."""
    rng = random.Random(7)
    docs = [(i, rng.choice("aabc"), "w " * rng.randint(1, 60)) for i in range(400)]
    rows = M.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    sizes = defaultdict(int)
    for _, s, t in docs:
        sizes[s] += len(t) // 2
    goal = brute_targets(sizes)
    block = max(1, round(sum(goal.values()) / M.SEATS))
    seats = dict.fromkeys(sizes, 0)
    for _ in range(int(sum(goal.values()) / block + 0.5)):
        seats[min(sizes, key=lambda s: (-goal[s] / (2 * seats[s] + 1), s))] += 1
    taken = defaultdict(int)
    for r in rows:
        taken[docs[r.doc_id][1]] += r.taken
    for s in sizes:
        given = min(seats[s] * block, 2 * sizes[s])
        assert taken[s] == given, (s, taken[s], given)
        whole = given // sizes[s]
        mine = [r for r in rows if docs[r.doc_id][1] == s]
        assert all(whole * r.size <= r.taken <= (whole + 1) * r.size for r in mine)
        assert sum(whole * r.size < r.taken < (whole + 1) * r.size for r in mine) <= 2  # only where the chosen blocks begin and end
