import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from waymesh.llm import simhash as S


def brute(rows):
    def fp(text):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        if not w:
            return 0
        sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (f[i] ^ f[j]).bit_count() <= 4:
            parent[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return sorted(((k, f"{f[i]:016x}", least[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        t = list(rng.choice(words, int(rng.integers(3, 200))))
        rows.append((i * 7, " ".join(t)))
        for j in range(int(rng.integers(0, 4))):
            t[int(rng.integers(len(t)))] = "Changed"
            rows.append((i * 7 + j + 1, "\n".join(t)))
    rows += [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One\x0btwo"), (9004, "One\x0btwo"), (None, "one TWO"), (9005, "x " * 20000), (9006, "é É ö")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "2 as component_id", "3 as list")
    assert sorted(map(tuple, S.near_duplicate_groups(df).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert S.near_duplicate_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_triples_meet_every_four_positions():
    assert len(S.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in S.TRIPLES) for four in combinations(range(8), 4))


def test_long_lists_are_walked_to_the_same_groups():
    rng = np.random.default_rng(1)
    centre = np.uint64(rng.integers(0, 2**63))
    flips = [sum(1 << int(b) for b in rng.choice(40, int(k), replace=False)) for k in rng.integers(0, 7, 400)]
    fp = np.unique(np.array([int(centre) ^ f for f in flips], np.uint64))
    lists = np.full(fp.size, 3 << 24, np.int64)

    def groups(pairs):
        parent = {int(x): int(x) for x in fp}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(int(a))] = find(int(b))
        return {x: min(y for y in parent if find(y) == find(x)) for x in parent}

    every = [(a, b) for a, b in combinations(fp.tolist(), 2) if (a ^ b).bit_count() <= 4]
    assert groups(zip(*S._linked(lists, fp), strict=True)) == groups(every)


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_similar_groups_against_shingles(spark):
    """Groups against the similarity of all pairs of texts: what is 0.87 alike is linked, nine in ten pairs from 0.8 on are, and no text of a group is apart from all others by less than 0.8."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(3000)])
    rows = []
    for i in range(40):
        t = list(rng.choice(words, int(rng.integers(60, 400))))
        rows.append((i * 10, " ".join(t)))
        for j in range(1, int(rng.integers(1, 7))):
            for at in rng.integers(0, len(t), max(1, len(t) // 80)):
                t[int(at)] = f"New{int(rng.integers(10**6))}"
            rows.append((i * 10 + j, "\n".join(t)))
    rows += [(9001, None), (9002, ""), (9003, " \t"), (9004, "One\x0btwo"), (9005, "one TWO"), (9005, "one TWO"), (None, "one two"), (9006, "one three"), (9007, "x " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "2 as component_id", "3 as list", "4 as bytes")
    found = S.similar_groups(df).collect()
    assert Counter(r.doc_id for r in found) == Counter(k for k, _ in rows)
    of = {r.doc_id: r.component_id for r in found}
    assert of[9001] == of[9002] == of[9003] == 9001 and of[9004] == of[9005] == of[None] == 9004 and of[9006] == 9006
    parent = {k: k for k, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    alike = missed = some = lost = 0
    sets = [(k, shingles(t)) for k, t in rows]
    for (a, x), (b, y) in combinations(sets, 2):
        if (j := likeness(x, y)) >= 0.8:
            parent[find(a)] = find(b)
            some += 1
            lost += of[a] != of[b]
        if j >= 0.87:
            alike += 1
            missed += of[a] != of[b]
    assert alike > 40 and missed == 0 and lost <= 0.1 * some
    assert all(find(a) == find(b) for a, b in combinations(of, 2) if of[a] == of[b])
    kept = [r.doc_id for r in S.representatives(df, similar=True).collect()]
    assert sorted(kept) == sorted(set(of.values()))


def test_pairs_of_similarity_meet_in_a_list():
    """Recall of the lists and of the bits, on pairs of a known share of equal shingles."""
    rng = np.random.default_rng(4)
    linked, near = [], []
    for _ in range(200):
        w = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        v = list(w)
        while (j := likeness(shingles(" ".join(w)), shingles(" ".join(v)))) > 0.82:
            v[int(rng.integers(300))] = f"x{int(rng.integers(10**6))}"
        a, b = (S.majority(S.shingle_hashes(" ".join(x).encode(), S.WIDE_WORDS), S.WIDE_LONGS) for x in (w, v))
        meet = (a.view(np.uint8) == b.view(np.uint8))[S.WIDE_TRIPLES].all(axis=1).any()
        linked.append(bool(meet and np.bitwise_count(a ^ b).sum() <= S.WIDE_BITS))
        near.append(j)
    assert np.mean(near) < 0.825 and np.mean(linked) >= 0.9


def test_pairs_just_below_are_no_duplicates(spark):
    """Pairs of 0.74 to 0.79, of which half would link by their fingerprints alone, and pairs of 0.8 to 0.82 beside them."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(120):
        w = [f"w{k}" for k in rng.integers(0, 5000, 250)]
        v, low = list(w), 0.79 if i % 2 else 0.82
        while (j := likeness(shingles(" ".join(w)), shingles(" ".join(v)))) > low:
            v[int(rng.integers(250))] = f"x{int(rng.integers(10**6))}"
        want[i] = j >= 0.8
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    of = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {i: of[2 * i] == of[2 * i + 1] for i in range(120)}
    assert not any(linked[i] for i in want if not want[i]) and sum(want.values()) > 40
    assert np.mean([linked[i] for i in want if want[i]]) >= 0.85


def test_majority_of_many_hashes():
    h = np.random.default_rng(2).integers(0, 2**63, 9000, dtype=np.uint64)
    assert int(S.majority(h)[0]) == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > h.size)
    assert S.majority(h, 4)[0] == S.majority(h)[0] and S.majority(h[:0], 3).tolist() == [0, 0, 0]


def test_similar_groups_of_an_empty_table(spark):
    assert S.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_candidates_that_a_walk_leaves_out_are_compared(spark, monkeypatch):
    """One candidate in four is taken for alike, whatever its texts: what candidates of all lists link is linked, though walks reach members by others."""
    like = F.pmod(F.xxhash64("a", "b"), F.lit(4)) == 0
    monkeypatch.setattr(S, "_alike", lambda links, rows, texts: links.select("a", "b").where(like))
    rng, w = np.random.default_rng(8), [f"w{k}" for k in np.random.default_rng(9).integers(0, 5000, 60)]
    texts = []
    for _ in range(60):
        v = list(w)
        for at in rng.integers(0, 60, 2):
            v[int(at)] = f"x{int(rng.integers(10**6))}"
        texts.append(" ".join(v))
    prints = np.array([S.majority(S.shingle_hashes(t.encode(), S.WIDE_WORDS), S.WIDE_LONGS) for t in texts])
    name = [xxhash.xxh64(p.tobytes(), seed=42).intdigest() for p in prints]
    name = [n - (n >> 63 << 64) for n in name]
    byte, place = prints.view(np.uint8).reshape(len(texts), -1)[:, S.WIDE_TRIPLES], {n: i for i, n in enumerate(name)}
    pairs = []
    for a, b in combinations(range(len(texts)), 2):
        bits = int(np.bitwise_count(prints[a] ^ prints[b]).sum())
        if bits <= S.WIDE_BITS and (byte[a] == byte[b]).all(axis=1).any():
            pairs.append((min(name[a], name[b]), max(name[a], name[b]), bits <= S.SURE_BITS))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in spark.createDataFrame(pairs, "a long, b long, sure boolean").where(F.col("sure") | like).collect():
        parent[find(place[r.a])] = find(place[r.b])
    of = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(of.values())) < len(texts) - 10
    assert all((of[a] == of[b]) == (find(a) == find(b)) for a, b in combinations(of, 2))


def test_a_list_gives_all_pairs_of_what_is_apart():
    """Three members of a list that are near each other: a walk from the first leaves out the pair of the others, which may be the one that is alike."""
    prints = np.zeros((3, S.WIDE_LONGS), np.uint64)
    prints[1, :3], prints[2, 3:6] = 0x7FFF_FFFF_FFFF_FFF, 0x7FFF_FFFF_FFFF_FFF  # 177 bits each would be too far from each other
    prints[1, 1:3], prints[2, 4:6] = 0x1FFF, 0x1FFF
    rows = pa.RecordBatch.from_arrays([pa.array([5, 5, 5]), pa.array([10, 11, 12]), pa.array([p.tobytes() for p in prints], pa.binary()), pa.array([10, 11, 12])], ["list", "fp", "bytes", "root"])
    assert 104 < int(np.bitwise_count(prints[1] ^ prints[2]).sum()) <= S.WIDE_BITS
    found = lambda f, r: {p for b in f([r]) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert (11, 12) not in found(S._wide_links, rows.select(["list", "fp", "bytes"]))
    assert found(S._wide_apart, rows) == {(10, 11), (10, 12), (11, 12)}
    together = rows.set_column(3, "root", pa.array([10, 11, 11]))
    assert found(S._wide_apart, together) == {(10, 11), (10, 12)}


def joined(sets, pairs):
    """The root of each text where these pairs are linked."""
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        parent[find(max(find(a), find(b)))] = min(find(a), find(b))
    return {k: find(k) for k in parent}


def near_copies(n, seed):
    """Copies of one text with other words at places of their own: most pairs of them are candidates, few are alike."""
    rng = np.random.default_rng(seed)
    base, texts = [f"w{k}" for k in rng.integers(0, 5000, 220)], {}
    for i in range(n):
        v, at = list(base), int(rng.integers(215))
        for k in {at, int(rng.integers(215)), *rng.integers(0, 215, int(rng.integers(0, 4))).tolist()}:
            v[k] = f"x{int(rng.integers(10**6))}"
        texts[i] = " ".join(v)
    return texts


def candidates(texts):
    """All pairs that meet in a list and differ in WIDE_BITS at most."""
    prints = np.array([S.majority(S.shingle_set(t.encode()), S.WIDE_LONGS) for t in texts.values()])
    byte, ids = prints.view(np.uint8).reshape(len(prints), -1)[:, S.WIDE_TRIPLES], list(texts)
    for i in range(len(ids) - 1):
        near = (np.bitwise_count(prints[i + 1 :] ^ prints[i]).sum(axis=1) <= S.WIDE_BITS) & (byte[i + 1 :] == byte[i]).all(axis=2).any(axis=1)
        yield from ((ids[i], ids[i + 1 + j]) for j in np.flatnonzero(near).tolist())


def test_rows_of_candidates_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    """The groups are those of all candidates that are alike; twice the near copies make at most some twice the rows that are joined to texts, and a few for each text."""
    rows, real = [], S._alike
    monkeypatch.setattr(S, "_alike", lambda links, *rest: rows.append(links.count()) or real(links, *rest))
    monkeypatch.setattr(S, "NEAREST", (2, 6))
    made, compared = {}, 0
    for n in (120, 240):
        texts = near_copies(n, 3)
        sets, pairs = {k: shingles(t) for k, t in texts.items()}, list(candidates(texts))
        want = joined(sets, [(a, b) for a, b in pairs if likeness(sets[a], sets[b]) >= 0.8])
        rows.clear()
        found = S.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in found} == want
        made[n], compared = sum(rows), compared + sum(want[a] != want[b] for a, b in pairs)
        assert made[n] <= 9 * n < len(pairs)
    assert made[240] <= 2.5 * made[120] and compared > 9 * 360


@pytest.mark.parametrize("block_bytes", [1 << 23, 9000])
def test_what_rounds_leave_is_compared_in_blocks(spark, monkeypatch, block_bytes):
    """Without alike pairs in any round, blocks of lists alone find all groups, whether a list is one block or some."""
    monkeypatch.setattr(S, "_alike", lambda links, rows, texts: links.select("a", "b").limit(0))
    monkeypatch.setattr(S, "NEAREST", (1,))
    monkeypatch.setattr(S, "SURE_BITS", -1)
    monkeypatch.setattr(S, "BLOCK_BYTES", block_bytes)
    texts = near_copies(40, 4)
    sets, pairs = {k: shingles(t) for k, t in texts.items()}, list(candidates(texts))
    want = joined(sets, [(a, b) for a, b in pairs if likeness(sets[a], sets[b]) >= 0.8])
    found = S.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == want and 1 < len(set(want.values())) < 40


def test_a_shingle_that_stands_often_counts_once(spark):
    """A line that is repeated a hundred times outweighs what differs in counts of shingles, not in their sets."""
    rng = np.random.default_rng(6)
    rows = [(i, "same line again and again " * 100 + " ".join(f"w{k}" for k in rng.integers(0, 10**6, 60))) for i in range(4)]
    assert {r.component_id for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0, 1, 2, 3}
