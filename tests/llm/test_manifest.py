import hashlib
import random
import zlib

import duckdb
import pytest

from waymesh.llm import manifest as M
from waymesh.llm.queries import ORACLES

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256(b"".join(p.encode() for p in parts)).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    trees = {}
    for name in names:
        own = sorted(langs[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = own, levels([leaf(r) for r in own])
    top = levels([trees[n][1][-1][0] for n in names])
    found = []
    for at, name in enumerate(names):
        own, tree = trees[name]
        for i, row in enumerate(own):
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                changed = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            new, siblings = leaf(changed), []
            for part, place in ((tree, i), (top, at)):
                for level in part[:-1]:
                    run = level[place // 8 * 8 : place // 8 * 8 + 8]
                    siblings += run[: place % 8] + run[place % 8 + 1 :]
                    new = h(*run[: place % 8], new, *run[place % 8 + 1 :])
                    place //= 8
            root = top[-1][0]
            found.append((row[0], leaf(row), tree[-1][0], root, h(*siblings), new, new == root))
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    sizes = {None: 9, "": 1, "en": 700, "é": 64, "zz": 65, "a": 8}
    made, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            made.append((k, rng.choice(["web", None, "x:y"]), lang, rng.choice([None, 3, 70]), rng.choice([None, "", "Text É " * rng.randrange(9), "lower"])))
            k += rng.randrange(1, 4)
    made += [(None, None, None, None, None), (None, "w", "en", 1, "No Id"), *[(5, "w", "en", 1, "Same")] * 20, (9, "w", "a", 1, "A" * 200_000)]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_rows_equal_plain_trees(spark, rows, levels):
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 as tree", "2 as pos", "3 as digest", "4 as id").repartition(5)
    found = M.manifest(df, levels=levels).checked().collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_one_row_one_tree_and_none(spark):
    for rows in ([(3, "s", "en", 1, "Text")], [(i, "s", "en", 1, "Text") for i in range(3)], [(1, "s", "b", 1, "x"), (2, "s", "a", 1, "X")], []):
        found = M.proofs(spark.createDataFrame(rows, COLUMNS)).collect()
        assert sorted(map(tuple, found), key=str) == brute(rows)


def test_many_trees(spark):
    rows = [(i, "s", f"l{i % 90}", 1, "Text") for i in range(200)]
    assert sorted(map(tuple, M.manifest(spark.createDataFrame(rows, COLUMNS), levels=1).checked().collect()), key=str) == brute(rows)


def test_sql(spark, rows):
    db = duckdb.connect()
    unique = list({r[0]: r for r in rows}.values())
    db.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", unique)
    found = db.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({ORACLES['op11_merkle_manifest']})").fetchall()
    assert sorted(found, key=str) == brute(unique)


def test_a_parent_goes_on_from_its_copied_state():
    children = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(8)]
    parent = M.Parent(children)
    for slot in range(8):
        other = [*children[:slot], b"0" * 64, *children[slot + 1 :]]
        assert parent.folded(slot, b"0" * 64) == hashlib.sha256(b"".join(other)).hexdigest().encode()
        assert parent.folded(slot, children[slot]) == parent.digest
    assert M.packed(M.unpacked(M.packed([(parent, 3)]))) == M.packed([(parent, 3)])
