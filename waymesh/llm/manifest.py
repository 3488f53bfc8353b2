"""A Merkle manifest of a table, whose parents keep copied hash states.

A leaf is the SHA-256 of a row. The leaves of a tree (here: of a language) stand in order; every eight
consecutive nodes become the hash of their hexadecimal digests, until one is left, the subroot; the
subroots likewise give the root. A parent keeps a copy of its hash state before each child, so that
another digest in one place is folded in by going on from that copy with the replacement and what
stands right of it: what stands left is not hashed again.

Places in a tree come from one range sort and a count for each range and tree. Four levels are built
at a time, by groups of 4096 consecutive nodes, so only digests are shuffled, once for every four
levels, and no group grows with the table. The way up writes the digests of groups, the way down hands
each group the runs on its own path to the root."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

ARITY, LEVELS = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "tree string, pos long, digest binary, total long"
PATH = "tree string, pos long, path binary"
RESULT = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

class Parent:
    """Up to ARITY children, as hexadecimal bytes, and the hash's state before each of them."""

    def __init__(self, children: list[bytes]) -> None:
        self.states, self.children, state = [], children, hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()
        self.right = [b"".join(children[i + 1 :]) for i in range(len(children))]

    def folded(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child in that place."""
        state = self.states[slot].copy()
        state.update(replacement)
        state.update(self.right[slot])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot]) + self.right[slot]


def depth(total: int) -> int:
    """Levels above so many leaves."""
    found = 0
    while total > 1:
        total, found = -(-total // ARITY), found + 1
    return found


def grown(digests: list[bytes], levels: int) -> list[list[Parent]]:
    """The parents of consecutive nodes, level by level from below."""
    out = []
    for _ in range(levels):
        out.append([Parent(digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)])
        digests = [p.digest for p in out[-1]]
    return out


def packed(way: Sequence[tuple[Parent, int]]) -> bytes:
    """A path: of each run on it the place, the number of nodes, and their digests."""
    return b"".join(bytes([slot, len(p.children)]) + bytes.fromhex(b"".join(p.children).decode()) for p, slot in way)


def unpacked(path: bytes) -> list[tuple[Parent, int]]:
    way, at = [], 0
    while at < len(path):
        slot, n = path[at], path[at + 1]
        run = path[at + 2 : at + 2 + 32 * n]
        way.append((Parent([run[32 * i : 32 * i + 32].hex().encode() for i in range(n)]), slot))
        at += 2 + 32 * n
    return way


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of a row: its fields as byte count, colon and value, `-` for null."""
    return F.unhex(F.sha2(F.concat(*map(_field, columns)).cast("binary"), 256))


def tampered(text: Column, id: Column) -> Column:
    """The text in lower case (A-Z only) where three divides the checksum of the id."""
    return F.when(F.crc32(id.cast("string").cast("binary")) % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """The rows of each tree with their place in it, from 0, and the number of its rows.

    Equal rows are told apart by where they were read, so that many of them are split as well."""
    spark = rows.sparkSession
    keys = ["tree", *order, "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie")
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "manifest-ranged").withColumn("part", F.shiftright("at", 33))
    spans = ranged.groupBy("tree", "part").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part")
    spans = spans.select("tree", "part", (F.sum("n").over(before) - F.col("n") - F.col("begin")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    return ranged.join(spans, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _hexes(table: pa.Table, column: str = "digest") -> list[bytes]:
    return [d.hex().encode() for d in table.column(column).to_pylist()]


def _group(levels: int) -> Column:
    return F.floor(F.col("pos") / ARITY**levels).alias("g")


def _lifted(levels: int):
    def lifted(key: tuple, group: pa.Table) -> pa.Table:
        """The one node that a group becomes."""
        group = group.sort_by("pos")
        total, digests = group.column("total")[0].as_py(), _hexes(group)
        tree, pos = (group.column(c)[0].as_py() for c in ("tree", "pos"))
        inside = grown(digests, min(levels, depth(total)))
        top = inside[-1][0].digest if inside else digests[0]
        return pa.table([pa.array([tree], pa.string()), pa.array([pos // ARITY**levels]), pa.array([bytes.fromhex(top.decode())], pa.binary()), pa.array([-(-total // ARITY**levels)])], ["tree", "pos", "digest", "total"])

    return lifted


def _ways(group: pa.Table, above: pa.Table, levels: int) -> tuple[list[tuple[Parent, int]], list[list[Parent]]]:
    """What stands above a group, and the levels inside it."""
    path = above.column("path")[0].as_py() if above.num_rows else b""
    return unpacked(path), grown(_hexes(group), min(levels, depth(group.column("total")[0].as_py())))


def _lowered(levels: int):
    def lowered(key: tuple, group: pa.Table, above: pa.Table) -> pa.Table:
        """The path of every node of a group."""
        names = ["tree", "pos", "path"]
        if not group.num_rows:
            return pa.table([pa.array([], k) for k in (pa.string(), pa.int64(), pa.binary())], names)
        group = group.sort_by("pos")
        upper, inside = _ways(group, above, levels)
        rest = packed(upper)
        paths = [packed([(level[i // ARITY ** (k + 1)], i // ARITY**k % ARITY) for k, level in enumerate(inside)]) + rest for i in range(group.num_rows)]
        return pa.table([group.column("tree"), group.column("pos"), pa.array(paths, pa.binary())], names)

    return lowered


def _checked(levels: int, root: str):
    def checked(key: tuple, group: pa.Table, above: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        if not group.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        group = group.sort_by("pos")
        n = group.num_rows
        upper, inside = _ways(group, above, levels)
        beyond = b"".join(p.siblings(slot) for p, slot in upper)
        higher = [b"".join(level[j // ARITY**k].siblings(j // ARITY ** (k - 1) % ARITY) for k, level in enumerate(inside) if k) + beyond for j in range(-(-n // ARITY))]
        proof, folded = [], []
        for i, new in enumerate(_hexes(group, "changed")):
            own = inside[0][i // ARITY].siblings(i % ARITY) if inside else b""
            proof.append(hashlib.sha256(own + higher[i // ARITY]).hexdigest())
            for k, level in enumerate(inside):
                new = level[i // ARITY ** (k + 1)].folded(i // ARITY**k % ARITY, new)
            for parent, slot in upper:
                new = parent.folded(slot, new)
            folded.append(new.decode())
        leaves = [x.decode() for x in _hexes(group)]
        values = [group.column("id").to_pylist(), leaves, [above.column("subroot")[0].as_py()] * n, [root] * n, proof, folded, [x == root for x in folded]]
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    return checked



class Manifest:
    """The written tree over rows of (tree, id, digest, changed); tree is a string that sorts as the trees do, `levels` are built at a time."""

    def __init__(self, rows: DataFrame, levels: int = LEVELS) -> None:
        self.spark, self.levels = rows.sparkSession, levels
        self.leaves = written(placed(rows, "id", "digest"), "manifest-leaves")
        self.stages = self._stages(self.leaves)
        subroots = placed(self.stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name")
        #: One row a tree: its name, place and subroot.
        self.subroots = written(subroots, "manifest-subroots")
        self.tops = self._stages(self.subroots)
        last = self.tops[-1].head()
        self.root: str | None = last and bytes(last.digest).hex()

    def _stages(self, nodes: DataFrame) -> list[DataFrame]:
        """The nodes, those that their groups become, and so on to one node a tree."""
        stages, most = [nodes], nodes.agg(F.max("total")).head()[0] or 0
        while most > 1:
            groups = stages[-1].select("tree", "pos", "digest", "total", _group(self.levels)).groupBy("tree", "g")
            stages.append(written(groups.applyInArrow(_lifted(self.levels), NODE), "manifest-up"))
            most = -(-most // ARITY**self.levels)
        return stages

    def _down(self, nodes: DataFrame, above: DataFrame, columns: list[str], f, schema: str) -> DataFrame:
        """Each group of the nodes with what stands above it."""
        groups = nodes.select("tree", "pos", "digest", "total", *columns, _group(self.levels)).groupBy("tree", "g")
        return groups.cogroup(above.withColumnRenamed("pos", "g").groupBy("tree", "g")).applyInArrow(f, schema)

    def checked(self) -> DataFrame:
        """Every row's proof, and the root folded from its changed digest."""
        above = self.spark.createDataFrame([], PATH)
        for nodes in reversed(self.tops[:-1]):
            above = written(self._down(nodes, above, [], _lowered(self.levels), PATH), "manifest-down")
        subroot = self.subroots.select("pos", F.col("name").alias("tree"), F.lower(F.hex("digest")).alias("subroot"))
        above = subroot.join(above.drop("tree"), "pos", "left").select("tree", F.lit(0).cast("long").alias("pos"), F.coalesce("path", F.lit(b"")).alias("path"))
        for nodes in reversed(self.stages[1:-1]):
            above = written(self._down(nodes, above, [], _lowered(self.levels), PATH), "manifest-down")
        above = above.join(subroot.drop("pos"), "tree")
        return self._down(self.leaves, above, ["id", "changed"], _checked(self.levels, self.root or ""), RESULT)


def manifest(documents: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", tree_col: str = "lang", text_col: str = "text", levels: int = LEVELS) -> Manifest:
    """The manifest of all rows, a tree for each value of tree_col (null is the first), rows by id (null first), equal ids by their digests."""
    changed = [tampered(F.col(c), F.col(id_col)) if c == text_col else F.col(c) for c in columns]
    digest = leaf([F.col(c) for c in columns])
    rows = documents.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("-")).alias("tree"),
        F.col(id_col).cast("long").alias("id"),
        digest.alias("digest"),
        F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, leaf(changed)).otherwise(digest).alias("changed"),
    )
    return Manifest(written(rows, "manifest-rows"), levels)


def proofs(documents: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", tree_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per input row: its leaf, subroot and root, the digest of its proof, and the root folded from what it became by tampering.

    Tampering lower-cases A-Z of the text of rows in which three divides the checksum of the id; a row
    without an id is never tampered with. Null fields hash as `-`, empty texts as `0:`. Repeated rows are
    leaves each, side by side. An empty table gives no rows; columns beyond those named are not read."""
    return manifest(documents, columns, id_col, tree_col, text_col).checked().withColumnRenamed("id", id_col)


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_levels(nodes: str, paths: str, levels: int) -> tuple[str, str, str]:
    """Tables of the levels above `nodes` (t, p, d) and of what the rows of `paths` (t, p, new, proof) become along them; the last of each."""
    parts, name = [], nodes
    for k in range(levels):
        parts.append(f"""
{name}_runs AS MATERIALIZED (SELECT t, p // 8 AS g, list(d ORDER BY p) AS ds, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {name}) GROUP BY t, p // 8),
{nodes}_{k} AS MATERIALIZED (SELECT t, g AS p, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d FROM {name}_runs),
{paths}_{k} AS MATERIALIZED (
  SELECT f.* REPLACE (p // 8 AS p, CASE WHEN n = 1 THEN new ELSE sha256(array_to_string(ds[1:p % 8], '') || new || array_to_string(ds[p % 8 + 2:], '')) END AS new, proof || array_to_string(ds[1:p % 8], '') || array_to_string(ds[p % 8 + 2:], '') AS proof)
  FROM {paths if not k else f"{paths}_{k - 1}"} f JOIN {name}_runs r ON f.t = r.t AND f.p // 8 = r.g)""")
        name = f"{nodes}_{k}"
    return ",".join(parts), name, f"{paths}_{levels - 1}"


def _sql(levels: int = 8) -> str:
    """Trees of up to 8 ** levels rows, and as many trees."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    bytes_ = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    crc = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, _: {step})))"
    row = " || ".join(map(_sql_field, COLUMNS))
    changed = row.replace(_sql_field("text"), _sql_field(f"translate(text, '{UPPER}', '{LOWER}')"))
    inside, last, folded = _sql_levels("nodes", "paths", levels)
    above, top, ends = _sql_levels("tops", "ways", levels)
    return f"""
WITH leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '-') AS t, sha256({row}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN sha256({changed}) ELSE sha256({row}) END AS changed FROM documents),
nodes AS MATERIALIZED (SELECT t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS d, doc_id, changed FROM leaves),
paths AS MATERIALIZED (SELECT doc_id, d AS leaf, t, p, changed AS new, '' AS proof FROM nodes),{inside},
tops AS MATERIALIZED (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS p, d, t AS name FROM {last}),
ways AS MATERIALIZED (SELECT doc_id, leaf, d AS subroot, tops.t, tops.p, new, proof FROM {folded} f JOIN tops ON f.t = tops.name),{above}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, new AS folded_root, new = d AS verified FROM {ends}, {top}
"""


PROOFS_SQL = _sql()
