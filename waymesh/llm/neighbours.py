"""Nearest neighbours by NN-descent: a graph of neighbours from joins of neighbours of neighbours, searched greedily.

Equal vectors are one node. Nodes carry their vector in a byte a dimension while the graph is built and
searched; results are scored again on the original vectors. The first lists come from blocks of rows
that are consecutive in the order of random hyperplanes' signs. In each round a node's candidates are
its neighbours and REVERSE of the nodes whose neighbour it is; they are sent their vectors, and at every
node all pairs of candidates with one that is new are compared. What is nearer than a candidate's last
neighbour goes to that candidate, whose best K stay. Lists are bounded, so no node gathers more than
K + REVERSE vectors however many list it.

The index is a row a node with its neighbours and their vectors, bucketed by node. A search begins at
the query's own node; in each round a query's nearest EXPAND nodes not yet visited are joined with the
index, and the BEAM nearest are kept, until none is left that was not visited."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import byte_view, fresh_dir, removed, written

EVERY, NEAREST = 50, 5
K, REVERSE, ROUNDS, LEAST_NEW = 32, 32, 6, 0.02
#: Orders of the rows, hyperplanes of each, rows of a block, and neighbours that a block gives a row.
ORDERS, BITS, BLOCK, PER_BLOCK = 4, 30, 1024, 16
BEAM, EXPAND, SCORED = 160, 64, 32
#: Rows of candidates that a task looks at at once, and nodes whose candidates are compared at once.
AT_ONCE, NODES = 1 << 15, 128
LISTS = "node long, others array<long>, likeness array<float>, new array<boolean>"


def unit(quantised: pa.Array, dims: int) -> np.ndarray:
    """Vectors of length one from their bytes, a row each, filled up with zeros."""
    data, starts = byte_view(quantised)
    size = np.diff(starts)
    out = np.zeros((size.size, dims), np.float32)
    if size.size and (size == dims).all():
        out[:] = data.view(np.int8).reshape(-1, dims)
    else:
        row = np.repeat(np.arange(size.size), size)
        out[row, np.arange(data.size) - starts[:-1][row]] = data.view(np.int8)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def padded(vectors: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of doubles, filled up with zeros."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    offsets = vectors.offsets.to_numpy()
    size = np.diff(offsets)
    out = np.zeros((size.size, int(size.max(initial=0))))
    row = np.repeat(np.arange(size.size), size)
    out[row, np.arange(row.size) - (offsets[:-1] - offsets[0])[row]] = vectors.values.slice(offsets[0], row.size).to_numpy(zero_copy_only=False)
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of doubles, added up dimension by dimension; scaled by powers of two first, which changes no digit."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) for x in (a, b))
    dot, square_a, square_b = np.zeros((3, len(a)))
    for k in range(a.shape[1]):
        dot += a[:, k] * b[:, k]
        square_a += a[:, k] * a[:, k]
        square_b += b[:, k] * b[:, k]
    return dot / (np.sqrt(square_a) * np.sqrt(square_b))


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = padded(batch.column("vector"))
        size = np.diff(batch.column("vector").offsets.to_numpy())
        most = np.abs(values).max(axis=1, initial=0)[:, None]
        q = np.round(values / most * 127).astype(np.int8)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([q[i, :n].tobytes() for i, n in enumerate(size.tolist())], pa.binary())], [*batch.schema.names, "q"])


def taking_part(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nodes(rows: DataFrame, ids: int) -> DataFrame:
    """Rows (id, vector): one node for each different vector, with its `ids` smallest ids, written."""
    vector = F.col("vector")
    seen = rows.withColumn("key", F.xxhash64(vector)).distinct()
    first = Window.partitionBy("key", "vector").orderBy("id")
    kept = seen.withColumn("at", F.row_number().over(first)).where(F.col("at") <= ids)
    grouped = kept.groupBy("key", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    made = grouped.mapInArrow(_quantised, f"key long, vector {rows.schema['vector'].dataType.simpleString()}, ids array<long>, q binary")
    return written(made.withColumn("node", F.monotonically_increasing_id()), "neighbours-nodes")


def _lists(node: np.ndarray, other: np.ndarray, likeness: np.ndarray, new: np.ndarray, k: int) -> pa.RecordBatch:
    """Of each node the k best different others, as a row; one that is known is not new."""
    order = np.lexsort((new, other, node))
    node, other, likeness, new = node[order], other[order], likeness[order], new[order]
    first = np.append(True, (node[1:] != node[:-1]) | (other[1:] != other[:-1]))[: node.size]
    node, other, likeness, new = node[first], other[first], likeness[first], new[first]
    order = np.lexsort((other, -likeness, node))
    begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: node.size])
    rank = np.arange(node.size) - np.repeat(begin, np.diff(np.append(begin, node.size)))
    order = order[rank < k]
    node = node[order]
    begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: node.size])
    offsets = pa.array(np.append(begin, node.size).astype(np.int32))
    columns = [pa.ListArray.from_arrays(offsets, pa.array(v[order], kind)) for v, kind in ((other, pa.int64()), (likeness, pa.float32()), (new, pa.bool_()))]
    return pa.RecordBatch.from_arrays([pa.array(node[begin], pa.int64()), *columns], ["node", "others", "likeness", "new"])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    lists = batch.column("others")
    node = np.repeat(batch.column("node").to_numpy(), np.diff(lists.offsets.to_numpy()))
    return node, *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("others", "likeness", "new"))


def _merged(k: int):
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by node; the last node of a batch is carried on as its best so far."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = _flat(batch) if held is None else [np.append(a, b) for a, b in zip(_flat(held), _flat(batch), strict=True)]
            found = _lists(*parts, k)
            yield found.slice(0, found.num_rows - 1)
            held = found.slice(max(0, found.num_rows - 1))
        if held is not None:
            yield held

    return merged


def merged(lists: DataFrame, k: int, name: str) -> DataFrame:
    """The k best of all of a node's lists, written."""
    dealt = lists.select("node", "others", "likeness", "new").repartition(_parts(lists.sparkSession), "node").sortWithinPartitions("node")
    return written(dealt.mapInArrow(_merged(k), LISTS), name)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _signs(planes: np.ndarray, dims: int):
    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = unit(batch.column("q"), dims)
            for order, own in enumerate(planes):
                bits = (vectors @ own.T > 0).astype(np.int64) << np.arange(len(own))[::-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vectors), order, np.int32)), pa.array(bits.sum(axis=1)), batch.column("node"), batch.column("q")], ["turn", "key", "node", "q"])

    return signs


def _within_blocks(dims: int, per_block: int, rows: int):
    def nearest(turn: list[int], node: list[int], q: list[bytes]) -> Iterator[pa.RecordBatch]:
        vectors, node = unit(pa.array(q, pa.binary()), dims), np.array(node)
        likeness = vectors @ vectors.T
        np.fill_diagonal(likeness, -np.inf)
        k = min(per_block, node.size - 1)
        if k > 0:
            at = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
            yield _lists(np.repeat(node, k), node[at].ravel(), np.take_along_axis(likeness, at, 1).ravel(), np.ones(at.size, bool), k)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for column, name in zip(held, ("turn", "node", "q"), strict=True):
                column += batch.column(name).to_pylist()
            while len(held[0]) >= 2 * rows or held[0] and held[0][0] != held[0][-1]:
                n = min(rows, held[0].count(held[0][0]))
                yield from nearest(*(c[:n] for c in held))
                held = tuple(c[n:] for c in held)
        while held[0]:
            n = min(rows, held[0].count(held[0][0]))
            yield from nearest(*(c[:n] for c in held))
            held = tuple(c[n:] for c in held)

    return within


def first_lists(items: DataFrame, dims: int, n: int) -> DataFrame:
    """Lists from blocks in the order of hyperplanes' signs; a hyperplane lies midway between two of a bounded sample of vectors."""
    picked = items.orderBy(F.xxhash64("node")).limit(2 * ORDERS * BITS).select("q").toArrow().column("q").combine_chunks()
    some = np.vstack((unit(picked, dims), np.zeros((2, dims), np.float32)))  # two rows also for an empty table
    ends = np.random.default_rng(1).integers(len(some), size=(2, ORDERS, BITS))
    planes = some[ends[0]] - some[ends[1]]
    keys = ["turn", "key", "node"]
    signed = items.select("node", "q").mapInArrow(_signs(planes, dims), "turn int, key long, node long, q binary")
    dealt = signed.repartitionByRange(max(1, min(_parts(items.sparkSession), ORDERS * n // (4 * BLOCK))), *keys).sortWithinPartitions(*keys)
    return merged(dealt.mapInArrow(_within_blocks(dims, PER_BLOCK, BLOCK), LISTS), K, "neighbours-graph")


def candidates(graph: DataFrame, items: DataFrame, turn: int) -> DataFrame:
    """(node, other, new, last, q): what each node compares, with the others' vectors and what is to be beaten for them."""
    edges = graph.select("node", F.explode(F.arrays_zip("others", "new")).alias("e")).select("node", F.col("e.others").alias("other"), F.col("e.new").alias("new"))
    order = Window.partitionBy("other").orderBy(F.xxhash64("node", "other", F.lit(turn)))
    back = edges.withColumn("at", F.row_number().over(order)).where(F.col("at") <= REVERSE).select(F.col("other").alias("node"), F.col("node").alias("other"), "new")
    last = F.when(F.size("likeness") >= K, F.array_min("likeness")).otherwise(F.lit(-2.0)).cast("float")
    known = items.select(F.col("node").alias("other"), "q").join(graph.select(F.col("node").alias("other"), last.alias("last")), "other", "left")
    return edges.unionByName(back).join(known, "other").select("node", "other", "new", F.coalesce("last", F.lit(-2.0).cast("float")).alias("last"), "q")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole nodes from rows sorted by node, of about AT_ONCE rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= AT_ONCE:
            table = pa.Table.from_batches(held).combine_chunks()
            node = table.column("node").to_numpy()
            cut = int(np.searchsorted(node, node[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held and (table := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield table


def _distinct(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """One row for each node and other, whether either was new, and where nodes begin (one more entry)."""
    node, other, new = (table.column(c).to_numpy() for c in ("node", "other", "new"))
    order = np.lexsort((other, node))
    node, other = node[order], other[order]
    first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])))
    begin = np.flatnonzero(np.append(True, node[first][1:] != node[first][:-1]))
    return table.take(pa.array(order[first])), np.logical_or.reduceat(new[order], first), np.append(begin, first.size)


def _compared(dims: int):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            table, new, begin = _distinct(table)
            vectors = np.vstack((unit(table.column("q").combine_chunks(), dims), np.zeros((1, dims), np.float32)))
            other, last = (np.append(table.column(c).to_numpy(), x) for c, x in (("other", -1), ("last", np.float32(np.inf))))
            new, size = np.append(new, False), np.diff(begin)
            at = np.full((size.size, int(size.max())), table.num_rows)
            slot = np.arange(table.num_rows) - np.repeat(begin[:-1], size)
            at[np.repeat(np.arange(size.size), size), slot] = np.arange(table.num_rows)
            targets, others, likeness = [], [], []
            for k in range(0, len(at), NODES):
                own = at[k : k + NODES]
                pairs = vectors[own] @ vectors[own].transpose(0, 2, 1)
                ok = (pairs > last[own][:, :, None]) & (new[own][:, :, None] | new[own][:, None, :]) & (own < table.num_rows)[:, None, :]
                ok[:, np.arange(own.shape[1]), np.arange(own.shape[1])] = False
                row, a, b = np.nonzero(ok)
                targets.append(other[own[row, a]])
                others.append(other[own[row, b]])
                likeness.append(pairs[row, a, b])
            found = np.concatenate(targets), np.concatenate(others), np.concatenate(likeness)
            if found[0].size:
                yield _lists(*found, np.ones(found[0].size, bool), K)

    return compared


def graph(items: DataFrame, dims: int, n: int, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph: of each node K neighbours, nearest first."""
    spark = items.sparkSession
    found = first_lists(items, dims, n)
    for turn in range(rounds):
        near = candidates(found, items, turn).repartition(_parts(spark), "node").sortWithinPartitions("node").mapInArrow(_compared(dims), LISTS)
        old = found.withColumn("new", F.transform("new", lambda _: F.lit(False)))
        found = merged(near.unionByName(old), K, "neighbours-graph")
        new, all_ = found.agg(F.sum(F.size(F.filter("new", lambda x: x))), F.sum(F.size("new"))).head()
        if not all_ or new < LEAST_NEW * all_:
            break
    return found


def _adjacent(dims: int):
    def adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            table, _, begin = _distinct(table)
            offsets = pa.array(begin.astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks()) for c in ("other", "q")]
            yield pa.RecordBatch.from_arrays([table.column("node").combine_chunks().take(pa.array(begin[:-1])), *columns], ["node", "others", "vectors"])

    return adjacent


def _visited(dims: int):
    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("others").offsets.to_numpy())
            row = np.repeat(np.arange(size.size), size)
            seekers = unit(batch.column("q"), dims)
            likeness = np.einsum("ij,ij->i", unit(batch.column("vectors").flatten(), dims), seekers[row])
            node, other = batch.column("seeker").to_numpy()[row], batch.column("others").flatten().to_numpy()
            ok = (likeness > batch.column("last").to_numpy()[row]) & (node != other)
            if ok.any():
                yield _lists(node[ok], other[ok], likeness[ok], np.ones(int(ok.sum()), bool), BEAM)

    return visited


def searched(items: DataFrame, found: DataFrame, seekers: DataFrame, dims: int) -> DataFrame:
    """Of each seeker (node, q) the BEAM nearest nodes that a greedy search of the graph meets."""
    spark, name, path = items.sparkSession, f"waymesh_{uuid.uuid4().hex}", fresh_dir(items.sparkSession, "neighbours-index")
    parts = _parts(spark)
    index = candidates(found, items, -1).select("node", "other", "new", "q").repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_adjacent(dims), "node long, others array<long>, vectors array<binary>")
    index.write.bucketBy(parts, "node").sortBy("node").option("path", path).format("parquet").saveAsTable(name)
    beams = seekers.select("node", F.array("node").alias("others"), F.array(F.lit(1.0).cast("float")).alias("likeness"), F.array(F.lit(True)).alias("new"))
    own = True
    while True:
        entries = F.expr("filter(sequence(0, size(new) - 1), i -> new[i])")
        beams = beams.withColumn("turn", F.slice(entries, 1, EXPAND))
        last = F.when(F.size("likeness") >= BEAM, F.array_min("likeness")).otherwise(F.lit(-2.0)).cast("float").alias("last")
        front = beams.join(seekers, "node").select(F.col("node").alias("seeker"), "q", last, F.explode(F.expr("transform(turn, i -> others[i])")).alias("node"))
        met = front.join(spark.table(name), "node").select("seeker", "q", "last", "others", "vectors").mapInArrow(_visited(dims), LISTS)
        # the beam begins with the seeker itself, which is no neighbour of its own
        rest = beams.withColumn("new", F.expr("transform(new, (x, i) -> x AND NOT array_contains(turn, i))"))
        lists = met if own else met.unionByName(rest.drop("turn"))
        beams, own = merged(lists, BEAM, "neighbours-beams"), False
        if not beams.where(F.exists("new", lambda x: x)).limit(1).count():
            break
    spark.sql(f"DROP TABLE {name}")
    removed(spark, path)
    return beams


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (padded(batch.column(c)) for c in ("vector", "other_vector"))
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("ids"), pa.array(cosine(a, b))], ["node", "ids", "score"])


def nearest(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, n: int = NEAREST) -> DataFrame:
    """The n rows found nearest by cosine to each row whose id `every` divides: query_id, rank, the id, score.

    Candidates are all rows but those of the query's id, ties go to the smaller id. Vectors that are
    null, zero or hold a null or non-finite component take no part, nor do rows without an id; shorter
    vectors are filled up with zeros; repeated rows are one. Other columns are not read; an empty table
    gives no rows."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & taking_part(F.col("vector")))
    items = nodes(rows, n + 1)
    dims, total = items.agg(F.max(F.octet_length("q")), F.count(F.lit(1))).head()
    dims = dims or 1
    asked = rows.where(F.col("id") % every == 0).distinct().withColumn("key", F.xxhash64("vector")).join(items.select("key", "vector", "node"), ["key", "vector"]).select(F.col("id").alias("query_id"), "node")
    asked = written(asked, "neighbours-queries")
    seekers = written(items.select("node", "q", "vector").join(asked.select("node").distinct(), "node"), "neighbours-seekers")
    beams = searched(items, graph(items, dims, total), seekers.select("node", "q"), dims)
    met = beams.select("node", F.explode(F.slice("others", 1, max(SCORED, 4 * n))).alias("other")).unionByName(seekers.select("node", F.col("node").alias("other")))
    others = items.select(F.col("node").alias("other"), F.col("vector").alias("other_vector"), "ids")
    pairs = met.join(others, "other").join(seekers.select("node", "vector"), "node").select("node", "ids", "vector", "other_vector")
    scored = pairs.mapInArrow(_scored, "node long, ids array<long>, score double")
    # its own node and n others hold the n nearest
    best = scored.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("at") <= n + 1)
    rows = asked.join(best, "node").select("query_id", F.explode("ids").alias("id"), "score").where(F.col("id") != F.col("query_id"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


#: Exact search, to which nearest() is equal where it finds all there is to find; sums go dimension by dimension, as in cosine().
NEAREST_SQL = """
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS MATERIALIZED (SELECT *, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(e, lambda x: x * x)), lambda a, x: a + x)) AS length FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])), lambda x, y: x + y) / (a.length * b.length) AS score FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""
