"""Hard negatives by a vertical scan of integer vectors.

Vectors are kept as blocks of rows with one column of integers a dimension. For each anchor a block's
dimensions are read in the order of the anchor's falling magnitudes. What the rest can still add to a
row's partial score lies between sums of the anchor's components times the block's least and greatest
values; rows whose bounds leave every wanted range drop out of the candidates' bitmap, until the rows
that are left have exact scores.

Anchors are a stated query set against all rows. They go in groups of bounded size: a group is sent to
all tasks, and each task runs through its blocks with the best rows so far, so that a group costs a few
rows an anchor and task. The first scan finds an anchor's positives, the second the negatives of
each positive's window."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh_dir, written

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: Components are floor(SCALE * x); a row whose squares add up to MOST or more takes no part, so that scores are longs and components ints.
SCALE, MOST = 256, 2.0**62
#: Bytes of a block's columns and of a group's anchors; rows of a block.
BLOCK_BYTES, GROUP_BYTES, ROWS = 1 << 22, 1 << 22, 4096
#: The bounds are looked at so often on the way through the dimensions.
LOOKS = 6
BLOCK = "n int, greatest double, ids binary, labels binary, columns array<binary>"
ANCHOR = "id long, label long, vector binary"


@dataclass
class Block:
    """Rows sorted by label; columns is dimensions x rows, and low and high are the least and greatest of each dimension."""

    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        kind = np.float64 if row["greatest"] < 2.0**52 else np.int64  # sums are exact in either
        columns = np.array([np.frombuffer(c, "<i4") for c in row["columns"]], kind).reshape(-1, row["n"])
        return cls(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), columns, columns.min(axis=1), columns.max(axis=1))


def scan(block: Block, anchor: np.ndarray, alive: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows `alive` those that keep() leaves, with their exact scores; keep() takes the rows' lower and upper bounds."""
    dims = min(anchor.size, len(block.columns))
    anchor = anchor[:dims].astype(block.columns.dtype)
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.sort((anchor * block.low[:dims], anchor * block.high[:dims]), axis=0)[:, order]
    rest = np.zeros((2, dims + 1), ends.dtype)
    rest[:, :-1] = np.cumsum(ends[:, ::-1], axis=1)[:, ::-1]
    part = np.zeros(alive.size, ends.dtype)
    step = max(1, -(-dims // LOOKS))
    for at in range(0, dims, step):
        now = order[at : at + step]
        columns = block.columns[now] if alive.size == block.ids.size else block.columns[now[:, None], alive]
        part += anchor[now] @ columns
        least, most = rest[:, min(at + step, dims)]
        ok = keep(part + least, part + most)
        alive, part = alive[ok], part[ok]
        if not alive.size:
            break
    return alive, part.astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n highest scores, ties by smaller id."""
    at = np.lexsort((ids, -scores))[:n]
    return ids[at], scores[at]


def _nth(values: np.ndarray, n: int) -> float | int | None:
    return np.partition(values, values.size - n)[values.size - n] if values.size >= n else None


class Best:
    """The n best rows so far."""

    def __init__(self, n: int) -> None:
        self.n, self.ids, self.scores = n, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        self.ids, self.scores = _best(np.append(self.ids, ids), np.append(self.scores, scores), self.n)

    def floor(self, bound: int | None = None) -> int | None:
        """The score under which no row comes in any more."""
        return int(self.scores[-1]) if self.scores.size == self.n else bound


def window(positive: int) -> tuple[int, int]:
    """The least and greatest score of a negative: at least half of the positive's, at most 95 hundredths."""
    return -(-50 * positive // 100), 95 * positive // 100


def nearest(block: Block, anchor: np.ndarray, alive: np.ndarray, best: Best) -> None:
    """Takes the block's rows into the best."""

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        sure = [x for x in (best.floor(), _nth(lower, best.n)) if x is not None]
        return upper >= max(sure) if sure else np.ones(lower.size, bool)

    rows, scores = scan(block, anchor, alive, keep)
    best.add(block.ids[rows], scores)


def within(block: Block, anchor: np.ndarray, alive: np.ndarray, windows: dict[tuple[int, int], Best]) -> None:
    """Takes the block's rows into the best of each window."""

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        ok = np.zeros(lower.size, bool)
        for (low, high), best in windows.items():
            least = best.floor(low)
            if (sure := _nth(lower[(lower >= low) & (upper <= high)], best.n)) is not None:
                least = max(least, sure)
            ok |= (upper >= least) & (lower <= high)
        return ok

    rows, scores = scan(block, anchor, alive, keep)
    for (low, high), best in windows.items():
        ok = (scores >= low) & (scores <= high)
        best.add(block.ids[rows[ok]], scores[ok])


def matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their components as integers, shorter vectors filled up with zeros."""
    ok = vectors.is_valid().to_numpy(zero_copy_only=False)
    vectors = vectors.filter(vectors.is_valid()).cast(pa.large_list(pa.float64()))
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False) * float(SCALE)
    size = np.diff(offsets)
    row, column = np.repeat(np.arange(size.size), size), np.arange(flat.size) - np.repeat(offsets[:-1] - offsets[0], size)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(flat)
        good = ~(np.bincount(row, flat * flat, minlength=size.size) >= MOST) & (np.bincount(row, ~np.isfinite(flat), minlength=size.size) == 0)
    out = np.zeros((size.size, int(size[good].max(initial=0))), np.int64)
    here = good[row]
    out[row[here], column[here]] = flat[here]
    ok[ok] = good
    return ok, out[good]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok, values = matrix(batch.column("vector"))
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False)[ok].astype("<i8") for c in ("id", "label"))
        rows = max(1, min(ROWS, BLOCK_BYTES // (4 * max(1, values.shape[1]))))
        for at in range(0, ids.size, rows):
            order = at + np.argsort(labels[at : at + rows], kind="stable")
            part = values[order]
            greatest = float((part.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
            columns = [np.ascontiguousarray(c, "<i4").tobytes() for c in part.T]
            yield pa.RecordBatch.from_arrays([pa.array([order.size], pa.int32()), pa.array([greatest]), pa.array([ids[order].tobytes()]), pa.array([labels[order].tobytes()]), pa.array([columns], pa.list_(pa.binary()))], ["n", "greatest", "ids", "labels", "columns"])


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (id, label, vector) as written blocks of columns."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.mapInArrow(_packed, BLOCK).repartition(parts, F.xxhash64("ids")), "negatives-blocks")


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block.of(row)


def _anchors(every: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_in(batches):
            at = np.flatnonzero(block.ids % every == 0)
            vectors = [np.ascontiguousarray(block.columns[:, i], "<i8").tobytes() for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[at]), pa.array(block.labels[at]), pa.array(vectors, pa.binary())], ["id", "label", "vector"])

    return anchors


Anchor = tuple[int, int, np.ndarray]


def _positives(anchors: list[Anchor], n: int):
    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(n) for _ in anchors]
        for block in _blocks_in(batches):
            for (id, label, vector), found in zip(anchors, best, strict=True):
                alive = np.arange(*np.searchsorted(block.labels, (label, label + 1)))
                nearest(block, vector, alive[block.ids[alive] != id], found)
        rows = [(k, i, s) for k, b in enumerate(best) for i, s in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["anchor", "id", "score"])

    return positives


RESULT = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, pair long"


def _negatives(anchors: list[Anchor], positives: list[list[tuple[int, int]]], n: int):
    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [{window(score): Best(n) for _, score in own if window(score)[0] <= window(score)[1]} for own in positives]
        for block in _blocks_in(batches):
            whole = np.arange(block.ids.size)
            for (id, label, vector), windows in zip(anchors, best, strict=True):
                if windows:
                    a, b = np.searchsorted(block.labels, (label, label + 1))
                    alive = np.append(whole[:a], whole[b:])
                    within(block, vector, alive[block.ids[alive] != id], windows)
        rows, pair = [], 0
        for (id, _, _), own, windows in zip(anchors, positives, best, strict=True):
            for positive, score in own:
                pair += 1
                if found := windows.get(window(score)):
                    rows += [(id, positive, score, i, s, pair) for i, s in zip(found.ids.tolist(), found.scores.tolist(), strict=True)]
        names = [c.split()[0] for c in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)

    return negatives


def _ranked(rows: DataFrame, key: str, score: str, id: str, n: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(score), id)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """For each anchor and each of its positives, the hardest rows of other labels in the positive's window.

    Anchors are the rows whose id `every` divides, positives an anchor's nearest rows of its label by integer
    inner product. Rows with a null id, label or vector, with a null or non-finite component, or with
    squares of MOST or more take no part; shorter vectors are filled up with zeros. A row is never a partner
    of an anchor with its own id; other repeated rows count each; repeated anchors are one. Positives at
    or below zero have an empty window, or that of zero alone. Other columns are not read; an empty table
    gives no rows."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")).dropna(subset=["id", "label", "vector"])
    packed = blocks(rows)
    found = packed.mapInArrow(_anchors(every), ANCHOR).dropDuplicates()
    widest, n = (found := written(found, "negatives-anchors")).agg(F.max(F.octet_length("vector")), F.count(F.lit(1))).head()
    groups = max(1, -(-n * (widest or 8) // GROUP_BYTES))
    path = fresh_dir(spark, "negatives")
    for group in range(groups):
        taken = found.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == group).toArrow().to_pylist()
        anchors = [(r["id"], r["label"], np.frombuffer(r["vector"], "<i8")) for r in taken]
        first = _ranked(packed.mapInArrow(_positives(anchors, positives), "anchor long, id long, score long"), "anchor", "score", "id", positives)
        near: list[list[tuple[int, int]]] = [[] for _ in anchors]
        for r in sorted(first.toArrow().to_pylist(), key=lambda r: r["rank"]):
            near[r["anchor"]].append((r["id"], r["score"]))
        hard = _ranked(packed.mapInArrow(_negatives(anchors, near, negatives), RESULT), "pair", "negative_score", "negative_id", negatives)
        hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    return spark.read.parquet(path)


NEGATIVES_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor_id) WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
