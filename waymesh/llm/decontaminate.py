"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF, with document frequencies over the
whole corpus. A randomised SVD, whose products with the passage matrix are Spark jobs, gives a
latent space; every window of every document is folded into it and compared with all passages by
cosine. What comes near is checked in the text: the longest common subsequence of words of the item
and of stretches about as long there, and by itself that of the item's answer, its last words.

The benchmark is the query set. Each block of items has a latent space of its own. The corpus is read
once for as many blocks as have SCAN_TERMS terms in all, so that what tasks share (terms by latent
dimensions) is bounded whatever the benchmark's size."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

WORD = re.compile(r"[^\W_]+")
#: Items searched at a time, and words of a passage at most.
BLOCK, PASSAGE = 256, 48
#: Terms of the blocks that are searched in one scan, a block at least.
SCAN_TERMS = 1 << 16
#: Longer items are checked once for all places of a fifth of their length, not at each.
LONG_ITEM = 8 * PASSAGE
#: Words of a step and steps of a window of a document.
STEP, STEPS = 16, 4
#: Latent dimensions at most, the share of energy they keep, and further dimensions of the sketch.
RANK, ENERGY, SPARE, POWERS, SEED = 256, 0.95, 8, 2, 11
#: A passage that the space keeps less of adds a dimension, for RANK passages at most: the rest have more candidates, not fewer.
KEPT = 0.5
#: The heaviest terms of a passage that hold that share of its squared weight are its terms; common words that are nobody's cost nothing.
MASS = 0.95
#: A candidate window is at least so near a passage by cosine, and reaches at least that far along it, of the passage's own length.
COSINE, WEIGHT = 0.15, 0.35
COMMON, ANSWER, ANSWER_WORDS = 0.6, 0.5, 0.25
ROWS_A_TIME = 4096


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := at.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class Block:
    """Items of a block with words, their passages (number of the item, words), and the terms."""

    items: list[tuple[int | None, list[str]]]
    passages: list[tuple[int, list[str]]]
    terms: dict[str, int]


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK items, dealt by a hash; only one is on the driver at a time."""
    n = benchmark.count()
    many = -(-n // BLOCK)
    dealt = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(many, 1))).alias("block"))
    for k in range(many):
        rows = dealt.where(F.col("block") == k).select("item_id", "text").distinct().collect()
        items = [(r.item_id, w) for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text or "")) if (w := words(r.text))]
        if not items:
            continue
        passages = []
        for i, (_, w) in enumerate(items):
            parts = -(-len(w) // PASSAGE)
            passages += [(i, w[len(w) * p // parts : len(w) * (p + 1) // parts]) for p in range(parts)]
        terms = {w: i for i, w in enumerate(sorted({w for _, item in items for w in item}))}
        yield Block(items, passages, terms)


def document_frequencies(documents: DataFrame, terms: set[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each term occurs, over all documents, and how many there are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                counts.update(terms.intersection(words(text)))
        rows = [*counts.items(), (None, n)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], ["word", "n"])

    found = {r.word: r.n for r in documents.select(text_col).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop(None, 0)


def randomised_svd(matrix: DataFrame, n_terms: int, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (terms by dimensions) of a matrix with rows (terms: array of int, weights: array of double).

    A random sketch of the row space is improved by power steps. Each step's product with the matrix
    and its transpose is summed in the tasks and then by term; the orthogonal factor is taken on the
    driver, of n_terms by rank numbers."""
    sketch = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n_terms, min(rank + SPARE, n_terms))))[0]

    def product(q: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = np.zeros_like(q)
            for batch in batches:
                for t, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    z[t] += np.outer(w, np.asarray(w) @ q[t])
            some = np.flatnonzero(z.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([z[i].tobytes() for i in some.tolist()], pa.binary())], ["term", "row"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z: dict[int, np.ndarray] = {}
            for batch in batches:
                for t, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    z[t] = z.get(t, 0) + np.frombuffer(row)
            yield pa.RecordBatch.from_arrays([pa.array(list(z), pa.int64()), pa.array([x.tobytes() for x in z.values()], pa.binary())], ["term", "row"])

        out = np.zeros_like(q)
        for r in matrix.mapInArrow(partial, "term long, row binary").repartition("term").mapInArrow(summed, "term long, row binary").collect():
            out[r.term] = np.frombuffer(r.row)
        return out

    for _ in range(POWERS):
        sketch = np.linalg.qr(product(sketch))[0]
    values, vectors = np.linalg.eigh(sketch.T @ product(sketch))
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    keep = int(np.searchsorted(np.cumsum(values), ENERGY * values.sum())) + 1
    keep = min(keep, rank, int((values > 1e-9 * max(values[0], 1e-30)).sum()) or 1)
    return sketch @ vectors[:, :keep]


@dataclass(frozen=True)
class Index:
    block: Block
    #: The number of each term, and its latent vector with its weight.
    known: dict[str, int]
    terms: np.ndarray
    #: The latent vector of each passage, of length one, and the lengths before.
    passages: np.ndarray
    lengths: np.ndarray


def _with_residues(vectors: np.ndarray, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
    """The singular vectors, and further orthogonal ones of the passages of which they keep too little."""
    poor = []
    for t, w in rows:
        w = np.asarray(w)
        inside = w @ vectors[t]
        if inside @ inside < KEPT * (w @ w) and len(poor) < RANK:
            rest = -(vectors @ inside)
            rest[t] += w
            poor.append(rest)
    if not poor:
        return vectors
    q, r = np.linalg.qr(np.array(poor).T)
    more = q[:, np.abs(np.diag(r)) > 1e-6 * np.abs(r).max()]
    return np.concatenate((vectors, more), axis=1)


def _heaviest(weights: dict[str, float]) -> list[str]:
    """The words of most weight that hold MASS of the squared weight; ties by word."""
    left, out = (1 - MASS) * sum(x * x for x in weights.values()), []
    for w in sorted(weights, key=lambda w: (weights[w], w)):
        left -= weights[w] ** 2
        if left < 0:
            out.append(w)
    return out


def index(spark: SparkSession, block: Block, frequency: dict[str, int], n: int) -> Index:
    """The latent space of a block's passages, with document frequencies of its terms among n documents."""
    weights = {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1e-3 for w in block.terms}
    heavy = [_heaviest({w: weights[w] for w in p}) for _, p in block.passages]
    known = {w: i for i, w in enumerate(sorted(set().union(*heavy)))}
    weight = np.array([weights[w] for w in known])
    rows = [(t, weight[t].tolist()) for t in (sorted(map(known.__getitem__, p)) for p in heavy)]
    vectors = randomised_svd(spark.createDataFrame(rows, "terms array<int>, weights array<double>").repartition(4), len(known))
    vectors = _with_residues(vectors, rows)
    latent = np.array([np.asarray(w) @ vectors[t] for t, w in rows])
    lengths = np.maximum(np.linalg.norm(latent, axis=1), 1e-12)
    return Index(block, known, (vectors * weight[:, None]).astype(np.float32), (latent / lengths[:, None]).astype(np.float32), lengths.astype(np.float32))


def _checked(item: list[str], text: list[str], at: int, reach: int = 0) -> tuple[float, float]:
    """The best share of the item, and with it of its answer, that stretches near a place, or one of the `reach` after it, have as a common subsequence."""
    n = len(item)
    answer = item[-max(3, math.ceil(n * ANSWER_WORDS)) :]
    near = text[max(0, at - n) : at + reach + STEP * STEPS + n]
    size, step, best = math.ceil(1.3 * n) + 4, max(1, n // 5), (0.0, 0.0)
    known = set(item)
    marks = [w in known for w in near]
    for a in range(0, max(1, len(near) - size + step), step):
        if sum(marks[a : a + size]) < max(COMMON, best[0]) * n:
            continue
        part = near[a : a + size]
        share = common_subsequence(item, part) / n
        if share > best[0]:
            best = (share, common_subsequence(answer, part) / len(answer))
    return best


def _summed(rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, each from a head to the next; all runs a row at a time, as they are short."""
    length = np.diff(np.append(heads, len(rows)))
    out = rows[heads]
    for k in range(1, int(length.max())):
        some = np.flatnonzero(length > k)
        out[some] += rows[heads[some] + k]
    return out


def _windows(ids: np.ndarray, none: int, steps: int, terms: np.ndarray) -> np.ndarray:
    """The latent vector of the window that starts at each step; a term counts once in a window.

    An occurrence counts in the windows that reach it and begin after the one before it of the same
    term: it is added where the first of them begins, and taken away after the last."""
    here = np.flatnonzero(ids != none)
    key = np.unique(ids[here].astype(np.int64) * steps + here // STEP)
    term, step = key // steps, key % steps
    after = np.where(np.concatenate(([False], term[1:] == term[:-1])), np.concatenate(([0], step[:-1])) + 1, 0)
    change = np.zeros((steps + 1, terms.shape[1]), np.float32)
    for at, sign in ((np.maximum(np.maximum(step - STEPS + 1, 0), after), 1), (step + 1, -1)):
        order = np.argsort(at, kind="stable")
        at = at[order]
        heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        change[at[heads]] += sign * _summed(terms[term[order]], heads)
    return np.cumsum(change, axis=0, dtype=np.float32)[:steps]


def leaks_of(found: Index, split: list[list[str]]) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, cosine, share, answer share) of every item that a text, given by its words, has; once each with its best share."""
    known, size = found.known, len(found.known)
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    steps = [-(-len(w) // STEP) for w in split]
    a = 0
    while a < len(split):  # some texts, or a single one
        b, rows = a + 1, steps[a]
        while b < len(split) and rows + steps[b] <= ROWS_A_TIME:
            rows += steps[b]
            b += 1
        ids = np.full((rows + (b - a) * (STEPS - 1), STEP), size, np.int32).ravel()
        first = []
        at = 0
        for i in range(a, b):
            w = split[i]
            ids[at * STEP : at * STEP + len(w)] = list(map(known.get, w, repeat(size)))
            first.append(at)
            at += steps[i] + STEPS - 1
        if (ids != size).any():
            window = _windows(ids, size, at, found.terms)
            norm = np.sqrt(np.einsum("ij,ij->i", window, window))
            heavy = np.flatnonzero(norm >= WEIGHT * found.lengths.min())
            along = window[heavy] @ found.passages.T
            r, p = np.nonzero(along >= WEIGHT * found.lengths)
            cosine = along[r, p] / norm[heavy[r]]
            near = cosine >= COSINE
            done: set[tuple[int, int, int]] = set()
            for r, p, c in zip(heavy[r[near]].tolist(), p[near].tolist(), cosine[near].tolist(), strict=True):
                i, item = a + bisect_right(first, r) - 1, found.block.passages[p][0]
                place = max(0, r - first[i - a]) * STEP
                reach, asked = 0, found.block.items[item][1]
                if len(asked) > LONG_ITEM:
                    reach = len(asked) // 5
                    place -= place % reach
                if (i, item, place) in done:
                    continue
                done.add((i, item, place))
                share, answer = _checked(asked, split[i], place, reach)
                if share >= COMMON and answer >= ANSWER and share > out.get((i, item), (0, 0, 0))[1]:
                    out[i, item] = (c, share, answer)
        a = b
    return ((i, item, *v) for (i, item), v in sorted(out.items()))


RESULT = "doc_id long, item_id long, cosine double, common double, answer double"


def _scans(benchmark: DataFrame) -> Iterator[list[Block]]:
    """Blocks that one scan takes, one after the other."""
    held: list[Block] = []
    for block in blocks(benchmark):
        if held and sum(len(b.terms) for b in held) + len(block.terms) > SCAN_TERMS:
            yield held
            held = []
        held.append(block)
    if held:
        yield held


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row and item it has: doc_id, item_id, cosine, common and answer (shares of the item's and its answer's words in order).

    Texts that are null or have no words have no rows, nor have such items. Null ids stay null;
    repeated document rows give repeated rows, repeated items one. Without a benchmark or documents
    the result is empty. Other columns are not read."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    every = spark.createDataFrame([], RESULT)
    for scan in _scans(benchmark):
        frequency, n = document_frequencies(documents, set().union(*(b.terms for b in scan)), text_col)
        every = every.unionByName(_searched(rows, [index(spark, b, frequency, n) for b in scan]))
    return every


def _searched(rows: DataFrame, found: list[Index]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                split = [words(t) for t in part.column(1).to_pylist()]
                ids = part.column(0).to_pylist()
                hits = [(ids[i], x.block.items[j][0], *v) for x in shared.value for i, j, *v in leaks_of(x, split)]
                columns = zip(*hits, strict=True) if hits else [()] * 5
                kinds = [pa.int64()] * 2 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(searched, RESULT)
