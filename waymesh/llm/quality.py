"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's potentials come from its own shape (capitals, symbols, digits,
repeated words, ...) and from that of the lines before and after it; a transition matrix couples
neighbours. The score of a document is the mean over its lines, weighted by their length, of the
forward-backward marginal of "good". The field is trained here, on a bounded sample of labelled
documents whose lines all carry the document's label."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import byte_view, prefix_hash, span_hash

#: At most so many labelled documents train the field; the rest of the corpus is scored, never sampled.
TRAIN_DOCS, TRAIN_LINES, TRAIN_BYTES = 4000, 200_000, 1 << 26
THRESHOLD = 0.3
PIECE = 1 << 20
#: Lines of a long text that are summed one after the other.
SEGMENT = 512

_SPACE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _LEAD = range(7)
_CLASS = np.full(256, _LOWER, np.uint8)
_CLASS[33:127], _CLASS[0xC0:] = _SYMBOL, _LEAD
_CLASS[[ord(c) for c in ",.;:'-\""]] = _STOP
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = _DIGIT, _UPPER, _LOWER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
OWN, AROUND = 12, 4
FEATURES = 1 + OWN + 2 * AROUND


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return x / np.maximum(of, 1)


def line_features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts: features, the text's number, and the length in bytes. A text without bytes has one empty line."""
    n = starts.size - 1
    text = np.full(data.size + n, 10, np.uint8)
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        text[a + i : b + i] = data[a:b]
    end = np.flatnonzero(text == 10)
    begin = np.concatenate(([0], end[:-1] + 1))
    doc = np.searchsorted(starts[1:] + np.arange(n), end)

    kind = _CLASS[text]
    after_c3 = np.flatnonzero(text[:-1] == 0xC3) + 1
    kind[after_c3[(text[after_c3] >= 0x80) & (text[after_c3] <= 0x9E)]] = _UPPER

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(text.size + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return sums[end] - sums[begin]

    size = end - begin
    upper, lower, digit, symbol = (count(kind == k) for k in (_UPPER, _LOWER, _DIGIT, _SYMBOL))
    inside = kind != _SPACE
    first = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    last = np.flatnonzero(inside & np.concatenate((~inside[1:], [True]))) + 1
    sums = prefix_hash(text)
    word, line = span_hash(sums, first, last), np.searchsorted(end, first)
    words = np.bincount(line, minlength=end.size)
    again = np.zeros((2, end.size))
    for k in (1, 2):
        same = (word[k:] == word[:-k]) & (line[k:] == line[:-k])
        again[k - 1] = np.bincount(line[k:][same], minlength=end.size)
    marks = np.zeros(text.size + 1, np.int32)
    np.cumsum((kind == _SYMBOL) | (kind == _STOP), out=marks[1:])
    bare = np.bincount(line[marks[last] - marks[first] == last - first], minlength=end.size)
    marked = np.bincount(line[kind[last - 1] == _SYMBOL], minlength=end.size)
    whole = span_hash(sums, begin, end) ^ doc.astype(np.uint64)
    _, where, many = np.unique(whole, return_inverse=True, return_counts=True)
    closed = np.isin(text[np.maximum(end - 1, 0)], np.frombuffer(b".!?", np.uint8)) & (size > 0)

    x = np.zeros((end.size, FEATURES), np.float32)
    x[:, 0] = 1
    x[:, 1] = _share(upper, upper + lower)
    x[:, 2], x[:, 3] = _share(symbol, size), _share(digit, size)
    x[:, 4], x[:, 5] = _share(again[0], words), _share(again[1], words)
    x[:, 6], x[:, 7] = _share(bare, words), _share(marked, words)
    x[:, 8], x[:, 9] = np.log1p(words) / 5, np.minimum(_share(size, words) / 20, 2)
    x[:, 10], x[:, 11], x[:, 12] = (many[where] > 1) & (size > 0), closed, size == 0
    same = doc[1:] == doc[:-1]
    around = x[:, [1, 2, 4, 6]]
    x[1:, 1 + OWN : 1 + OWN + AROUND] = around[:-1] * same[:, None]
    x[:-1, 1 + OWN + AROUND :] = around[1:] * same[:, None]
    return x, doc, size


@dataclass(frozen=True)
class Field:
    """Weights of "good" against "bad" for each feature, and transition[y, y'] from a line to the next."""

    weights: np.ndarray
    transition: np.ndarray


def _positions(doc: np.ndarray) -> list[np.ndarray]:
    """For each position, the lines that stand there, in order of falling length of their text; and so each a prefix of the one before."""
    begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    length = np.diff(np.append(begin, doc.size))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    return [begin[: int(np.searchsorted(-length, -t, side="left"))] + t for t in range(int(length[0]))]


def marginals(field: Field, x: np.ndarray, doc: np.ndarray, at: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transition counts, and the sum of log partition functions."""
    at = at or _positions(doc)
    score = np.stack((np.zeros(doc.size), x @ field.weights), axis=1)
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[at[0]] = score[at[0]]
    for before, now in zip(at, at[1:], strict=False):
        ahead[now] = np.logaddexp.reduce(ahead[before[: now.size], :, None] + field.transition, axis=1) + score[now]
    for now, after in zip(at[-2::-1], at[:0:-1], strict=True):
        behind[now[: after.size]] = np.logaddexp.reduce(field.transition + (score[after] + behind[after])[:, None, :], axis=2)
    total = np.logaddexp.reduce(ahead[at[0]] + behind[at[0]], axis=1)
    z = np.zeros(doc.size)
    pairs = np.zeros((2, 2))
    z[at[0]] = total
    for before, now in zip(at, at[1:], strict=False):
        z[now] = total[: now.size]
        joint = ahead[before[: now.size], :, None] + field.transition + (score[now] + behind[now])[:, None, :] - z[now][:, None, None]
        pairs += np.exp(joint).sum(axis=0)
    return np.exp(ahead[:, 1] + behind[:, 1] - z), pairs, float(total.sum())


def line_marginals(field: Field, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """P(good) of each line, as marginals(), in as many steps as SEGMENT and the segments of the longest text, not as its lines.

    Texts are cut into segments of SEGMENT lines. Forwards and backwards sums over a segment are a
    2 x 2 matrix, the product of those of its lines; products of a text's segments give what stands
    before and after each, from where the lines inside are summed for all segments at once."""
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    begin = np.flatnonzero(first)
    place = np.arange(doc.size) - np.repeat(begin, np.diff(np.append(begin, doc.size)))
    heads = np.flatnonzero(place % SEGMENT == 0)
    if heads.size == begin.size:
        return marginals(field, x, doc)[0]
    of = np.repeat(np.arange(heads.size), np.diff(np.append(heads, doc.size)))
    at, steps = _positions(of), _positions(doc[heads])
    score = np.stack((np.zeros(doc.size), x @ field.weights), axis=1)
    enters = np.where(first[heads][:, None, None], 0.0, field.transition)  # from the line before, if there is one
    product = np.empty((heads.size, 2, 2))
    order = of[at[0]]
    moved = enters[order] + score[at[0]][:, None, :]
    for now in at[1:]:
        moved[: now.size] = np.logaddexp.reduce(moved[: now.size, :, :, None] + (field.transition + score[now][:, None, :])[:, None], axis=2)
    product[order] = moved
    before, after = np.zeros((heads.size, 2)), np.zeros((heads.size, 2))
    before[first[heads], 1] = -np.inf
    for earlier, later in zip(steps, steps[1:], strict=False):
        before[later] = np.logaddexp.reduce(before[earlier[: later.size], :, None] + product[earlier[: later.size]], axis=1)
    for earlier, later in zip(steps[-2::-1], steps[:0:-1], strict=True):
        after[earlier[: later.size]] = np.logaddexp.reduce(product[later] + after[later][:, None, :], axis=2)
    ahead, behind = np.zeros_like(score), after[of]
    ahead[at[0]] = np.logaddexp.reduce(before[order][:, :, None] + enters[order], axis=1) + score[at[0]]
    for earlier, now in zip(at, at[1:], strict=False):
        ahead[now] = np.logaddexp.reduce(ahead[earlier[: now.size], :, None] + field.transition, axis=1) + score[now]
    for now, later in zip(at[-2::-1], at[:0:-1], strict=True):
        behind[now[: later.size]] = np.logaddexp.reduce(field.transition + (score[later] + behind[later])[:, None, :], axis=2)
    both = ahead + behind
    return np.exp(both[:, 1] - np.logaddexp.reduce(both, axis=1))


def fitted(x: np.ndarray, doc: np.ndarray, label: np.ndarray, steps: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood with a quadratic penalty, by full-batch gradient steps of adapted size; label is given per line."""
    if not doc.size:
        return Field(np.zeros(FEATURES), np.zeros((2, 2)))
    at, texts = _positions(doc), len(np.unique(doc))
    seen = np.zeros((2, 2))
    for before, now in zip(at, at[1:], strict=False):
        np.add.at(seen, (label[before[: now.size]], label[now]), 1)
    theta, mean, square = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for step in range(1, steps + 1):
        p, pairs, _ = marginals(Field(theta[:FEATURES], theta[FEATURES:].reshape(2, 2)), x, doc, at)
        slope = np.concatenate(((label - p) @ x, (seen - pairs).ravel())) / texts - decay * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def _pieces(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about a megabyte."""
    a = 0
    while a < starts.size - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + PIECE, side="right")) - 1)
        yield a, b
        a = b


def document_scores(field: Field, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros(starts.size - 1)
    for a, b in _pieces(starts):
        x, doc, size = line_features(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        p = line_marginals(field, x, doc)
        weight = size + 1e-6
        out[a:b] = np.bincount(doc, p * weight) / np.bincount(doc, weight)
    return np.clip(out, 0, 1)


def score(field: Field, text: Column) -> Column:
    """The quality of a text, 0 to 1; null counts as empty, and an empty text scores as one empty line."""

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(document_scores(field, *byte_view(column)))

    return scored(text)


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text is a multiple of five. A null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, lines: int = TRAIN_LINES, size: int = TRAIN_BYTES) -> Field:
    """The field from at most `limit` labelled documents (those of least hash of their id) outside the held-out fifth, and of these
    from as many, in the same order, as have `lines` lines and `size` bytes together; a document of more than a hundredth of either is left out of the sample.

    Labels that are null are skipped; of repeated labels of an id the least counts, of repeated ids the text of least hash.
    Without any labelled document all scores are 0.5. Only the sample's line features reach the driver."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").alias("train_id"), F.col("quality").cast("int").alias("label"))
    texts = documents.select(F.col("doc_id").alias("train_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "train_id")
    texts = texts.groupBy("train_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("train_id", "label", "least.text")
    # Counted after the grouping, so that the filter is not pushed down to the texts of all documents.
    texts = texts.withColumn("lines", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")).withColumn("bytes", F.octet_length("text").cast("long"))
    texts = texts.where((F.col("lines") <= max(1, lines // 100)) & (F.col("bytes") <= max(1, size // 100)))
    upto = Window.orderBy(F.xxhash64("train_id"), "train_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    texts = texts.withColumns({"_lines": F.sum("lines").over(upto), "_bytes": F.sum("bytes").over(upto)}).where((F.col("_lines") <= lines) & (F.col("_bytes") <= size)).select("train_id", "text", "label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, doc, _ = line_features(*byte_view(batch.column(1)))
            rows = [x[doc == i].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["id", "label", "x"])

    rows = texts.mapInArrow(features, "id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r.id, r.label, r.x))
    each = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    lines = [len(x) for x in each]
    x = np.concatenate(each) if each else np.zeros((0, FEATURES), np.float32)
    return fitted(x.astype(np.float64), np.repeat(np.arange(len(rows)), lines), np.repeat([r.label for r in rows], lines).astype(int))


def with_quality(documents: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score and predicted. Ties, repeated rows and other columns have no influence; an empty table gives no rows."""
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(field, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
