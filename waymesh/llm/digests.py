"""Fingerprints of whole texts by improbable features.

Each window of 32 bytes has an entropy. How often each entropy occurs over the corpus ranks the
windows: the rarer, the lower the rank. Along the text, in every neighbourhood of 32 windows the
leftmost of least rank scores; windows with enough points are the text's features. They set five
bits each in Bloom filters of 2048 bits, a new filter being chained after every 160 features. Two
digests are compared by the bits their filters share, beyond what chance gives, in units of the
most there can be."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import byte_view, mixed

WINDOW, AROUND, POINTS = 32, 32, 8
BITS, HASHES, FEATURES = 2048, 5, 160
#: Bytes of a small window.
SMALL = 8
#: Texts of at most so many bytes, or with fewer features than that, also have filters of their small windows, which are compared where both texts have them.
SHORT, FEW = 256, 4
_SCALE = 1 << 16
PIECE, ROWS = 1 << 18, 4096
#: Ranges of documents at most, and the keys for each that are looked at to cut them.
PARTS, PICKS = 1 << 16, 10
#: Bytes of a text by which documents of one id are told apart when ranges are cut.
PREFIX = 64

_terms = np.concatenate(([0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))))
#: What one more of a byte adds to the sum of n log n over a window that has n of it, as an integer.
_GAIN = np.round(np.diff(_terms) * _SCALE).astype(np.int64)
LEVELS = 512


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The entropy of every window, 0 to LEVELS - 1. Counts of equal bytes within a window's reach come from comparing the data with itself at each distance."""
    n = data.size
    if n < WINDOW:
        return np.zeros(0, np.int64)
    earlier, later = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        earlier[d:] += same
        later[:-d] += same
    comes, goes = _GAIN[earlier], _GAIN[later]
    total = np.cumsum(comes)[WINDOW - 1 :]
    total[1:] -= np.cumsum(goes)[: n - WINDOW]
    most = WINDOW * np.log2(WINDOW) * _SCALE
    return ((1 - np.clip(total / most, 0, 1)) * (LEVELS - 1) + 0.5).astype(np.int64)


def _inside(starts: np.ndarray, n: int, reach: int) -> np.ndarray:
    """Marks the first n places whose next `reach` bytes are in one text."""
    edge = np.zeros(n + 1, np.int32)
    lengths = np.diff(starts)
    fits = lengths >= reach
    np.add.at(edge, starts[:-1][fits], 1)
    np.add.at(edge, starts[1:][fits] - reach + 1, -1)
    return np.cumsum(edge[:n]) > 0


def level_counts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    levels = entropy_levels(data)
    return np.bincount(levels[_inside(starts, levels.size, WINDOW)], minlength=LEVELS)


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each level: rare levels low, those of flat windows (no entropy) last; ties by level."""
    order = np.lexsort((np.arange(LEVELS), counts))
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    rank[0] = LEVELS
    return rank


def small_windows(text: np.ndarray) -> np.ndarray:
    """Hashes of the different windows of SMALL bytes that end in the text, in order of their first places; zeros stand before it."""
    if not text.size:
        return np.zeros(0, np.uint64)
    text = np.concatenate((np.zeros(SMALL - 1, np.uint8), text))
    grams = np.lib.stride_tricks.sliding_window_view(text, SMALL).copy().view(np.uint64)[:, 0]
    return mixed(grams[np.sort(np.unique(grams, return_index=True)[1])] ^ np.uint64(SMALL))


def features(data: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hash of every feature, in order of place; texts shorter than a window and a neighbourhood have none."""
    levels = entropy_levels(data)
    if levels.size < AROUND:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = rank[levels] * np.int64(1 << 40) + np.arange(levels.size)
    step = 1
    while step < AROUND:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    ok = _inside(starts, low.size, WINDOW + AROUND - 1)
    points = np.bincount(low[ok] & ((1 << 40) - 1), minlength=levels.size)
    place = np.flatnonzero((points >= POINTS) & (levels > 0))
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[place].copy().view(np.uint64)
    h = np.full(place.size, WINDOW, np.uint64)
    for k in range(words.shape[1]):
        h = mixed(h ^ words[:, k])
    return np.searchsorted(starts, place, side="right") - 1, h


#: The chained filters of a text's features and those of its small windows, each as rows of BITS / 8 bytes.
Digest = tuple[np.ndarray, np.ndarray]


def _filters(text: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each of n texts, the chained filters of its hashes; rows are in order of text."""
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    place = np.arange(text.size) - np.repeat(first, count)
    filters = -(-count // FEATURES)
    base = np.cumsum(filters) - filters
    row = np.repeat(base, count) + place // FEATURES
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for k in range(HASHES):
        bits[row, (h >> np.uint64(11 * k)) % np.uint64(BITS)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a : a + k] for a, k in zip(base.tolist(), filters.tolist(), strict=True)]


def digests(data: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> list[Digest]:
    """A digest of each text; that of an empty text has no rows. Short texts and those with few features have both kinds of filters, others features alone."""
    n = starts.size - 1
    text, h = features(data, starts, rank)
    lengths = np.diff(starts)
    both = np.flatnonzero((lengths > 0) & ((lengths <= SHORT) | (np.bincount(text, minlength=n) < FEW)))
    grams = [small_windows(data[starts[i] : starts[i + 1]]) for i in both.tolist()]
    small = _filters(np.repeat(both, [g.size for g in grams]), np.concatenate([np.zeros(0, np.uint64), *grams]), n)
    return list(zip(_filters(text, h, n), small, strict=True))


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1, by the filters of small windows if both texts have them, else by those of features.

    Over the filters of the shorter digest, the mean of the best overlap with a filter of the other,
    weighted by their bits. An overlap is what two filters share beyond chance, over the most they can,
    or over half the bits of the first where the second has fewer. Two empty texts are alike, an empty
    and another are not."""
    if not (any(map(len, a)) and any(map(len, b))):
        return float(any(map(len, a)) == any(map(len, b)))
    a, b = (a[1], b[1]) if len(a[1]) and len(b[1]) else (a[0], b[0])
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    set_a, set_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    out = []
    for x, n in zip(np.ascontiguousarray(a).view(np.uint64), set_a.tolist(), strict=True):
        shared = np.bitwise_count(np.ascontiguousarray(b).view(np.uint64) & x).sum(axis=1, dtype=np.int64)
        chance = n * set_b / BITS
        most = np.maximum(np.minimum(n, set_b), n / 2)
        out.append(float(np.max(np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1))))
    return float(np.average(out, weights=set_a))


def corpus_ranks(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the levels from the windows of all texts; only the LEVELS counts of each task leave it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, np.int64)
        for batch in batches:
            data, starts = byte_view(batch.column(0))
            for a, b in _pieces(starts):
                counts += level_counts(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(counts)], ["level", "n"])

    rows = documents.select(text_col).mapInArrow(counted, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for r in rows:
        counts[r.level] = r.n
    return ranks(counts)


def _pieces(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < starts.size - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + PIECE, side="right")) - 1)
        yield a, b
        a = b


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def digests_of(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    data, starts = _joined(texts)
    return [d for a, b in _pieces(starts) for d in digests(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], rank)]


def fingerprint(digest: Digest) -> str:
    """Hexadecimal, the filters of small windows, if any, after a point."""
    return ".".join(x.tobytes().hex() for x in (digest if len(digest[1]) else digest[:1]))


def with_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals the documents to ranges of ids, and to each range also the documents that follow its last one.

    Columns part, lead (true for what is there only to follow), id and text. The order is by falling
    id, nulls last, then by text; after the last comes the first. Ranges are of the id and the first
    PREFIX bytes of the text, so many documents of one id, or none, are split too. They are cut by a
    sample of about PARTS x PICKS keys at most, which decides on the ranges' sizes alone; a key a
    range reaches the driver besides."""
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("head", F.substring(F.col("text").cast("binary"), 1, PREFIX))
    parts = min(PARTS, 3 * max(1, rows.rdd.getNumPartitions()))
    total = rows.count()
    keys = rows.select("id", "head").where(F.pmod(F.xxhash64("id", "text"), F.lit(max(1, total // (parts * PICKS)))) == 0).limit(2 * PARTS * PICKS).toArrow()
    sample = np.sort(_keys(*(c.combine_chunks() for c in keys.columns)))
    cuts = np.unique(sample[np.arange(1, parts) * sample.size // parts]) if sample.size else sample

    @F.arrow_udf(T.IntegerType())
    def part(ids: pa.Array, heads: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, _keys(ids, heads), side="right").astype(np.int32))

    dealt = rows.withColumn("part", part("id", "head"))
    order = F.struct(F.col("id").isNull(), -F.col("id").cast("decimal(20)"), "head")
    tops = sorted((r.part, r.top.id, r.top.head) for r in dealt.groupBy("part").agg(F.min_by(F.struct("id", "head"), order).alias("top")).collect())
    # The first document of each range also ends the range before, and that of the first range the last.
    ends = documents.sparkSession.createDataFrame([(p, i, h, tops[k - 1][0]) for k, (p, i, h) in enumerate(tops)], "part int, top_id long, top_head binary, before int")
    dealt = dealt.join(F.broadcast(ends), "part")  # a row for each range, PARTS at most
    own = F.struct(F.col("part"), F.lit(False).alias("lead"))
    also = F.struct(F.col("before").alias("part"), F.lit(True).alias("lead"))
    first = F.col("id").eqNullSafe(F.col("top_id")) & (F.col("head") == F.col("top_head"))
    spread = dealt.select("id", "text", F.explode(F.when(first, F.array(own, also)).otherwise(F.array(own))).alias("at"))
    return spread.select("at.part", "at.lead", "id", "text")


def _keys(ids: pa.Array, heads: pa.Array) -> np.ndarray:
    """Keys that sort as the documents: whether the id is null, the id falling, the head of the text; bytes of one length."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ids), 9 + PREFIX), np.uint8)
    out[:, 0] = null
    falling = ~(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63))
    out[:, 1:9] = np.where(null, np.uint64(0), falling).astype(">u8").view(np.uint8).reshape(-1, 8)
    data, starts = byte_view(heads)
    size = np.diff(starts)
    row = np.repeat(np.arange(size.size), size)
    out[row, 9 + np.arange(data.size) - starts[:-1][row]] = data
    return out.view(f"S{9 + PREFIX}")[:, 0]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rank: np.ndarray):
    def rows(held: list[tuple[int | None, str]], after: str) -> pa.RecordBatch:
        texts = [t for _, t in held] + [after]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:], strict=False)]
        raw = [t.encode() for t in texts]
        raw_edited = [t.encode() for t in edited]
        plain, changed = digests_of(raw, rank), digests_of(raw_edited, rank)
        columns = [
            pa.array([i for i, _ in held], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in raw_edited], pa.string()),
            pa.array([fingerprint(d) for d in plain[:-1]], pa.string()), pa.array([fingerprint(d) for d in changed], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(plain, changed, strict=False)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(plain, plain[1:], strict=False)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        part, ended, size = None, False, 0
        for batch in batches:
            for p, lead, i, text in zip(*(batch.column(c).to_pylist() for c in ("part", "lead", "id", "text")), strict=True):
                if p != part:
                    held, part, ended, size = [], p, False, 0
                if lead:
                    if held and not ended:
                        yield rows(held, text)
                    held, ended = [], True
                    continue
                held.append((i, text))
                size += len(text)
                if len(held) > 1 and (size > PIECE or len(held) > ROWS):
                    yield rows(held[:-1], held[-1][1])
                    held, size = held[-1:], len(text)

    return compared


def edited_likeness(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the fingerprints of the text and of the text whose last half the next document's start replaces, and how alike the text is to that and to the next text.

    The next document is the one with the next smaller id; rows with one id go by text, null ids
    come last, and after the last comes the first. Null counts as empty; an empty text has an empty
    fingerprint. A single row is its own next. An empty table gives no rows; other columns are not read."""
    rank = corpus_ranks(documents, text_col)
    dealt = with_next(documents, id_col, text_col)
    ordered = dealt.repartition("part").sortWithinPartitions("part", "lead", F.desc_nulls_last("id"), "text")
    return ordered.mapInArrow(_compared(rank), RESULT)
