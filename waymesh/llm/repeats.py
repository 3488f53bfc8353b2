"""Exact repeats of long byte strings, by suffix arrays over shards dealt by content.

Every window of 400 bytes has an anchor, a shorter string in it that its bytes alone determine (the
one of least hash). Windows that follow each other share anchors, so a text is a few stretches, each
with the windows of one anchor; equal windows lie in stretches with equal anchors. Only anchors that
occur twice matter. Of each such anchor the different stretches go once, whatever number of texts
hold them, to the shard that the anchor names; there one suffix array over all stretches is built by
induced sorting, and permuted common prefixes show which windows occur twice. The result goes back
to all texts that hold the stretch."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import byte_view, fresh_dir, prefix_hash, removed, span_hash, written
from .induced import common_prefixes, suffix_array

LENGTH, GRAM = 400, 128
#: Repeats of more than fifty whole words are passages, however few bytes they have.
PASSAGE_WORDS = 51
#: Bytes of text in one suffix array, about, and of one batch of texts whose windows are hashed together.
SHARD, PIECE = 1 << 20, 1 << 19
#: Words of the string that is the anchor of a window of words.
GRAM_WORDS = 16
_PLACE = np.uint64((1 << 24) - 1)
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
#: An anchor whose different stretches have more bytes than so many shards is not taken by one.
HOT = 2


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Every window of `length` bytes inside a text has an anchor: its first `gram`-byte string of least hash.

    Returns, for each run of windows with one anchor, the text, the anchor's hash and place, and the
    first and last window start, as places in the text. The anchor depends on the window's bytes
    only, so equal windows have equal anchors at the same distance. Data of any size are worked
    through in pieces whose places fit _PLACE; a run ends where a piece does."""
    most = min(int(_PLACE) + 1, 4 * PIECE)
    if data.size <= most:
        return _anchors(data, starts, length, gram)
    parts, step = [], most - length + 1
    for a in range(0, data.size - length + 1, step):
        b = min(a + most, data.size)
        first, last = int(np.searchsorted(starts, a, side="right")) - 1, int(np.searchsorted(starts, b))
        text, anchor, *places = _anchors(data[a:b], np.clip(starts[first : last + 1], a, b) - a, length, gram)
        text += first
        parts.append((text, anchor, *(x + np.maximum(a - starts[text], 0) for x in places)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    size, width = data.size, length - gram + 1
    if size < length:
        return none, none.astype(np.uint64), none, none, none
    sums = prefix_hash(data)
    at = np.arange(size - gram + 1)
    grams = span_hash(sums, at, at + gram)
    low = (grams & ~_PLACE) | at.astype(np.uint64)
    blocks = -(-low.size // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[: low.size] = low
    tiles = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    count = size - length + 1
    least = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & _PLACE).astype(np.int64)
    lengths = np.diff(starts)
    inside = np.zeros(count + 1, np.int8)
    long = lengths >= length
    np.add.at(inside, starts[:-1][long], 1)
    np.add.at(inside, starts[1:][long] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside[:count]))
    if not valid.size:
        return none, none.astype(np.uint64), none, none, none
    place = least[valid]
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1))))
    last = np.append(first[1:], valid.size) - 1
    text = np.searchsorted(starts, valid[first], side="right") - 1
    base = starts[text]
    return text, grams[place[first]], place[first] - base, valid[first] - base, valid[last] - base


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word of texts that stand end to end; words are apart by ASCII white space."""
    space, some = _SPACE[data], np.diff(starts) > 0
    before, after = np.concatenate(([True], space))[:-1], np.concatenate((space, [True]))[1:]
    before[starts[:-1][some]] = after[starts[1:][some] - 1] = True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def passages(data: np.ndarray, starts: np.ndarray, words: int, below: int) -> tuple[np.ndarray, ...]:
    """As anchors, for windows from one word's begin to the end of that `words` - 1 further, as far as they have fewer than `below` bytes.

    Returns, for each run of such windows with one anchor, the text, the anchor's hash, and begin and
    size of the run's bytes. Each word but a text's last is a token with the white space after it."""
    begin, end = word_spans(data, starts)
    none = np.zeros(0, np.int64)
    if begin.size < words:
        return none, none.astype(np.uint64), none, none
    text = np.searchsorted(starts, begin, side="right") - 1
    count = np.bincount(text, minlength=starts.size - 1)
    tokens = span_hash(prefix_hash(data), begin[:-1], begin[1:])[text[1:] == text[:-1]]
    held, anchor, _, low, high = anchors(tokens, np.concatenate(([0], np.cumsum(np.maximum(count - 1, 0)))), words - 1, min(GRAM_WORDS, words - 1))
    windows = high - low + 1
    run = np.repeat(np.arange(windows.size), windows)
    word = ((np.cumsum(count) - count)[held] + low)[run] + np.arange(run.size) - np.repeat(np.cumsum(windows) - windows, windows)
    short = end[word + words - 1] - begin[word] < below
    run, word = run[short], word[short]
    if not run.size:
        return none, none.astype(np.uint64), none, none
    first = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (word[1:] != word[:-1] + 1))))
    last = np.append(first[1:], run.size) - 1
    at = begin[word[first]]
    return held[run[first]], anchor[run[first]], at - starts[held[run[first]]], end[word[last] + words - 1] - at


def _rows(documents: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id and tag, which tell rows apart (the id, or a hash of the text where it is null, and another hash of the text, for repeated ids), the text, and a struct of the columns to keep."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit(7), text)).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"), F.struct(*keep).alias("kept"))


def _stretches(length: int, gram: int, words: int):
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = byte_view(batch.column(2))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + PIECE, side="right")) - 1)
                part, begin = data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
                text, anchor, _, low, high = anchors(part, begin, length, gram)
                size = high - low + length
                if words:  # the last bit of an anchor tells windows of words from those of bytes
                    anchor &= ~np.uint64(1)
                    more = passages(part, begin, words, length)
                    text, anchor, low, size = (np.concatenate(x) for x in zip((text, anchor, low, size), (more[0], more[1] | np.uint64(1), *more[2:]), strict=True))
                at = begin[text] + low
                content = span_hash(prefix_hash(part), at, at + size)
                rows = pa.array(text + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(low.astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["id", "tag", "anchor", "content", "low", "size"],
                )
                a = b

    return stretches


def _cut():
    """The bytes of the asked stretches of each text, and whether their anchor is a hot one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = byte_view(batch.column("text"))
            asked = batch.column("asked")
            text = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            fields = dict(zip(("anchor", "content", "low", "size", "often", "hot"), asked.flatten().flatten(), strict=True))
            begin = starts[text] + fields["low"].to_numpy()
            size = fields["size"].to_numpy()
            whole = data.tobytes()
            cuts = [whole[x : x + n] for x, n in zip(begin.tolist(), size.tolist(), strict=True)]
            for a in range(0, max(len(cuts), 1), 20_000):
                yield pa.RecordBatch.from_arrays([*(fields[k][a : a + 20_000] for k in ("anchor", "content", "often", "hot")), pa.array(cuts[a : a + 20_000], pa.binary())], ["anchor", "content", "often", "hot", "bytes"])

    return cut


def repeated_windows(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Marks each place whose `length` bytes lie inside one string and also start elsewhere."""
    sizes = np.diff(starts)
    end = np.repeat(starts[1:], sizes + 1) + np.repeat(np.arange(sizes.size), sizes + 1)
    string = np.repeat(np.arange(sizes.size), sizes)
    text, apart = np.zeros(raw.size + sizes.size, np.int16), np.zeros(raw.size + sizes.size, np.uint8)
    place = np.arange(raw.size) + string
    text[place] = raw.astype(np.int16) + 1
    apart[place] = raw
    before, common = common_prefixes(apart, suffix_array(text), end)
    hit = np.flatnonzero(common >= length)
    marks = np.zeros(text.size, bool)
    marks[hit] = marks[before[hit]] = True
    return marks[place]


def _only_possible(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Marks at least the windows that repeat, by their hashes."""
    marks = np.zeros(raw.size, bool)
    at = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])
    hashes = span_hash(prefix_hash(raw), at, at + length)
    _, where, often = np.unique(hashes, return_inverse=True, return_counts=True)
    marks[at[often[where] > 1]] = True
    return marks


def _marked(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, its repeated windows. Where one anchor alone has more than a shard of bytes, stretches without a window whose hash occurs twice stay out of the array."""
    raw = np.frombuffer(b"".join(strings), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in strings])))
    marks = np.zeros(raw.size, bool)
    if raw.size > 2 * SHARD:
        possible = np.flatnonzero(_only_possible(raw, starts, length))
        if possible.size:
            string = np.searchsorted(starts, possible, side="right") - 1
            new = np.flatnonzero(np.concatenate(([True], (possible[1:] != possible[:-1] + 1) | (string[1:] != string[:-1]))))
            spans = [raw[a : b + length] for a, b in zip(possible[new].tolist(), possible[np.append(new[1:], possible.size) - 1].tolist(), strict=True)]
            cut = np.concatenate(([0], np.cumsum([x.size for x in spans])))
            found = repeated_windows(np.concatenate(spans), cut, length)
            for a, x, y in zip(possible[new].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                marks[a : a + y - x] |= found[x:y]
    else:
        marks = repeated_windows(raw, starts, length)
    return [marks[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _spans_of_words(string: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each window of words."""
    begin, end = word_spans(np.frombuffer(string, np.uint8), np.array([0, len(string)]))
    return begin[: begin.size - words + 1], end[words - 1 :]


def _repeated_passages(strings: list[bytes], words: int) -> list[list[tuple[int, int]]]:
    """For each string, the windows of words that stand twice in all of them, compared as they are."""
    spans = [list(zip(*(x.tolist() for x in _spans_of_words(s, words)), strict=True)) for s in strings]
    often = Counter(s[x:y] for s, found in zip(strings, spans, strict=True) for x, y in found)
    return [[(x, y) for x, y in found if often[s[x:y]] > 1] for s, found in zip(strings, spans, strict=True)]


def _table(out: list[tuple[int, int, int, int]]) -> list[pa.Array]:
    columns = zip(*out, strict=True) if out else ((), (), (), ())
    return [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]


def _shards(length: int, words: int = 0):
    """Of each stretch, begin and end of what stands twice."""

    def shard(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("anchor", "ascending"), ("content", "ascending")])
        anchor, content, often = (group.column(c).to_numpy() for c in ("anchor", "content", "often"))
        strings = group.column("bytes").to_pylist()
        size = np.cumsum([len(x) for x in strings])
        heads = np.append(np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))), anchor.size)
        of_words = anchor & 1 == 1 if words else np.zeros(anchor.size, bool)
        out: list[tuple[int, int, int, int]] = []
        a = 0
        while a < anchor.size:
            limit = (size[a - 1] if a else 0) + SHARD
            fitting = heads[(heads > a) & (size[heads - 1] <= limit)]
            b = int(fitting[-1]) if fitting.size else int(heads[heads > a][0])
            found: dict[int, list[tuple[int, int]]] = {i: [(0, len(strings[i]))] for i in range(a, b) if often[i] > 1}
            some = [i for i in range(a, b) if not of_words[i]]
            for i, marks in zip(some, _marked([strings[i] for i in some], length) if some else (), strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
                found.setdefault(i, list(zip(edges[::2].tolist(), (edges[1::2] + length - 1).tolist(), strict=True)))
            some = [i for i in range(a, b) if of_words[i]]
            for i, spans in zip(some, _repeated_passages([strings[i] for i in some], words), strict=True):
                found.setdefault(i, spans)
            out += [(int(anchor[i]), int(content[i]), x, y) for i in sorted(found) for x, y in found[i]]
            a = b
        return pa.table(_table(out), ["anchor", "content", "first", "stop"])

    return shard


def _window_hashes(length: int, words: int):
    """A row for each window of a stretch: its hash, begin and end. Batches hold the windows of at most PIECE bytes and a stretch."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = byte_view(batch.column(2))
            of_words = batch.column(0).to_numpy() & 1 == 1 if words else np.zeros(batch.num_rows, bool)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + PIECE, side="right")) - 1)
                part, begin = data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
                spans = []
                for i, (x, y) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                    place = np.arange(y - x - length + 1)
                    spans.append(_spans_of_words(part[x:y].tobytes(), words) if of_words[a + i] else (place, place + length))
                row = np.repeat(np.arange(b - a), [x.size for x, _ in spans])
                first, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
                found = span_hash(prefix_hash(part), begin[row] + first, begin[row] + stop)
                rows = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(stop.astype(np.int32))], ["anchor", "content", "window", "first", "stop"])
                a = b

    return hashes


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch, its windows as spans that do not overlap."""
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for anchor, content, windows in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            at, end = None, None
            for x, y in sorted((w["first"], w["stop"]) for w in windows):
                if at is None or x > end:
                    if at is not None:
                        out.append((anchor, content, at, end))
                    at, end = x, y
                end = max(end, y)
            out.append((anchor, content, at, end))
        yield pa.RecordBatch.from_arrays(_table(out), ["anchor", "content", "first", "stop"])


def _of_hot(hot: DataFrame, length: int, words: int) -> DataFrame:
    """What the shards give, for stretches of anchors with too many bytes for one: windows are counted by hash over all tasks, so no task holds an anchor's stretches."""
    windows = written(hot.select("anchor", "content", "bytes").mapInArrow(_window_hashes(length, words), "anchor long, content long, window long, first int, stop int"), "windows")
    # A window repeats if two stretches have it, one has it twice, or its stretch stands in two places.
    twice = windows.groupBy("anchor", "window").count().where("count > 1").select("anchor", "window")
    found = windows.join(written(twice, "windows"), ["anchor", "window"]).groupBy("anchor", "content").agg(F.collect_list(F.struct("first", "stop")).alias("windows"))
    whole = hot.where("often > 1").select("anchor", "content", F.lit(0).alias("first"), F.octet_length("bytes").alias("stop"))
    return found.mapInArrow(_runs, "anchor long, content long, first int, stop int").unionByName(whole)


def _without(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What stays of a text without some ranges, in order of begin; how many bytes go, and in how many runs."""
    stay, at, gone, spans = [], 0, 0, 0
    for x, y in ranges:
        if x > at or not spans:
            stay.append(text[at:x])
            spans += 1
            at = x
        if y > at:
            gone += y - at
            at = y
    stay.append(text[at:])
    return b"".join(stay), gone, spans


def _kept(as_text: bool):
    """From kept, text and ranges (begin, end, of_words): kept, n_bytes, n_removed, n_spans and kept_sha256 by ranges of bytes, and what all ranges leave."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = byte_view(batch.column(1))
            whole, rows = data.tobytes(), []
            for i, found in enumerate(batch.column(2).to_pylist()):
                text = whole[starts[i] : starts[i + 1]]
                ranges = sorted((r["begin"], r["end"], r["of_words"]) for r in found or ())
                of_bytes = [(x, y) for x, y, of_words in ranges if not of_words]
                stay, gone, spans = _without(text, of_bytes)
                last = stay if len(of_bytes) == len(ranges) else _without(text, [(x, y) for x, y, _ in ranges])[0]
                rows.append((len(text), gone, spans, hashlib.sha256(stay).hexdigest(), last.decode("utf-8", "ignore") if as_text else last))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return kept


def _once(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows that are asked for a stretch, one of those that stand many times as a whole; what copies they have is counted already."""
    keys = ["id", "tag"]
    copied = written(rows.groupBy(*keys).count().where("count > 1").select(*keys), "copied")
    if copied.isEmpty():
        return rows.join(asked, keys)
    asked = written(asked, "asked")
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy("tag"))
    one = rows.join(asked.join(copied, keys, "left_semi"), keys).withColumn("copy", copy).where("copy = 1").drop("copy")
    return rows.join(asked.join(copied, keys, "left_anti"), keys).unionByName(one)


def _repeated_ranges(rows: DataFrame, length: int, gram: int, words: int) -> DataFrame:
    """(id, tag, ranges) of the texts with bytes that a repeated string of `length` bytes covers, or one of `words` whole words, if given; ranges may overlap."""
    least = min(length, 2 * words - 1) if words else length
    spark = rows.sparkSession
    path = fresh_dir(spark, "stretches")
    texts = rows.select("id", "tag", "text").where(F.octet_length("text") >= least)
    every = written(texts.mapInArrow(_stretches(length, gram, words), "id long, tag long, anchor long, content long, low int, size int"), "stretches", path)
    # Written, so that the join has plain exchanges on both sides: then a hot anchor's rows are split over tasks.
    twice = written(every.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    held = written(every.join(twice, "anchor"), "held")
    removed(spark, path)  # only what is held is read from here on

    one = F.struct("id", "tag", "low", "size")
    different = held.groupBy("anchor", "content").agg(F.min(one).alias("one"), F.count("*").alias("often"))
    hot = different.groupBy("anchor").agg(F.sum("one.size").alias("size")).where(F.col("size") > HOT * SHARD)
    hot = written(hot.select("anchor", F.lit(True).alias("hot")), "hot")
    some_hot = not hot.isEmpty()
    different = different.join(hot, "anchor", "left") if some_hot else different.withColumn("hot", F.lit(None).cast("boolean"))
    asked = different.groupBy("one.id", "one.tag").agg(F.collect_list(F.struct("anchor", "content", F.col("one.low").alias("low"), F.col("one.size").alias("size"), "often", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asked"))
    # All columns stay, so that the rows are dealt as they are for the last join, and Spark deals them once.
    cut = _once(rows, asked).mapInArrow(_cut(), "anchor long, content long, often long, hot boolean, bytes binary")
    if some_hot:
        cut = written(cut, "cut")
    size = held.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    found = cut.where("not hot").drop("hot").groupBy(F.pmod("anchor", F.lit(shards)).alias("shard")).applyInArrow(_shards(length, words), "anchor long, content long, first int, stop int")
    if some_hot:
        found = found.unionByName(_of_hot(cut.where("hot"), length, words))
    found = found.dropDuplicates()
    back = held.join(found, ["anchor", "content"])
    of_words = F.col("anchor").bitwiseAND(F.lit(1).cast("long")) == (1 if words else 2)
    ranges = back.select("id", "tag", F.struct((F.col("low") + F.col("first")).alias("begin"), (F.col("low") + F.col("stop")).alias("end"), of_words.alias("of_words")).alias("range"))
    return ranges.groupBy("id", "tag").agg(F.collect_set("range").alias("ranges"))


def without_repeats(documents: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, as_text: bool = False, words: int = 0) -> DataFrame:
    """One row per input row: the kept columns (the id unless named), n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that stay.

    Every byte that a string of `length` bytes covers which also starts anywhere else goes, in all
    places where it stands. If `words` is given, kept is also without every string of so many whole
    words, however short, that is elsewhere too, with the same white space between them; the other
    columns are about strings of bytes alone. As text, kept is without the remains of characters
    that a removed string's edge cut in two.

    Null counts as empty. Rows with the same id or none are texts like any other, and rows that
    repeat as a whole repeat each other. An empty table gives no rows; columns other than those kept
    are not read."""
    rows = _rows(documents, id_col, text_col, [id_col] if keep is None else keep)
    joined = rows.join(_repeated_ranges(rows, length, gram, words), ["id", "tag"], "left").select("kept", "text", "ranges")
    schema = f"row {joined.schema['kept'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'string' if as_text else 'binary'}"
    return joined.mapInArrow(_kept(as_text), schema).select("row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
