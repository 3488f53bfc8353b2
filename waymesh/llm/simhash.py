"""SimHash near-duplicate groups over a byte-position inverted index.

A fingerprint has eight bytes. Two fingerprints that differ in at most four bits agree in at least
four byte positions, whatever they hold; that is the guaranteed minimum. The index posts every
distinct fingerprint under the values at three positions at a time. Of all 56 such triples it needs
only 20: every choice of four positions out of eight contains one of them, so a linked pair always
meets. A pair met in a list is counted (equal positional bytes), kept at four or more, and then
verified bit by bit.

Lists hold distinct fingerprints, so exact copies cost one posting however many there are. A long
list (a large group of near copies) is not expanded into pairs: one task walks it outwards from a
member, linking each fingerprint once to one already reached, which gives the same groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import byte_view, mixed, written

WORDS, SEED, BITS, LEAST_EQUAL = 4, 42, 4, 4
LONG_LIST = 48
#: Of the wide fingerprint: shingles of five words, 16 longs, and lists, of which two texts of the least similarity share four on average.
WIDE_WORDS, WIDE_LONGS, WIDE_LISTS, SIMILAR = 5, 16, 192, 0.8
#: Two texts of that similarity differ in 155 bits, give or take 11. Those within SURE_BITS link, those within WIDE_BITS are compared by
#: their sets of shingles. Long lists are walked by sure links, and then at each of WALKS for what these leave apart.
SURE_BITS, WIDE_BITS = 104, 190
WALKS = (160, WIDE_BITS)
#: Pairs that are handed on at a time.
APART = 1 << 16
#: Candidates that a fingerprint has compared in one round after the other, the nearest of what is still apart; where there are more than the
#: last round takes, tasks compare sets of shingles inside blocks of a list, each of so many bytes.
NEAREST = (60,)
BLOCK_BYTES = 1 << 23
#: Shingles whose bits are unpacked at a time; a byte counts to 255, so their bits are summed in eight bytes at once.
CHUNK, LANES = 4080, 255
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _position_triples() -> list[tuple[int, int, int]]:
    """Triples that meet every set of four of eight positions: three classes in a ring, triples inside one or two in one and one in the next."""
    ring = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = []
    for here, after in zip(ring, ring[1:] + ring[:1], strict=True):
        found += list(combinations(here, 3))
        found += [tuple(sorted((*two, one))) for two in combinations(here, 2) for one in after]
    return sorted(found)


TRIPLES = _position_triples()
#: For each set of equal positions (as bits), the first triple inside it: a pair is emitted in that list only.
FIRST_TRIPLE = np.array([next((i for i, t in enumerate(TRIPLES) if all(m >> p & 1 for p in t)), len(TRIPLES)) for m in range(256)])


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of all word shingles of the text, A-Z lower-cased; of the whole text if it has fewer words, none without words."""
    if not (found := text.lower().split()):
        return np.zeros(0, np.uint64)
    line, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    starts, digest = np.concatenate(([0], ends[:-1] + 1)), xxhash.xxh64_intdigest
    k = min(words, len(found))
    return np.array([digest(line[a:b], seed) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray, longs: int = 1) -> np.ndarray:
    """The bits that over half the hashes set, as so many longs; the first is of the hashes themselves, each further one of other bits drawn from them."""
    count, step = np.zeros(64 * longs, np.int64), np.arange(longs, dtype=np.uint64) * _STEP
    for at in range(0, hashes.size, CHUNK):
        part = hashes[at : at + CHUNK, None]
        drawn = part if longs == 1 else np.concatenate((part, mixed(part + step[1:])), axis=1)
        bits = np.unpackbits(np.ascontiguousarray(drawn).view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        count += np.add.reduceat(bits, np.arange(0, len(bits), LANES), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(count * 2 > hashes.size, bitorder="little").view(np.uint64)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all word shingles of the text; zero without words."""
    return int(majority(shingle_hashes(text, words, seed))[0])


@F.arrow_udf(T.LongType())
def simhash(text: pa.Array) -> pa.Array:
    """The fingerprint as a signed long; null counts as empty."""
    data, starts = byte_view(text)
    whole = data.tobytes()
    return pa.array(np.array([fingerprint(whole[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], np.uint64).view(np.int64), pa.int64())


def postings(fingerprints: DataFrame) -> DataFrame:
    """(list, fp): every distinct fingerprint under each of its 20 position triples."""
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")) for p in range(8)]
    lists = [F.lit(i << 24).cast("long") + F.shiftleft(byte[a], 16) + F.shiftleft(byte[b], 8) + byte[c] for i, (a, b, c) in enumerate(TRIPLES)]
    return fingerprints.select(F.explode(F.array(*lists)).alias("list"), "fp")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bit set of the positions with equal bytes."""
    same = (a ^ b).view(np.uint8).reshape(-1, 8) == 0
    return np.packbits(same, axis=1, bitorder="little")[:, 0]


def walked(fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly those members of a list which are reachable from each other."""
    left, right, rest = [], [], fp
    while rest.size:
        reached, rest = [rest[0]], rest[1:]
        while reached and rest.size:
            x = reached.pop()
            equal = (rest ^ x).view(np.uint8).reshape(-1, 8) == 0
            near = (equal.sum(axis=1) >= LEAST_EQUAL) & (np.bitwise_count(rest ^ x) <= bits)
            if near.any():
                new, rest = rest[near], rest[~near]
                left.append(np.full(new.size, x, np.uint64))
                right.append(new)
                reached.extend(new)
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _linked(lists: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole lists; rows come sorted by list."""
    begin = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
    length = np.diff(np.append(begin, lists.size))
    left, right = [], []
    for a, n in zip(begin[length > LONG_LIST].tolist(), length[length > LONG_LIST].tolist(), strict=True):
        x, y = walked(fp[a : a + n])
        left.append(x)
        right.append(y)
    short = np.repeat(length <= LONG_LIST, length)
    lists, fp = lists[short], fp[short]
    for step in range(1, int(length[length <= LONG_LIST].max(initial=1))):
        at = np.flatnonzero(lists[step:] == lists[:-step])
        if not at.size:
            break
        a, b = fp[at], fp[at + step]
        agree = _agree(a, b)
        keep = (np.bitwise_count(agree) >= LEAST_EQUAL) & (FIRST_TRIPLE[agree] == lists[at] >> 24)
        keep &= np.bitwise_count(a ^ b) <= BITS
        left.append(a[keep])
        right.append(b[keep])
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out(lists: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = _linked(lists, fp)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lists, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if held and held[-1][0][-1] != lists[-1] or not held and lists[0] != lists[-1]:
            cut = int(np.searchsorted(lists, lists[-1]))
            held.append((lists[:cut], fp[:cut]))
            yield out(*map(np.concatenate, zip(*held, strict=True)))
            held, lists, fp = [], lists[cut:], fp[cut:]
        held.append((lists, fp))
    if held:
        yield out(*map(np.concatenate, zip(*held, strict=True)))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of a link (a, b): by contraction, each node to the neighbour of least hash.

    The hash changes each round, so a round removes a constant share of the nodes whatever the shape."""
    rounds, edges = [], links
    while True:
        k = len(rounds)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.unionByName(both.select("a", F.col("a").alias("b")))
        label = written(both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", F.xxhash64("b", F.lit(k))).alias("root")), "labels")
        if label.isEmpty():
            break
        rounds.append(label)
        a, b = (label.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        edges = edges.join(a, "a").join(b, "b").where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct()
        edges = written(edges, "edges")
        if edges.isEmpty():
            break
    if not rounds:
        return label
    found = rounds[0]
    for label in rounds[1:]:
        further = label.select(F.col("node").alias("root"), F.col("root").alias("further"))
        found = found.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return found


def shingle_set(text: bytes) -> np.ndarray:
    """The hashes of the text's shingles of WIDE_WORDS words, each once, in order."""
    return np.unique(shingle_hashes(text, WIDE_WORDS))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a similarity of SIMILAR or more."""
    if min(a.size, b.size) < SIMILAR * max(a.size, b.size):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return both >= SIMILAR * (a.size + b.size - both)


@F.arrow_udf(T.BinaryType())
def wide_simhash(text: pa.Array) -> pa.Array:
    """The wide fingerprint, 128 bytes, of the set of shingles: one that stands often counts once, as in the similarity; null counts as empty."""
    data, starts = byte_view(text)
    whole = data.tobytes()
    return pa.array([majority(shingle_set(whole[a:b]), WIDE_LONGS).tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary())


@F.arrow_udf(T.BinaryType())
def shingle_sets(text: pa.Array) -> pa.Array:
    """The set of shingles, eight bytes each in order; null counts as empty."""
    data, starts = byte_view(text)
    whole = data.tobytes()
    return pa.array([shingle_set(whole[a:b]).tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary())


def _spread_triples(positions: int, count: int) -> np.ndarray:
    """So many triples of positions, dealt from seeded orders of all positions, so that none is used much more often than others."""
    rng, found = np.random.default_rng(SEED), {}
    while len(found) < count:
        order = rng.permutation(positions)[: positions // 3 * 3].reshape(-1, 3)
        found.update(dict.fromkeys(map(tuple, np.sort(order, axis=1).tolist())))
    return np.array(list(found)[:count])


WIDE_TRIPLES = _spread_triples(8 * WIDE_LONGS, WIDE_LISTS)


def _wide_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, fp) for every fingerprint's name and bytes: a list holds what has the same bytes at the three positions of one triple."""
    for batch in batches:
        if batch.num_rows:
            byte = byte_view(batch.column(1))[0].reshape(batch.num_rows, -1).astype(np.int64)
            a, b, c = (byte[:, WIDE_TRIPLES[:, k]] for k in range(3))
            lists = (np.arange(WIDE_LISTS) << 24) + (a << 16) + (b << 8) + c
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), WIDE_LISTS))], ["list", "fp"])


def _wide_near(a: np.ndarray, b: np.ndarray, bits: int = WIDE_BITS) -> np.ndarray:
    """Which rows of two tables of fingerprints share three positional bytes and differ in so many bits at most."""
    differ = a ^ b
    near = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= bits
    near[near] = (differ[near].view(np.uint8) == 0).sum(axis=1) >= 3
    return near


def _wide_walked(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of links that join exactly those members of a list which are reachable from each other, and of each row the first that it is reachable from."""
    left, right, rest, first = [], [], np.arange(len(fp)), np.arange(len(fp))
    while rest.size:
        begin, reached, rest = int(rest[0]), [int(rest[0])], rest[1:]
        while reached and rest.size:
            x = reached.pop()
            near = _wide_near(fp[rest], fp[x], bits)
            if near.any():
                left.append(np.full(int(near.sum()), x))
                right.append(rest[near])
                first[rest[near]] = begin
                reached.extend(rest[near].tolist())
                rest = rest[~near]
    return np.concatenate([rest[:0], *left]), np.concatenate([rest[:0], *right]), first


def _wide_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside whole lists, whether they are sure, and their bits; rows (list, name, bytes) come sorted by list, and the list that a batch ends in waits for the next."""
    lists, names, prints = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDE_LONGS), np.uint64)

    def out(upto: int) -> pa.RecordBatch:
        bound = np.flatnonzero(np.concatenate(([True], lists[1:upto] != lists[: upto - 1], [True])))
        pairs = bound[:-1][np.diff(bound) == 2]
        near = pairs[_wide_near(prints[pairs], prints[pairs + 1])]
        a, b = [near], [near + 1]
        for i in np.flatnonzero(np.diff(bound) > 2).tolist():
            x, y, surely = _wide_walked(prints[bound[i] : bound[i + 1]], SURE_BITS)
            a.append(bound[i] + x)
            b.append(bound[i] + y)
            for bits in WALKS:  # only between what is not together already
                x, y, _ = _wide_walked(prints[bound[i] : bound[i + 1]], bits) if (surely != surely[0]).any() else (x[:0], y[:0], None)
                apart = surely[x] != surely[y]
                a.append(bound[i] + x[apart])
                b.append(bound[i] + y[apart])
        a, b = np.concatenate(a), np.concatenate(b)
        bits = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(names[a], names[b])), pa.array(np.maximum(names[a], names[b])), pa.array(bits <= SURE_BITS), pa.array(bits)], ["a", "b", "sure", "bits"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = np.concatenate((lists, batch.column(0).to_numpy()))
        names = np.concatenate((names, batch.column(1).to_numpy()))
        prints = np.concatenate((prints, byte_view(batch.column(2))[0].view(np.uint64).reshape(-1, WIDE_LONGS)))
        if cut := int(np.searchsorted(lists, lists[-1])):
            yield out(cut)
            lists, names, prints = lists[cut:], names[cut:], prints[cut:]
    if lists.size:
        yield out(lists.size)


def _first_list(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a table of fingerprints, the first triple of positions at which it has the bytes of a fingerprint that it meets."""
    return (a.view(np.uint8).reshape(-1, 8 * WIDE_LONGS) == b.view(np.uint8))[:, WIDE_TRIPLES].all(axis=2).argmax(axis=1)


def _wide_apart(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """All pairs of a list that differ in WIDE_BITS or fewer and have different roots, and their bits; rows (list, name, bytes, root) come sorted by list and name, and of the list that a batch ends in all that came is kept.

    With most, a pair comes from the first list in which it meets only, and a name gives so many pairs with names before it, the nearest."""
    lists, names, roots, prints = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDE_LONGS), np.uint64)

    def out(upto: int) -> Iterator[pa.RecordBatch]:
        bound = np.flatnonzero(np.concatenate(([True], lists[1:upto] != lists[: upto - 1], [True])))
        left, right, far, count = [lists[:0]], [lists[:0]], [lists[:0]], 0
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            for x in range(a + 1, b if (roots[a:b] != roots[a]).any() else a):
                near = a + np.flatnonzero(roots[a:x] != roots[x])
                near = near[_wide_near(prints[near], prints[x])]
                if most is not None and near.size:
                    near = near[_first_list(prints[near], prints[x]) == lists[x] >> 24]
                bits = np.bitwise_count(prints[near] ^ prints[x]).sum(axis=1, dtype=np.int64)
                if most is not None and near.size > most:
                    nearest = np.lexsort((names[near], bits))[:most]
                    near, bits = near[nearest], bits[nearest]
                left.append(names[near])
                right.append(np.full(near.size, names[x]))
                far.append(bits)
                count += near.size
                if count >= APART:
                    yield pairs(left, right, far)
                    left, right, far, count = [lists[:0]], [lists[:0]], [lists[:0]], 0
        yield pairs(left, right, far)

    def pairs(left: list[np.ndarray], right: list[np.ndarray], far: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.concatenate(far))], ["a", "b", "bits"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lists, names, roots = (np.concatenate((have, batch.column(c).to_numpy())) for have, c in ((lists, 0), (names, 1), (roots, 3)))
        prints = np.concatenate((prints, byte_view(batch.column(2))[0].view(np.uint64).reshape(-1, WIDE_LONGS)))
        if cut := int(np.searchsorted(lists, lists[-1])):
            yield from out(cut)
            lists, names, roots, prints = lists[cut:], names[cut:], roots[cut:], prints[cut:]
    if lists.size:
        yield from out(lists.size)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of the rows of one key after the other; the key is the first column, rows come sorted by it."""
    held: list[pa.RecordBatch] = []

    def columns() -> list[pa.Array]:
        return [pa.concat_arrays([part.column(c) for part in held]) for c in range(held[0].num_columns)]

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        for a, b in pairwise([0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), key.size]):
            if held and key[a] != last:
                yield columns()
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield columns()


def _wide_compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between what is apart in two blocks of a list, or in one: each full name is compared with those before it by their sets of shingles, until they are together.

    Rows (list << 30 | block << 15 | block, name, bytes, root, full, block, shingles) come sorted by the first two."""
    for key, *columns in _whole(batches):
        key, (names, root, full, block) = key[0].as_py(), (columns[c].to_numpy(zero_copy_only=False) for c in (0, 2, 3, 4))
        prints, (data, starts) = byte_view(columns[1])[0].view(np.uint64).reshape(-1, WIDE_LONGS), byte_view(columns[5])
        shingles, starts, root = data.view(np.uint64), (starts // 8).tolist(), root.copy()
        one, left, right = (key >> 15 & 0x7FFF) == (key & 0x7FFF), [], []
        for x in np.flatnonzero(full).tolist():
            near = np.flatnonzero((root[:x] != root[x]) & (one | (block[:x] != block[x])))
            near = near[_wide_near(prints[near], prints[x])]
            near = near[_first_list(prints[near], prints[x]) == key >> 54]
            mine = shingles[starts[x] : starts[x + 1]]
            for y in near[np.argsort(np.bitwise_count(prints[near] ^ prints[x]).sum(axis=1, dtype=np.int64))].tolist():
                if root[y] != root[x] and alike(mine, shingles[starts[y] : starts[y + 1]]):
                    left.append(names[y])
                    right.append(names[x])
                    root[root == root[y]] = root[x]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _named(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the root of their fingerprint's group, and component_id, the group's smallest id."""
    root = components(written(links, "links")).withColumnRenamed("node", "fp")
    # Both sides of each join are written, so that adaptive execution splits a large group over tasks.
    rooted = written(distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    named = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    return rows.join(written(rooted.join(named, "root").select("fp", "root", "component_id"), "groups"), "fp")


def _grouped(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, fp, root (one fingerprint of the group) and component_id of every row."""
    rows = written(df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), simhash(F.col(text_col)).alias("fp")), "simhash")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "fingerprints")
    return _named(rows, distinct, postings(distinct).repartition("list").sortWithinPartitions("list").mapInArrow(_links, "a long, b long"))


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidates with their texts those whose sets of shingles are similar."""
    for batch in batches:
        columns = [byte_view(batch.column(c)) for c in ("a_text", "b_text")]
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            keep[i] = alike(*(shingle_set(data[starts[i] : starts[i + 1]].tobytes()) for data, starts in columns))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def _texts(ends: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(fp, text): a text of each fingerprint, looked up by its hash."""
    hashes = rows.join(ends, "fp").groupBy("fp").agg(F.min("text_hash").alias("text_hash"))
    return texts.join(hashes, "text_hash").groupBy("fp").agg(F.min("text").alias("text"))


def _alike(links: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) between fingerprints of texts of SIMILAR or more."""
    ends = links.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    texts = written(_texts(ends, rows, texts), "texts")
    a, b = (texts.select(F.col("fp").alias(x), F.col("text").alias(f"{x}_text")) for x in "ab")
    return links.select("a", "b").join(a, "a").join(b, "b").mapInArrow(_jaccard, "a long, b long")


def _apart(met: DataFrame, found: DataFrame, full: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(list, fp, root, full) of the lists that hold members of more than one root and a full one, and what was found as links to roots; without a table of full ones all are."""
    root = written(components(found), "roots").select(F.col("node").alias("fp"), "root")
    rooted = met.select("list", "fp").join(root, "fp", "left").select("list", "fp", F.coalesce("root", "fp").alias("root"))
    if full is None:
        rooted = rooted.withColumn("full", F.lit(True))
    else:
        rooted = rooted.join(full.withColumn("full", F.lit(True)), "fp", "left").withColumn("full", F.coalesce("full", F.lit(False))).select("list", "fp", "root", "full")
    one = Window.partitionBy("list")
    rooted = rooted.withColumn("apart", (F.min("root").over(one) != F.max("root").over(one)) & F.max("full").over(one)).where("apart").drop("apart")
    return written(rooted, "apart"), root.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b"))


def _compared(apart: DataFrame, prints: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of the full fingerprints with others of their lists, compared in tasks of two blocks of a list each."""
    one = Window.partitionBy("list")
    sets = _texts(apart.select("fp").distinct(), rows, texts).select("fp", shingle_sets("text").alias("shingles"))
    sets = written(sets.join(prints, "fp"), "sets")
    upto = F.sum(F.length("shingles") + 8 * WIDE_LONGS).over(one.orderBy("fp").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lists = apart.join(sets, "fp").withColumn("block", F.floor((upto - 1) / BLOCK_BYTES).cast("int")).withColumn("blocks", F.max("block").over(one) + 1)
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = (f("block", "other").cast("long") for f in (F.least, F.greatest))
    tasks = lists.select((F.shiftleft("list", 30) + F.shiftleft(low, 15) + high).alias("task"), "fp", "bytes", "root", "full", "block", "shingles")
    return tasks.repartition("task").sortWithinPartitions("task", "fp").mapInArrow(_wide_compared, "a long, b long").distinct()


def _similar(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same columns by wide fingerprints; fp is a fingerprint's 64-bit hash."""
    rows = written(df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), wide_simhash(F.col(text_col)).alias("bytes")).withColumn("fp", F.xxhash64("bytes")), "simhash")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.first("bytes").alias("bytes")), "fingerprints")
    prints = distinct.select("fp", "bytes")
    posted = prints.mapInArrow(_wide_postings, "list long, fp long")
    # Most lists have one member; the others' members get their fingerprints, which are verified there.
    by_list = Window.partitionBy("list").orderBy("fp")
    met = posted.select("list", "fp", (F.lag("fp").over(by_list).isNotNull() | F.lead("fp").over(by_list).isNotNull()).alias("met")).where("met").drop("met")
    met = written(met, "postings")
    texts = df.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def by_lists(members: DataFrame, *more: str) -> DataFrame:
        # In order of name, so that the walks of most lists begin at the same members and give the same links.
        return members.join(prints, "fp").select("list", "fp", "bytes", *more).repartition("list").sortWithinPartitions("list", "fp")

    walked = written(by_lists(met).mapInArrow(_wide_links, "a long, b long, sure boolean, bits long"), "walked")
    # Whatever has a candidate in a list has a link of its walks there; most members only share bytes with others.
    linked = walked.select(F.col("a").alias("fp")).union(walked.select("b")).distinct()
    # Of links that are not sure, a fingerprint's shortest: most are alike, and what that leaves apart is compared after.
    links = walked.groupBy("b", "sure", F.when(F.col("sure"), F.col("a")).alias("to")).agg(F.min(F.struct("bits", "a")).alias("least")).select("least.a", "b", "sure")
    tested = written(links, "candidates")
    found = written(tested.where("sure").drop("sure").unionByName(_alike(tested.where("NOT sure").drop("sure"), rows, texts)), "found")
    # A walk has one way to each member, and texts may be unlike along it and alike along another: all pairs of what is still apart are compared,
    # the nearest first, so that few are left where most texts are alike. Fingerprints that have no more of them are done.
    apart, tested, full = met.join(linked, "fp", "left_semi"), tested.drop("sure"), None
    for most in NEAREST:
        (apart, found), nearest = _apart(apart, found, full), Window.partitionBy("b").orderBy("bits", "a")
        pairs = by_lists(apart, "root").mapInArrow(partial(_wide_apart, most=most), "a long, b long, bits long")
        pairs = written(pairs.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= most).drop("place", "bits"), "pairs")
        found = written(found.unionByName(_alike(written(pairs.join(tested, ["a", "b"], "left_anti"), "untested"), rows, texts)), "found")
        full = written(pairs.groupBy(F.col("b").alias("fp")).agg(F.count("*").alias("n")).where(F.col("n") >= most).select("fp"), "full")
        if full.isEmpty():
            break
        tested = tested.unionByName(pairs)
    else:
        apart, found = _apart(apart, found, full)
        found = found.unionByName(_compared(apart, prints, rows, texts))
    return _named(rows.drop("bytes"), distinct.drop("bytes"), found)


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links of at most four bits.

    Null and empty texts have fingerprint zero and link like any other. A null id takes part in its
    group, which is named by its smallest id that is not null. Repeated rows give repeated rows; an
    empty table gives none. Other columns are not read."""
    return _grouped(df, id_col, text_col).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and component_id, the smallest id reachable over links of similarity 0.8 and more in shingles of five words.

    Fingerprints have 1024 bits; candidates differ in WIDE_BITS or fewer and meet in one of WIDE_LISTS lists of
    three positional bytes, as nearly all such pairs do (no minimum is guaranteed where so many bits may
    differ). All candidates between what other links leave apart are compared, the nearest first; a fingerprint that has more than the last of NEAREST
    is compared inside its lists, where no row a pair is made. They link if their sets of shingles are that similar, which the bits alone say where they are SURE_BITS or fewer. Texts of fewer than five words link if they have the same words;
    null and empty texts link with each other. Null ids, repeated rows, empty tables: as near_duplicate_groups."""
    return _similar(df, id_col, text_col).select(F.col("id").alias(id_col), "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: bool = False) -> DataFrame:
    """The input's rows, one of each group of near_duplicate_groups, or of similar_groups: that with the smallest id, a null id counting as largest, and of equal ids that with the smallest hash of its text."""
    groups = (_similar if similar else _grouped)(df, id_col, text_col)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"))
    first = first.select(F.coalesce(F.col("first.id"), F.col("first.text_hash")).alias("_id"), F.col("first.text_hash").alias("_hash"))
    keyed = df.withColumns({"_hash": F.xxhash64(text_col), "_id": F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))})
    return keyed.join(first, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select(*df.columns)
