"""Suffix arrays by induced sorting, in array operations over whole buckets.

Suffixes are classed as S (smaller than the next) or L (larger); an S after an L is leftmost-smaller.
Two scans over the buckets of first characters induce the order of all suffixes from that of the
leftmost-smaller ones: each step takes what a bucket holds so far, and deals the suffixes that begin
one place earlier to their buckets. The substrings between leftmost-smaller places are sorted by the
same two scans and named; where names repeat, the string of names is sorted in turn, by the names of
pairs, pairs of pairs and so on, which only those not yet told apart go through. (A bucket scan over
that string's alphabet, which is as large as the string, would leave arrays of a few entries.)"""

from __future__ import annotations

import numpy as np

from .common import prefix_hash, span_hash


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the end counts as smaller than all."""
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.append(text[change + 1] > text[change], False)
    return np.repeat(rises, np.diff(np.concatenate(([-1], change, [text.size - 1]))))


class _Buckets:
    def __init__(self, text: np.ndarray) -> None:
        self.text, self.s = text, _smaller(text)
        self.ends = np.cumsum(np.bincount(text, minlength=1)).tolist()
        self.begins = [0, *self.ends[:-1]]
        self.lms = np.flatnonzero(self.s[1:] & ~self.s[:-1]) + 1

    def _dealt(self, block: np.ndarray, small: bool):
        """The suffixes one place before those of a block that are of the type, by first character, in order."""
        before = block - 1
        before = before[(before >= 0) & (self.s[before] == small)]
        first = self.text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        bounds = [0, *cuts.tolist(), before.size]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b > a:
                yield int(first[a]), before[a:b]

    def induced(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, from the leftmost-smaller ones grouped by first character and in order within each group."""
        n, sa = self.text.size, np.empty(self.text.size, np.int32)
        of = np.searchsorted(self.text[lms], np.arange(len(self.ends) + 1))
        fill = list(self.begins)

        def put(block: np.ndarray) -> None:
            for c, group in self._dealt(block, False):
                sa[fill[c] : fill[c] + group.size] = group
                fill[c] += group.size

        put(np.array([n], np.int32))
        for c in range(len(self.ends)):
            done = self.begins[c]
            while done < fill[c]:
                block, done = sa[done : fill[c]], fill[c]
                put(block)
            if of[c] < of[c + 1]:
                put(lms[of[c] : of[c + 1]])
        large, fill = fill, list(self.ends)
        for c in range(len(self.ends) - 1, -1, -1):
            done = self.ends[c]
            while True:
                if done > fill[c]:
                    block, done = sa[fill[c] : done], fill[c]
                elif done > large[c]:
                    raise AssertionError("a suffix was not reached")
                elif large[c] > self.begins[c] and done >= 0:
                    block, done = sa[self.begins[c] : large[c]], -1
                else:
                    break
                for d, group in self._dealt(block[::-1], True):
                    sa[fill[d] - group.size : fill[d]] = group[::-1]
                    fill[d] -= group.size
                if done < 0:
                    break
        return sa


def _refined(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names."""
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    head = np.flatnonzero(np.concatenate(([True], sorted_names[1:] != sorted_names[:-1])))
    size = np.diff(np.append(head, names.size))
    rank = np.empty(names.size + 1, np.int64)
    rank[order] = np.repeat(head, size)
    rank[-1] = -1
    active, step = order[np.repeat(size > 1, size)], 1
    while active.size:
        after = rank[np.minimum(active + step, names.size)]
        key = (rank[active] << 32) | (after + 1)
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        at = np.arange(active.size)
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.concatenate(([True], key[1:] >> 32 != key[:-1] >> 32))
        in_group = at - np.maximum.accumulate(np.where(group, at, 0))
        rank[active] = (key >> 32) + np.maximum.accumulate(np.where(new, at, 0)) - (at - in_group)
        last = np.append(new[1:], True)
        active, step = active[~(new & last)], 2 * step
    return np.argsort(rank[:-1], kind="stable")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a string of small non-negative integers, in order."""
    if text.size < 2:
        return np.arange(text.size, dtype=np.int32)
    buckets = _Buckets(text)
    lms = buckets.lms.astype(np.int32)
    if not lms.size:
        return buckets.induced(lms)
    sa = buckets.induced(lms[np.argsort(text[lms], kind="stable")])
    is_lms = np.zeros(text.size, bool)
    is_lms[lms] = True
    found = sa[is_lms[sa]]
    number = np.empty(text.size, np.int32)
    number[lms] = np.arange(lms.size)
    ends = np.append(lms[1:] + 1, text.size)
    length, which = ends - lms, number[found]
    content = span_hash(prefix_hash(text), lms.astype(np.int64), ends.astype(np.int64))
    differs = (content[which[1:]] != content[which[:-1]]) | (length[which[1:]] != length[which[:-1]])
    name = np.empty(lms.size, np.int64)
    name[which] = np.concatenate(([0], np.cumsum(differs)))
    if not differs.all():
        found = lms[_refined(name)]
    return buckets.induced(found)


def common_prefixes(raw: np.ndarray, sa: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the place before it in the suffix array (-1: none) and the length of their common prefix; neither reaches its end.

    A place whose left neighbour and the other's are equal has one less than its left neighbour; only
    the rest are compared, eight bytes at a time."""
    n = raw.size
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    limit = np.where(before >= 0, np.minimum(end - at, end[before] - before), 0)
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] <= 0) | (raw[:-1] != raw[before[1:] - 1]) | (end[1:] != end[:-1])
    fresh[1:] |= (before[1:] > 0) & (end[before[1:] - 1] != end[before[1:]])
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    word = np.ndarray((n + 1,), "<u8", padded.data, strides=(1,))
    length = np.zeros(n, np.int64)
    active = at[fresh & (limit > 0)]
    while active.size:
        seen = length[active]
        x = word[active + seen] ^ word[before[active] + seen]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
        length[active] = seen + same
        active = active[(same == 8) & (seen + 8 < limit[active])]
    length = np.minimum(length, limit)
    start = np.maximum.accumulate(np.where(fresh, at, 0))
    return before, np.maximum(length[start] - (at - start), 0)
