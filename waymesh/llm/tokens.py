"""Token counts without tokens: a unigram tokenizer's best segmentation, by score and piece count only.

An Aho-Corasick automaton of the vocabulary enumerates the pieces that end at each character of a
word; dynamic programming over the ends carries the best score and its number of pieces. Ties fall
as in the tokenizer, which goes through starts in order and lets only a better score replace: of
equal scores the earliest start, so the longest piece, stays. A character that is no piece by itself
may also be unknown, at the least score of the vocabulary less ten; unknown characters become their
UTF-8 bytes where the vocabulary has pieces for bytes, and otherwise one piece for each run.

Words repeat, so each task keeps the counts of words it has met, up to a fixed number."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import log

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_WORDS = 1 << 20
#: Characters of a long word that the automaton reads at a time.
PART = 1 << 15
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BYTE = re.compile(r"<0x[0-9A-F]{2}>")
WORD = re.compile(f"{SPACE}?[^{SPACE}]+|{SPACE}")


@dataclass
class Counter:
    """Counts the pieces of texts under (piece, score) pairs; bytes: whether unknown characters become bytes."""

    pieces: list[tuple[str, float]]
    bytes: bool = True
    _kept: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "bytes": self.bytes, "_kept": {}}

    @cached_property
    def _automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for piece, score in self.pieces:
            if piece and piece not in found:
                found.add_word(piece, (len(piece), score))
        found.make_automaton()
        return found

    @cached_property
    def _unknown(self) -> float:
        return min((score for _, score in self.pieces), default=0.0) - UNKNOWN_PENALTY

    @cached_property
    def _reach(self) -> int:
        return max((len(piece) for piece, _ in self.pieces), default=1) + 1

    def _ending(self, word: str) -> Iterator[tuple[str, list[tuple[int, float]]]]:
        """Each character of the word with the pieces (length, score) that end at it, longest first; the automaton goes on from one part of the word to the next."""
        found = None
        for at in range(0, len(word), PART):
            part = word[at : at + PART]
            ending: list[list[tuple[int, float]]] = [[] for _ in part]
            if len(self._automaton):
                if found is None:
                    found = self._automaton.iter(part)
                else:
                    found.set(part)
                for last, piece in found:
                    ending[last - at].append(piece)
            for pieces in ending:
                pieces.sort(reverse=True)
            yield from zip(part, ending, strict=True)

    def best(self, word: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation. What is kept is as long as the longest piece, not as the word."""
        n = self._reach
        score, count, open_run = [0.0] * n, [0] * n, [False] * n
        end = 0
        for end, (char, ending) in enumerate(self._ending(word), 1):
            here, before = end % n, (end - 1) % n
            top, start, single = None, -1, False
            for length, gain in ending:
                single = single or length == 1
                if top is None or gain + score[(end - length) % n] > top:
                    start = (end - length) % n
                    top = gain + score[start]
            if not single and (top is None or self._unknown + score[before] > top):
                more = len(char.encode()) if self.bytes else not open_run[before]
                score[here], count[here], open_run[here] = self._unknown + score[before], count[before] + more, True
            else:
                score[here], count[here], open_run[here] = top, count[start] + 1, False
        return score[end % n], count[end % n]

    def count(self, text: str) -> int:
        """Pieces of a text whose spaces are the piece mark, with one put before it, each word by itself."""
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        words = WORD.findall(marked if marked.startswith(SPACE) else SPACE + marked)
        counts = list(map(self._kept.get, words))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    if (n := self._kept.get(words[i])) is None:
                        n = self.best(words[i])[1]
                        if len(self._kept) >= KEPT_WORDS:
                            self._kept.clear()
                        if len(words[i]) <= 64:
                            self._kept[words[i]] = n
                    counts[i] = n
        return sum(counts)


def unigram_pieces(path: str) -> list[tuple[str, float]]:
    """The pieces of a vocabulary file, in its order, without control pieces and single bytes.

    The file gives ranks, not likelihoods; a piece of rank r scores -log(r + 2), Zipf's law up to a
    constant. Only the driver reads the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(piece, -log(rank + 2)) for rank, piece in enumerate(found)]


def token_count(counter: Counter, text: Column) -> Column:
    """Number of tokens of a text; null and empty texts have none."""

    @F.arrow_udf(T.LongType())
    def counted(column: pa.Array) -> pa.Array:
        return pa.array([counter.count(t or "") for t in column.to_pylist()], pa.int64())

    return counted(text)


def with_token_counts(documents: DataFrame, counter: Counter) -> DataFrame:
    """One row per input row: doc_id and n_tokens. Null ids and repeated rows stay; an empty table gives none; other columns are not read."""
    return documents.select("doc_id", token_count(counter, F.col("text")).alias("n_tokens"))
