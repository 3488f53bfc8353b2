import os
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from waymesh.llm import tokens as K


def exact(pieces, with_bytes):
    vocabulary = [("<unk>", 0.0), *pieces]
    if with_bytes:
        vocabulary += [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=with_bytes))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=K.SPACE, prepend_scheme="always")
    return t


@pytest.mark.parametrize("seed", range(4))
def test_counts_equal_the_tokenizer(seed):
    """Small alphabets and scores of few values, so that ties are everywhere."""
    rng = random.Random(seed)
    pieces = {K.SPACE: -3.0}
    for _ in range(60):
        pieces["".join(rng.choices("abcé" + K.SPACE, k=rng.randint(1, 4)))] = -float(rng.randint(1, 4))
    pieces = {p: s for p, s in pieces.items() if p != "é"}
    least = min(pieces.values())
    counter, t = K.Counter(list(pieces.items()), bytes=False), exact(list(pieces.items()), False)
    assert counter._unknown == least - 10
    for _ in range(400):
        text = "".join(rng.choices("aabbc é\nZ", k=rng.randint(0, 30)))
        want = t.encode(text, add_special_tokens=False)
        assert counter.count(text) == len(want.ids), (text, want.tokens)


@pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="vocabulary file")
def test_counts_of_the_sample_equal_the_tokenizer(spark):
    pieces = K.unigram_pieces(K.VOCABULARY)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    vocabulary = [(p, s) for p, s in pieces]
    t = exact(vocabulary, True)
    # Pieces for bytes never win by themselves: their strings do not occur in the texts.
    got = {r.doc_id: r.n_tokens for r in K.with_token_counts(spark.createDataFrame(rows), K.Counter(pieces)).collect()}
    assert got == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) for r in rows}


def test_odd_rows(spark):
    counter = K.Counter([(K.SPACE, -1.0), ("a", -1.0), (K.SPACE + "a", -1.5)])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a a"), (3, "a a"), (None, "é"), (4, "a" * 100_000), (5, " ")], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = sorted(map(tuple, K.with_token_counts(df, counter).collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (3, 2), (3, 2), (None, 3), (4, 100_000), (5, 1)], key=str)
    assert K.with_token_counts(df.where("false"), counter).collect() == []
    assert K.Counter([]).count("ab") == 2 + 3


@pytest.mark.parametrize("part", [1, 2, 7])
def test_words_that_are_read_in_parts(monkeypatch, part):
    rng = random.Random(part)
    pieces = {"".join(rng.choices("abcé", k=rng.randint(1, 6))): -float(rng.randint(1, 4)) for _ in range(80)} | {K.SPACE: -2.0}
    t = exact(list(pieces.items()), False)
    monkeypatch.setattr(K, "PART", part)
    counter = K.Counter(list(pieces.items()), bytes=False)
    for _ in range(200):
        text = "".join(rng.choices("abcéZ", k=rng.randint(1, 60)))
        assert counter.count(text) == len(t.encode(text, add_special_tokens=False).ids), text


def test_memory_of_a_long_word():
    import tracemalloc

    rng = random.Random(1)
    word = "".join(rng.choices("abcdefgh", k=400_000))
    counter = K.Counter([("".join(rng.choices("abcdefgh", k=rng.randint(1, 5))), -float(rng.randint(2, 6))) for _ in range(400)] + [(c, -6.0) for c in "abcdefgh"])
    counter.best("a")
    tracemalloc.start()
    counter.best(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15_000_000
