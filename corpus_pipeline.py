"""A corpus through five stages: quality, near duplicates, repeated strings, benchmark leaks, and the mix of sources.

Each stage takes (spark, docs, sf_dir), works on all documents it is given, and returns the columns
of documents (the last adds those of the mix). Rows with null texts are empty documents; null and
repeated ids are kept apart by their texts; columns besides those of documents are dropped at the
start. Stages on an empty table give an empty table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymesh.llm import decontaminate, mixing, quality, repeats, simhash
from waymesh.llm.common import cleaned, fresh_dir, removed, small_batches, table, written

#: Strings that repeat across documents go from so many words on, however short, and from so many bytes on, however few words.
REPEAT_WORDS = 51
REPEAT_BYTES, REPEAT_GRAM = 300, 96
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, trained on the labelled sample of the corpus, finds good."""
    field = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).where(quality.score(field, F.col("text")) >= quality.THRESHOLD)


def simhash_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more in shingles of five words: that with the smallest id."""
    return simhash.representatives(docs.select(*COLUMNS), similar=True)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of REPEAT_WORDS or REPEAT_BYTES or more that stand twice; n_chars is that of what stays."""
    kept = repeats.without_repeats(docs.select(*COLUMNS), keep=["doc_id", "lang", "source"], length=REPEAT_BYTES, gram=REPEAT_GRAM, as_text=True, words=REPEAT_WORDS)
    return kept.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("key", F.xxhash64("doc_id", "text"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no item of the benchmark."""
    docs = _keyed(docs)
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), id_col="key")
    return docs.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size in words, their source's size and target, and the words that the mix takes of them."""
    docs = _keyed(docs)
    return docs.join(mixing.mix(docs, id_col="key").dropDuplicates(["key"]), "key").drop("key")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", _bounded(quality_classifier)),
    ("SimHash near-dedup", _bounded(simhash_near_duplicates)),
    ("suffix-array dedup", _bounded(suffix_array_dedup)),
    ("benchmark decontamination", _bounded(benchmark_decontamination)),
    ("mixing sources", _bounded(source_mixing)),
]

#: The classifier, suffix arrays and retrieval are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name.split()[0].lower())
        with cleaned(spark):  # what the stage writes on its way
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
