"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate as _decontaminate
from . import digests as _digests
from . import html_text as _html_text
from . import licenses as _licenses
from . import manifest as _manifest
from . import mixing as _mixing
from . import negatives as _negatives
from . import neighbours as _neighbours
from . import quality as _quality
from . import repeats as _repeats
from . import simhash as _simhash
from . import tokens as _tokens
from . import warc as _warc
from .common import small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


@_query
def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


@_query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return _quality.with_quality(documents, _quality.train(documents, table(spark, sf_dir, "labels")))


@_query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(table(spark, sf_dir, "documents"))


@_query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licenses.scan(table(spark, sf_dir, "documents"))


ORACLES["op8_license_scan"] = _licenses.SCAN_SQL


@_query
def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op2_warc_round_trip"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
last AS (SELECT d, max(page_id) AS last_id FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN last_id IS NOT NULL AND p.page_id IS DISTINCT FROM last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
FROM p LEFT JOIN last ON p.d = last.d AND p.n >= 1000
"""


@_query
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, of strings of 400 bytes; and the text without these and without repeated strings of 51 whole words."""
    return _repeats.without_repeats(table(spark, sf_dir, "documents"), as_text=True, words=_repeats.PASSAGE_WORDS).withColumnRenamed("kept", "text")


@_query
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests.edited_likeness(table(spark, sf_dir, "documents"))


@_query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html_text.extract(table(spark, sf_dir, "pages"))


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = _tokens.VOCABULARY) -> DataFrame:
    return _tokens.with_token_counts(table(spark, sf_dir, "documents"), _tokens.Counter(_tokens.unigram_pieces(vocabulary)))


@_query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest.proofs(table(spark, sf_dir, "documents"))


ORACLES["op11_merkle_manifest"] = _manifest.PROOFS_SQL


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negatives of embeddings whose labels are moved on by one where seven divides the id."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return _negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


ORACLES["op13_hard_negatives"] = _negatives.NEGATIVES_SQL


@_query
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours.nearest(table(spark, sf_dir, "embeddings"))


ORACLES["op12_nearest_neighbours"] = _neighbours.NEAREST_SQL
