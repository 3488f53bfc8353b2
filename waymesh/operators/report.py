"""Roll-ups of frame metrics: run totals, mean scores, running reports and the long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

COUNTERS = ["envelope_truth", "ttc_truth", "envelope_seen", "ttc_seen", "envelope_tp", "envelope_fp", "envelope_fn", "ttc_tp", "ttc_fp", "ttc_fn"]


#: Frames of a block of running totals.
BLOCK = 1000


def run_totals(metrics: DataFrame) -> DataFrame:
    """Sums of the counters for each run and source, with the platform frames (rows with an ego_id) and the distinct frames."""
    return metrics.groupBy("run_id", "source").agg(*(F.sum(c).alias(c) for c in COUNTERS), F.sum("f1").alias("f1_sum"), F.count("ego_id").alias("platform_frames"), F.count_distinct("frame").alias("steps"))


def scored(score: str, truths: str | None = None) -> Column:
    """Whether a frame's score counts: it is not zero, and there was something to see."""
    counts = F.col(score) != 0
    return counts if truths is None else counts & (F.col(truths) > 0)


def mean_score(metrics: DataFrame, keys: list[str], score: str = "f1", truths: str | None = None) -> DataFrame:
    """Sum, number and mean of the scores that count."""
    use = scored(score, truths)
    rows = metrics.groupBy(*keys).agg(F.sum(F.when(use, F.col(score)).otherwise(0.0)).alias("score_sum"), F.count_if(use).alias("scored_frames"))
    return rows.withColumn("mean_score", F.coalesce(F.try_divide("score_sum", "scored_frames"), F.lit(0.0)))


def running(frames: DataFrame, columns: list[str], every: int = 100, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Totals so far of each run, at every hundredth frame.

    In two levels, so that no task has a whole run: totals of blocks of BLOCK frames, of which what
    went before a block is summed up, and sums inside each block."""
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_block").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.withColumn("_block", F.floor(F.col("frame") / BLOCK))
    blocks = rows.groupBy(*keys, "_block").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))
    blocks = blocks.select(*keys, "_block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    sums = rows.select(*keys, "_block", "frame", *(F.sum(c).over(inside).alias(c) for c in columns)).where(F.col("frame") % every == 0)
    return sums.join(blocks, [*keys, "_block"]).select(*keys, "frame", *((F.coalesce(c, F.lit(0)) + F.col(f"_{c}")).alias(c) for c in columns))


def long_totals(totals: DataFrame, runs: DataFrame) -> DataFrame:
    """Run, error type and level, metric (named by its source) and total."""
    kinds = dict(totals.dtypes)
    numbers = [c for c in totals.columns if c not in ("run_id", "source")]
    wide = totals.select("run_id", "source", *(F.col(c).cast("double") if kinds[c] != "double" else F.col(c) for c in numbers))
    rows = wide.unpivot(["run_id", "source"], numbers, "name", "total").withColumn("metric", F.concat_ws(" ", "source", "name"))
    return rows.join(runs.select("run_id", "error_type", "error_level"), "run_id", "left").select("run_id", "error_type", "error_level", "metric", "total")


def last_writer(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the one that comes last in order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
