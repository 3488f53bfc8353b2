"""Detections against truth: overlapping pairs, greedy matching, precision, recall and F1, and set-based association of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymesh import scratch
from waymesh.functions import geometry as G

LEAST_IOU = 0.5
#: Cells of a level are so many times as wide as its boxes, so that most boxes touch one cell only.
TILE = 16


def _diagonal(side: str) -> Column:
    w, l = F.col(f"{side}_w"), F.col(f"{side}_l")
    return F.sqrt(w * w + l * l)


def _level(side: str) -> Column:
    """The power of two, as its exponent, that the box's diagonal does not exceed; from 2^-10 to 2^30."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(_diagonal(side), F.lit(1e-3)))), F.lit(-10)), F.lit(30)).cast("int")


def _levels(boxes: DataFrame, side: str) -> DataFrame:
    return boxes.agg(F.array_sort(F.collect_set(_level(side))).alias("_levels"))


def _spread(boxes: DataFrame, side: str) -> DataFrame:
    """Each box in the cells of its own level that the centre of a box of that level or a lower one can be in if it meets it: mostly one, two by two at most."""
    own = F.pow(F.lit(2.0), F.col("_level"))
    size, half = TILE * own, (_diagonal(side) + own) / 2 + 1e-6
    touched = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / size), F.floor((F.col(c) + half) / size)))
    return boxes.withColumn("_level", _level(side)).withColumn("_x", touched(f"{side}_x")).withColumn("_y", touched(f"{side}_y"))


def _placed(boxes: DataFrame, side: str, levels: DataFrame, above: int) -> DataFrame:
    """Each box in the cell of its centre, at each of the levels that is `above` its own or higher."""
    own = _level(side) + above
    rows = boxes.join(F.broadcast(levels)).withColumn("_level", F.explode(F.filter("_levels", lambda x: x >= own))).drop("_levels")  # a row of at most 41 levels
    size = TILE * F.pow(F.lit(2.0), F.col("_level"))
    return rows.withColumns({"_x": F.floor(F.col(f"{side}_x") / size), "_y": F.floor(F.col(f"{side}_y") / size)})


def candidates(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of boxes (columns a_ and b_: x, y, w, l, angle) of equal keys whose circles meet, whatever their sizes.

    The grid is hierarchical: a box belongs to the level of its diagonal, from one power of two to the next,
    whose cells are TILE times as wide. The larger box of a pair is spread over the cells about it at its level,
    the other stands in one cell of that level, so a pair meets once, and joins are on keys, level and cell.
    A box that is much smaller than a cell is shuffled about once; inside a cell, circles are compared. Only levels that
    the other side has are used: where all boxes are of one level the second join is empty."""
    cells = [*keys, "_level", "_x", "_y"]
    of_a, of_b = _levels(a, "a"), _levels(b, "b")
    higher = b.join(F.broadcast(of_a)).where(_level("b") > F.array_min("_levels")).drop("_levels")  # a row
    one = _spread(a, "a").join(_placed(b, "b", of_a, 0), cells)
    two = _spread(higher, "b").join(_placed(a, "a", of_b, 1), cells)
    c = F.col
    pairs = one.unionByName(two).drop("_level", "_x", "_y")
    return pairs.where(G.may_overlap(c("a_x") - c("b_x"), c("a_y") - c("b_y"), c("a_w"), c("a_l"), c("b_w"), c("b_l")))


def with_iou(pairs: DataFrame) -> DataFrame:
    """Adds iou, to nine digits, so that a bound is met or not whatever the last bits are."""
    return pairs.withColumn("iou", F.round(G.iou(*(F.col(f"{s}_{c}") for s in "ab" for c in ("x", "y", "w", "l", "angle"))), 9))


def first_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The matching that takes the pairs (det_ord, gt_ord) of each set of keys in order, each if neither side is taken.

    By rounds: a pair that is the first left for both its sides is taken, and the pairs of its sides
    go. All that are taken in a round are independent, so this is the same matching. A round is
    windows over one side of one set of keys, so nothing is gathered by set; most pairs are the only
    ones of their sides and go in the first. There are as many rounds as the longest chain of pairs
    that wait for each other; their tables are written."""
    found, left = None, scratch.written(pairs.select(*keys, "det_ord", "gt_ord"), "pairs").distinct()
    while True:
        det, gt = Window.partitionBy(*keys, "det_ord"), Window.partitionBy(*keys, "gt_ord")
        rows = left.withColumn("_gt", F.min("gt_ord").over(det)).withColumn("_taken", (F.min("det_ord").over(gt) == F.col("det_ord")) & (F.col("_gt") == F.col("gt_ord")))
        rows = rows.withColumn("_gone", F.max("_taken").over(gt) | F.max("_taken").over(det))
        rows = scratch.written(rows.drop("_gt"), "pairs")
        taken = rows.where("_taken").select(*keys, "det_ord", "gt_ord")
        found = taken if found is None else found.unionByName(taken)
        left = rows.where("NOT _gone").select(*keys, "det_ord", "gt_ord")
        if left.isEmpty():
            return found


def greedy_matches(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """How many detections match: in order, each takes the first truth above the least overlap (column iou) that is free."""
    return first_pairs(pairs.where(F.col("iou") > LEAST_IOU), keys).groupBy(*keys).agg(F.count("*").alias("matches"))


def f1(matches: Column, detections: Column, truths: Column) -> Column:
    """Harmonic mean of precision and recall; zero without truth or match."""
    precision, recall = F.coalesce(F.try_divide(matches, detections), F.lit(0.0)), F.coalesce(F.try_divide(matches, truths), F.lit(0.0))
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def nearest(pairs: DataFrame, by: list[str], *order: str) -> DataFrame:
    """Of each track the nearest candidate within the gate (distance < 0.5), ties by order."""
    w = Window.partitionBy(*by).orderBy("distance", *order)
    return pairs.where("distance < 0.5").withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def duplicate_loser(pairs: DataFrame, mature: int = 4) -> DataFrame:
    """Of two near-equal tracks (0.001 < distance <= 0.25), the one to remove: the newer measurement wins, then more fusion steps, then the first; a winner of fewer than `mature` steps removes nothing."""
    a_wins = (F.col("a_last") > F.col("b_last")) | ((F.col("a_last") == F.col("b_last")) & (F.col("a_steps") >= F.col("b_steps")))
    rows = pairs.where("distance > 0.001 AND distance <= 0.25").withColumn("loser", F.when(a_wins, F.col("b_id")).otherwise(F.col("a_id")))
    return rows.where(F.when(a_wins, F.col("a_steps")).otherwise(F.col("b_steps")) >= mature)
