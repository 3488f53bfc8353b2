"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Documents are dealt by a seeded hash to shards of about equal size; those of a small source to so few
that it has some blocks in each, and sources of less than that to shards of small sources with smaller blocks. In each shard, the tokens of
each source lie end to end in seeded order and are cut into blocks of equal size; the shard's seats
(blocks it is to give) go to the sources by the highest quotients weight / (2 k + 1). A source whose
seats exceed its tokens gives all of them as often as they go into the seats, and for the rest the
blocks that follow a seeded one on the ring. As the order is random, so is the choice; as the blocks
are consecutive, what a document gives follows from its place alone, and no block is ever a row.

Only per-source totals reach the driver; a source of any share is spread over all shards."""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

WEIGHTS, GROWTH, MOST, SEED = (5, 2, 1), 1.5, 2.0, 17
SHARD_TOKENS = 1_000_000
#: Seats (blocks to give) of a shard, and the blocks that a source has in each shard it is dealt to, at least.
SEATS, LEAST_BLOCKS = 2048, 64


def words(text: Column) -> Column:
    """Number of maximal runs of bytes that are no white space (space, tab to carriage return); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, growth: float = GROWTH, most: float = MOST) -> dict[str | None, float]:
    """Each source's target: sources in code point order, null last, get the weights in turn and share growth x all sizes; none gets over most x its size, and the excess is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = dict(zip(order, cycle(weights), strict=False))
    left, still, found = growth * sum(sizes.values()), set(order), {}
    while still:
        share = left / sum(weight[s] for s in order if s in still)
        if not (full := [s for s in order if s in still and weight[s] * share > most * sizes[s]]):
            found |= {s: weight[s] * share for s in still}
            break
        for s in full:
            found[s] = most * sizes[s]
            left -= found[s]
            still.remove(s)
    return found


def places(goal: dict[str | None, float], shards: int, block: int) -> dict[str | None, tuple[int, int, int, int]]:
    """For each source the tokens of its blocks, the first and the number of the shards that it may be dealt to, and of how many of them it is.

    A source with a target of LEAST_BLOCKS blocks or more is in as many of the common shards as have that
    many blocks each. Smaller ones are apportioned among those of about their size, whole, in shards of
    their own and by smaller blocks: of a power of two, so that a target has LEAST_BLOCKS of them, or by words."""
    found, tiers = {}, {}
    for s, g in goal.items():
        if block == 1 or g >= LEAST_BLOCKS * block:
            found[s] = (block, 0, shards, max(1, min(shards, int(g // (LEAST_BLOCKS * block)))))
        else:
            tiers.setdefault(1 << max(0, int(g // LEAST_BLOCKS).bit_length() - 1), []).append(s)
    base = shards
    for own, sources in sorted(tiers.items()):
        width = max(1, round(max(sum(goal[s] for s in sources) / own, len(sources)) / SEATS))
        found |= {s: (own, base, width, 1) for s in sources}
        base += width
    return found


def _unit(*keys: Column | str) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def mix(documents: DataFrame, id_col: str = "doc_id", seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, growth: float = GROWTH, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's) and taken (words the mix takes, repeats counted).

    Null texts have size 0 and give nothing; a null source is a source of its own, a null id an id
    like any other; documents with one id are told apart by their texts. Rows that repeat as a whole
    are counted first and dealt in lots of at most a shard's tokens, so they crowd no shard, and
    come out as often as they stand. Reruns agree. No document gives more than `most` times its size. An empty table
    gives no rows; other columns are not read."""
    spark = documents.sparkSession
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # a null source is a key too
    rows = documents.select(F.col(id_col).alias("doc_id"), key.alias("key"), words(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    rows = written(rows.groupBy("doc_id", "key", "size", "hash").agg(F.count("*").alias("rows")), "sizes")
    sizes = {(r.key[1:] if r.key else None): r.n for r in rows.groupBy("key").agg(F.sum(F.col("size") * F.col("rows")).alias("n")).collect()}
    goal = targets(sizes, weights, growth, most)
    total = sum(goal.values())
    shards = max(1, round(sum(sizes.values()) / SHARD_TOKENS))
    block = max(1, round(total / (shards * SEATS)))
    of_source = [("" if s is None else f"={s}", sizes[s], float(goal[s]), *at) for s, at in places(goal, shards, block).items()]
    # Written, so that Spark knows its size and broadcasts it if that is small.
    of_source = written(spark.createDataFrame(of_source, "key string, source_size long, target double, block long, base long, width long, spread long").coalesce(1), "sources")

    lot = F.greatest(F.lit(1), F.lit(SHARD_TOKENS) / F.greatest("size", F.lit(1))).cast("long")  # rows in a lot
    dealt = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / lot))))
    dealt = dealt.withColumn("copies", F.least(lot, F.col("rows") - F.col("lot") * lot)).join(of_source.select("key", "base", "width", "spread"), "key")
    first, one = F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("width")), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "hash", "lot"), F.col("spread"))
    dealt = dealt.withColumn("shard", F.col("base") + F.pmod(first + one * F.floor(F.col("width") / F.col("spread")), F.col("width"))).drop("base", "width", "spread")
    here = dealt.groupBy("shard", "key").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens")).join(of_source, "key")
    here = here.withColumn("weight", F.expr("if(source_size = 0, 0D, target * tokens / source_size)"))
    in_shard = Window.partitionBy("shard")
    here = here.withColumn("shard_seats", F.round(F.sum("weight").over(in_shard) / F.col("block")).cast("long"))
    #: Sainte-Laguë gives a source less than twice its fair share of the seats, and one.
    fair = F.try_divide(F.col("shard_seats") * F.col("weight"), F.sum("weight").over(in_shard))
    asked = here.withColumn("asked", F.least("shard_seats", F.ceil(2 * fair).cast("long") + 1)).where("weight > 0 AND asked > 0")
    quotients = asked.select("shard", "key", "weight", "shard_seats", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asked") - 1)).alias("k"))
    highest = Window.partitionBy("shard").orderBy(F.desc(F.col("weight") / (2 * F.col("k") + 1)), "key")
    won = quotients.withColumn("place", F.row_number().over(highest)).where("place <= shard_seats")
    quota = won.groupBy("shard", "key").agg(F.count("*").alias("seats"))
    shares = here.join(quota, ["shard", "key"], "left").select("shard", "key", "tokens", "source_size", "target", "block", F.coalesce("seats", F.lit(0).cast("long")).alias("seats"))

    place = Window.partitionBy("shard", "key").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "hash", "lot"), "doc_id", "hash", "size", "lot")
    placed = dealt.withColumn("end", F.sum(F.col("size") * F.col("copies")).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    found = placed.join(shares, ["shard", "key"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    found = found.withColumn("end", F.col("end") - (F.col("copies") - F.col("copy")) * F.col("size"))
    found = found.withColumns({"begin": F.col("end") - F.col("size"), "at": _unit(F.lit(seed + 2), "shard", "key")})
    found = found.withColumn("given", F.least(F.col("seats") * F.col("block"), F.floor(F.col("tokens") * F.lit(float(most))).cast("long")))
    found = found.withColumns({"rounds": F.expr("if(tokens = 0, 0, given div tokens)"), "rest": F.expr("if(tokens = 0, 0, given % tokens)"), "first": F.floor(F.col("at") * F.floor(F.col("tokens") / F.col("block"))).cast("long") * F.col("block")})
    found = found.withColumn("last", F.col("first") + F.col("rest"))
    overlap = lambda a, b: F.greatest(F.lit(0).cast("long"), F.least("end", b) - F.greatest("begin", a))
    taken = F.col("rounds") * F.col("size") + overlap(F.col("first"), F.col("last")) + overlap(F.col("first") - F.col("tokens"), F.col("last") - F.col("tokens"))
    return found.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", F.least(taken, F.floor(F.col("size") * F.lit(float(most)))).cast("long").alias("taken"))
