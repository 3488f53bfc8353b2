"""Safety envelope and time to collision: pairs of an ego and the others of its frame, counts, and how perception counts against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymesh.functions import kinematics as K
from waymesh.operators import sensing

HORIZON = 1.0


def ego_pairs(egos: DataFrame, others: DataFrame, keys: list[str], reach: float | None = None) -> DataFrame:
    """Each ego (ego_id, x, y, yaw, evx, evy) with every other object of its keys: dlong, dlat, vlong, vlat in the ego's frame.

    All others count, as each can be beside or behind the envelope however far it is, so there are
    egos x objects pairs for each set of keys. With a reach only those within it are paired, by cells."""
    pairs = egos.join(others, keys) if reach is None else sensing.within_range(egos, others, reach, tuple(keys)).drop("distance")
    pairs = pairs.where(F.col("ego_id") != F.col("object_id"))
    dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    dlong, dlat = K.in_frame(dx, dy, F.col("yaw"))
    vlong, vlat = K.in_frame(F.col("vx") - F.col("evx"), F.col("vy") - F.col("evy"), F.col("yaw"))
    return pairs.withColumns({"dlong": dlong, "dlat": dlat, "vlong": vlong, "vlat": vlat})


def envelope(rho: Column, decel_min: Column) -> tuple[Column, Column]:
    """How far ahead and aside of an ego (evx, evy) the envelope reaches, for an object at rest relative to it."""
    brake = decel_min * rho * rho / 2
    speed = F.sqrt(F.col("evx") * F.col("evx") + F.col("evy") * F.col("evy"))
    return speed * rho + brake, brake


def breaks_envelope(rho: Column, decel_min: Column) -> Column:
    """Whether a pair is closer along or across than the envelope; distances count with their sign."""
    ahead, aside = envelope(rho, decel_min)
    return (F.col("dlong") < ahead + F.col("vlong") * rho) | (F.col("dlat") < aside + F.col("vlat") * rho)


def time_to_collision() -> Column:
    """Distance over relative speed along the heading; null where that is zero."""
    return F.try_divide("dlong", "vlong")


def will_collide(closing_only: bool = False) -> Column:
    ttc = time_to_collision()
    hit = F.coalesce((ttc > 0) & (ttc <= HORIZON), F.lit(False))
    return hit & (F.col("vlong") < 0) if closing_only else hit


def counts(pairs: DataFrame, calendar: DataFrame, keys: list[str], category: DataFrame) -> DataFrame:
    """Violations for each row of the calendar, zero included."""
    pairs = pairs.join(F.broadcast(category), how="inner") if "rho" not in pairs.columns else pairs  # one row
    found = pairs.groupBy(*keys).agg(F.count_if(breaks_envelope(F.col("rho"), F.col("decel_min"))).alias("envelope"), F.count_if(will_collide()).alias("ttc"))
    return calendar.join(found, keys, "left").select(*keys, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("envelope", "ttc")))


#: Objects of a packet, and the side of a region in metres, inside which packets are cut.
PACKET, REGION = 64, 512.0
#: Bounds decide a packet only where they are so far, for their size, from the threshold.
MARGIN = 1e-9


def packets(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Objects (object_id, side, cx, cy, vx, vy) of a set of keys and side in packets of PACKET at most, near each other, with their number and their least and greatest values.

    They are cut in strips inside regions, so that a set of keys with many objects is spread over tasks."""
    region, strip = ([F.floor(F.col(c) / size) for c in ("cx", "cy")] for size in (REGION, REGION / 16))
    order = Window.partitionBy(*keys, "side", "_rx", "_ry").orderBy("_strip", "cy")
    rows = objects.withColumns({"_rx": region[0], "_ry": region[1], "_strip": strip[0]})
    rows = rows.withColumn("_packet", F.floor((F.row_number().over(order) - 1) / PACKET))
    values = ("cx", "cy", "vx", "vy")
    bounds = [f(c).alias(f"{name}_{c}") for c in values for name, f in (("least", F.min), ("most", F.max))]
    return rows.groupBy(*keys, "side", "_rx", "_ry", "_packet").agg(F.count("*").alias("n"), *bounds, F.collect_list(F.struct("object_id", *values)).alias("members")).drop("_rx", "_ry", "_packet")


def _range(terms: list[tuple[Column, str]]) -> tuple[Column, Column]:
    """Least and greatest of a sum of factors times values, of which the packet's bounds are known."""
    ends = [(k * F.col(f"least_{c}"), k * F.col(f"most_{c}")) for k, c in terms]
    low, high = sum((F.least(*e) for e in ends), F.lit(0.0)), sum((F.greatest(*e) for e in ends), F.lit(0.0))
    slack = MARGIN * (F.abs(low) + F.abs(high) + sum((F.abs(k) for k, _ in terms), F.lit(1.0)) * 1e3)
    return low - slack, high + slack


def _of_packet(rho: Column, decel_min: Column) -> tuple[Column, Column]:
    """How many of a packet break an ego's envelope, and how many it will collide with.

    Every predicate is a half plane: linear in an object's place and velocity. Where the packet's bounds
    are all on one side it counts as a whole or not at all; else its members are looked at."""
    c, s = F.col("_c"), F.col("_s")
    here = {"cx": F.col("x"), "cy": F.col("y"), "vx": F.col("evx"), "vy": F.col("evy")}
    ahead, aside = envelope(rho, decel_min)
    along, across = [(c, "cx"), (s, "cy")], [(-s, "cx"), (c, "cy")]
    moving, drifting = [(c, "vx"), (s, "vy")], [(-s, "vx"), (c, "vy")]

    def side(terms: list[tuple[Column, str]], bound: Column) -> tuple[Column, Column]:
        low, high = _range(terms)
        own = sum((k * here[v] for k, v in terms), F.lit(0.0))
        return high - own < bound, low - own >= bound  # all below the bound, all at or above it

    less = lambda terms: [(-k * rho, v) for k, v in terms]
    long_in, long_out = side(along + less(moving), ahead)
    lat_in, lat_out = side(across + less(drifting), aside)
    member = lambda m, f: _hits(m, rho, ahead, aside)[f]
    breaks = F.when(long_in | lat_in, F.col("n")).when(long_out & lat_out, 0).otherwise(F.size(F.filter("members", lambda m: member(m, 0))))
    # before and behind: the distance, and what it is a horizon later, have different signs
    now, later = side(along, F.lit(0.0)), side(along + [(-k * HORIZON, v) for k, v in moving], F.lit(0.0))
    never = (now[0] & later[0]) | (now[1] & later[1])
    return breaks.cast("long"), F.when(never, 0).otherwise(F.size(F.filter("members", lambda m: member(m, 1)))).cast("long")


def _hits(m: Column, rho: Column, ahead: Column, aside: Column) -> tuple[Column, Column]:
    """Whether an object (cx, cy, vx, vy) breaks the envelope, and whether it will be met: the predicates above, of a struct."""
    dx, dy, dvx, dvy = m["cx"] - F.col("x"), m["cy"] - F.col("y"), m["vx"] - F.col("evx"), m["vy"] - F.col("evy")
    c, s = F.col("_c"), F.col("_s")
    dlong, dlat, vlong, vlat = dx * c + dy * s, -dx * s + dy * c, dvx * c + dvy * s, -dvx * s + dvy * c
    ttc = F.try_divide(dlong, vlong)
    return (dlong < ahead + vlong * rho) | (dlat < aside + vlat * rho), F.coalesce((ttc > 0) & (ttc <= HORIZON), F.lit(False))


def violations(egos: DataFrame, objects: DataFrame, keys: list[str], category: DataFrame, sides: tuple[str, ...] = ("truth", "seen")) -> DataFrame:
    """envelope_ and ttc_ counts of each side for each ego (keys and ego_id, with x, y, yaw, evx, evy), zeros included; an ego's own object does not count.

    Egos meet packets of objects, not objects: a row for each ego and PACKET of them. What an ego counts
    of itself is found by its id and taken off. keys may hold ego_id, where each ego has its own objects."""
    by = [*keys, *(k for k in ("ego_id",) if k not in keys)]
    egos = egos.join(F.broadcast(category.select("rho", "decel_min"))).withColumns({"_c": F.cos("yaw"), "_s": F.sin("yaw")})  # one row
    objects = objects.where(F.col("object_id").isNotNull())
    rho, decel_min = F.col("rho"), F.col("decel_min")
    breaks, hits = _of_packet(rho, decel_min)
    met = egos.join(packets(objects, keys), keys, "left").select(*by, "side", F.coalesce(breaks, F.lit(0)).alias("envelope"), F.coalesce(hits, F.lit(0)).alias("ttc"))
    own = F.struct("cx", "cy", "vx", "vy")
    mine = objects.where(F.col("object_id") == F.col("ego_id")) if "ego_id" in keys else objects.withColumn("ego_id", F.col("object_id"))
    itself = egos.join(mine.drop("object_id"), by)
    one, two = _hits(own, rho, *envelope(rho, decel_min))
    taken = itself.select(*by, "side", (-one.cast("long")).alias("envelope"), (-two.cast("long")).alias("ttc"))
    sums = [F.coalesce(F.sum(F.when(F.col("side") == s, F.col(c))), F.lit(0).cast("long")).alias(f"{c}_{s}") for s in sides for c in ("envelope", "ttc")]
    return met.unionByName(taken).groupBy(*by).agg(*sums)


def confusion(truth: str, seen: str, name: str) -> list[Column]:
    """True and false positives and misses, from counts alone."""
    t, s = F.col(truth), F.col(seen)
    tp = F.least(t, s)
    zero = F.lit(0).cast("long")
    return [F.greatest(tp, zero).alias(f"{name}_tp"), F.greatest(s - tp, zero).alias(f"{name}_fp"), F.greatest(t - tp, zero).alias(f"{name}_fn")]
