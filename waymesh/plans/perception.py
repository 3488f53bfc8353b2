"""Queries on safety, detection quality, association and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from waymesh import scratch
from waymesh.functions import geometry as G, kinematics as K
from waymesh.operators import augment, report, safety, scoring, sensing, tracking, truth
from waymesh.sources import catalogs

from . import views as V
from .registry import query
from .views import clean, r, sql

FRAME = ["run_id", "frame"]
EGO = ["run_id", "frame", "ego_id"]
_RELATIVE = """SELECT *, (cx - x) * cos(yaw) + (cy - y) * sin(yaw) AS dlong, -(cx - x) * sin(yaw) + (cy - y) * cos(yaw) AS dlat, (vx - evx) * cos(yaw) + (vy - evy) * sin(yaw) AS vlong, -(vx - evx) * sin(yaw) + (vy - evy) * cos(yaw) AS vlat
    FROM (SELECT e.run_id, e.frame, e.ego_id, e.kind, e.x, e.y, e.yaw, e.evx, e.evy, o.{id} AS object_id, o.cx, o.cy, o.vx, o.vy FROM poses_of e JOIN {table} o ON e.run_id = o.run_id AND e.frame = o.frame AND e.ego_id <> o.{id} AND {which})"""
_CAV = "e.kind = 'CAV'"
PAIRS = {
    "poses_of": "SELECT run_id, frame, platform_id AS ego_id, kind, x, y, yaw, vx AS evx, vy AS evy FROM platforms",
    "pairs": _RELATIVE.format(id="object_id", table="state", which=_CAV),
    "seen_pairs": _RELATIVE.format(id="truth_id", table="detections", which=_CAV),
    "categories": f"SELECT * FROM (VALUES {V._rows(catalogs.ENVELOPES)}) t(category, rho, decel_min)",
}
_ENVELOPE = "(dlong < sqrt(evx * evx + evy * evy) * rho + decel_min * rho * rho / 2 + vlong * rho OR dlat < decel_min * rho * rho / 2 + vlat * rho)"
_TTC = "coalesce(dlong / nullif(vlong, 0) > 0 AND dlong / nullif(vlong, 0) <= 1, false)"


def _as_egos(platforms: DataFrame) -> DataFrame:
    return platforms.select("run_id", "frame", F.col("platform_id").alias("ego_id"), "kind", "x", "y", "yaw", F.col("vx").alias("evx"), F.col("vy").alias("evy"))


def _egos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_egos(V.egos(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safety.ego_pairs(_egos(spark, sf_dir), V.state(spark, sf_dir).select(*FRAME, "object_id", "cx", "cy", "vx", "vy"), FRAME)


@query(sql(f"SELECT run_id, frame, ego_id, object_id, {r('dlong')}, {r('dlat')}, {r('vlong')}, {r('vlat')} FROM pairs", **PAIRS))
def ego_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(_pairs(spark, sf_dir), *EGO, "object_id", "dlong", "dlat", "vlong", "vlat")


@query(sql(f"SELECT run_id, frame, ego_id, object_id, category FROM pairs, categories WHERE {_ENVELOPE}", **PAIRS))
def envelope_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).crossJoin(F.broadcast(catalogs.envelopes(spark)))  # three categories
    return rows.where(safety.breaks_envelope(F.col("rho"), F.col("decel_min"))).select(*EGO, "object_id", "category")


@query(sql(f"SELECT run_id, frame, ego_id, object_id, {r('dlong / vlong', 'ttc')} FROM pairs WHERE {_TTC}", **PAIRS))
def ttc_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(_pairs(spark, sf_dir).where(safety.will_collide()).withColumn("ttc", safety.time_to_collision()), *EGO, "object_id", "ttc")


_COUNTS = """SELECT e.run_id, e.frame, e.platform_id AS ego_id, coalesce(t.envelope, 0) AS envelope_truth, coalesce(t.ttc, 0) AS ttc_truth, coalesce(s.envelope, 0) AS envelope_seen, coalesce(s.ttc, 0) AS ttc_seen FROM egos e
    LEFT JOIN truth_counts t ON e.run_id = t.run_id AND e.frame = t.frame AND e.platform_id = t.ego_id LEFT JOIN seen_counts s ON e.run_id = s.run_id AND e.frame = s.frame AND e.platform_id = s.ego_id"""
_COUNT = f"SELECT run_id, frame, ego_id, count(*) FILTER ({_ENVELOPE}) AS envelope, count(*) FILTER ({_TTC}) AS ttc FROM {{pairs}}, categories WHERE category = 'Aggressive' GROUP BY ALL"
COUNTS = {**PAIRS, "truth_counts": _COUNT.format(pairs="pairs"), "seen_counts": _COUNT.format(pairs="seen_pairs"), "counts": _COUNTS}


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = V.detections(spark, sf_dir).withColumn("object_id", F.col("truth_id"))
    return _counted(_egos(spark, sf_dir), V.state(spark, sf_dir), seen, FRAME, catalogs.envelopes(spark))


def _counted(egos: DataFrame, truths: DataFrame, seen: DataFrame, keys: list[str], envelopes: DataFrame) -> DataFrame:
    sides = [rows.select(*keys, F.lit(side).alias("side"), "object_id", "cx", "cy", "vx", "vy") for side, rows in (("truth", truths), ("seen", seen))]
    return safety.violations(egos.drop("kind"), sides[0].unionByName(sides[1]), keys, envelopes.where("category = 'Aggressive'"))


@query(sql("SELECT * FROM counts", **COUNTS))
def violations_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


def _confusion_sql(name: str) -> str:
    t, s = f"{name}_truth", f"{name}_seen"
    return f"least({t}, {s}) AS {name}_tp, greatest({s} - least({t}, {s}), 0) AS {name}_fp, greatest({t} - least({t}, {s}), 0) AS {name}_fn"


CONFUSION = {**COUNTS, "confusion": f"SELECT *, {_confusion_sql('envelope')}, {_confusion_sql('ttc')} FROM counts"}


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confused(_counts(spark, sf_dir))


def _confused(counts: DataFrame) -> DataFrame:
    return counts.select("*", *safety.confusion("envelope_truth", "envelope_seen", "envelope"), *safety.confusion("ttc_truth", "ttc_seen", "ttc"))


@query(sql("SELECT * FROM confusion", **CONFUSION))
def violation_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir)


@query(sql(f"SELECT run_id, frame, det_ord, gt_ord, {r('iou')}, {r('1 - iou', 'distance')} FROM box_pairs WHERE iou > 1e-9"))
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.overlaps(spark, sf_dir).where("iou > 1e-9").withColumn("distance", G.iou_distance(F.col("iou")))
    return clean(rows, *FRAME, "det_ord", "gt_ord", "iou", "distance")


@query(sql("SELECT run_id, frame, det_ord, gt_ord FROM box_pairs WHERE iou > 0.5"))
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.overlaps(spark, sf_dir).where("iou > 0.5").select(*FRAME, "det_ord", "gt_ord")


_GATED = """SELECT *, (dx * cos(radians(angle)) + dy * sin(radians(angle))) AS u, (-dx * sin(radians(angle)) + dy * cos(radians(angle))) AS v FROM (SELECT d.run_id, d.frame, d.det_ord, s.slot AS gt_ord, d.angle, s.width, s.length, d.cx - s.cx AS dx, d.cy - s.cy AS dy
    FROM detections d JOIN state s ON d.run_id = s.run_id AND d.frame = s.frame) WHERE sqrt(dx * dx + dy * dy) <= 5"""


@query(sql(f"SELECT run_id, frame, det_ord, gt_ord, {r('CASE WHEN abs(u) < width / 2 AND abs(v) < length / 2 THEN sqrt(dx * dx + dy * dy) / 100 ELSE 1 END', 'gated')} FROM gated", gated=_GATED))
def gated_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = V.detections(spark, sf_dir).select(*FRAME, "det_ord", F.col("cx").alias("x"), F.col("cy").alias("y"), "angle")
    truths = V.state(spark, sf_dir).select(*FRAME, F.col("slot").alias("gt_ord"), "cx", "cy", "width", "length")
    pairs = sensing.within_range(dets, truths, 5.0)
    gated = G.gated_distance(F.col("x"), F.col("y"), F.col("angle"), F.col("cx"), F.col("cy"), F.col("width"), F.col("length"))
    return clean(pairs.withColumn("gated", gated), *FRAME, "det_ord", "gt_ord", "gated")


_STATE = "slot, object_id, cx, cy, vx, vy, width, length"
_COLUMNS = _STATE.split(", ")
#: What each platform can see and what it detects; what all of them can, and their detections of an object made one.
VIEWED = {
    "platform_truth": f"SELECT DISTINCT run_id, frame, platform_id AS ego_id, {_STATE} FROM visible",
    "platform_seen": f"SELECT run_id, frame, platform_id AS ego_id, sensor_idx * 1000 + slot AS det_ord, {_STATE} FROM perturbed",
    "all_truth": f"SELECT DISTINCT run_id, frame, {_STATE} FROM visible",
    "inverse": "SELECT *, c11 / (c00 * c11 - c01 * c01) AS i00, -c01 / (c00 * c11 - c01 * c01) AS i01, c00 / (c00 * c11 - c01 * c01) AS i11 FROM expected",
    "sums": "SELECT run_id, frame, slot, object_id, vx, vy, width, length, count(*) AS n, first(cx) AS x1, first(cy) AS y1, sum(i00) AS s00, sum(i01) AS s01, sum(i11) AS s11, sum(i00 * cx + i01 * cy) AS u, sum(i01 * cx + i11 * cy) AS v FROM inverse GROUP BY ALL",
    "all_seen": "SELECT run_id, frame, slot, object_id, slot AS det_ord, CASE WHEN n = 1 THEN x1 ELSE (s11 * u - s01 * v) / (s00 * s11 - s01 * s01) END AS cx, CASE WHEN n = 1 THEN y1 ELSE (s00 * v - s01 * u) / (s00 * s11 - s01 * s01) END AS cy, vx, vy, width, length FROM sums",
}


def _truth_of(sightings: DataFrame, keys: list[str]) -> DataFrame:
    """What is there to see; counts and scores take it apart in many ways, so it is written."""
    rows = sightings.withColumns({"cx": F.col("true_x"), "cy": F.col("true_y")}).select(*keys, *_COLUMNS)
    return scratch.written(rows.dropDuplicates([*keys, "object_id"]), "truth")


def _seen_by_each(sightings: DataFrame) -> DataFrame:
    return sightings.where("seen").select(*EGO, (F.col("sensor_idx") * 1000 + F.col("slot")).alias("det_ord"), *_COLUMNS)


def _seen_by_all(sightings: DataFrame) -> DataFrame:
    """The detections of all platforms, those of one object made one by their covariances."""
    rows = tracking.pooled(sightings.where("seen"), [*FRAME, "slot", "object_id", "vx", "vy", "width", "length"], information=True)
    rows = rows.withColumn("det_ord", F.col("slot")).withColumnsRenamed({"x": "cx", "y": "cy"})
    return scratch.written(rows.select(*FRAME, "det_ord", *_COLUMNS), "pooled")


def _scores_sql(seen: str, truth: str, keys: str) -> dict[str, str]:
    on = " AND ".join(f"d.{k} = s.{k}" for k in keys.split(", "))
    of = " AND ".join(f"z.{k} = {{}}.{k}" for k in keys.split(", "))
    mine = ", ".join(f"d.{k}" for k in keys.split(", "))
    return {
        f"{truth}_pairs": f"""SELECT * FROM (SELECT {mine}, d.det_ord, s.slot AS gt_ord, greatest(0, least(d.cx + d.width / 2, s.cx + s.width / 2) - greatest(d.cx - d.width / 2, s.cx - s.width / 2)) * greatest(0, least(d.cy + d.length / 2, s.cy + s.length / 2) - greatest(d.cy - d.length / 2, s.cy - s.length / 2)) AS common,
            d.width * d.length + s.width * s.length AS areas FROM {seen} d JOIN {truth} s ON {on}) WHERE round(common / (areas - common), 9) > 0.5""",
        f"{truth}_matched": f"""SELECT {keys}, CAST(len(list_reduce(list([{{'d': det_ord, 'g': gt_ord}}] ORDER BY det_ord, gt_ord), lambda a, x: CASE WHEN len(list_filter(a, lambda p: p.d = x[1].d OR p.g = x[1].g)) > 0 THEN a ELSE list_concat(a, x) END)) AS BIGINT) AS matches FROM {truth}_pairs GROUP BY ALL""",
        f"{truth}_sizes": f"SELECT {keys}, count(*) AS truths FROM {truth} GROUP BY ALL",
        f"{seen}_sizes": f"SELECT {keys}, count(*) AS detections FROM {seen} GROUP BY ALL",
        f"{truth}_scores": f"""SELECT *, coalesce(2 * p * q / nullif(p + q, 0), 0) AS f1 FROM (SELECT z.*, coalesce(d.detections, 0) AS detections, coalesce(m.matches, 0) AS matches, coalesce(CAST(m.matches AS DOUBLE) / nullif(d.detections, 0), 0) AS p, coalesce(CAST(m.matches AS DOUBLE), 0) / truths AS q
            FROM {truth}_sizes z LEFT JOIN {seen}_sizes d ON {of.format(*"d" * 3)} LEFT JOIN {truth}_matched m ON {of.format(*"m" * 3)})""",
    }


SCORES = {**VIEWED, **_scores_sql("platform_seen", "platform_truth", "run_id, frame, ego_id"), **_scores_sql("all_seen", "all_truth", "run_id, frame")}


def _scores(seen: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    """Of each set of keys with something to see: truths, detections, matches and f1."""
    a, b = V.boxes(seen, "a", *keys, "det_ord"), V.boxes(truths, "b", *keys, F.col("slot").alias("gt_ord"))
    matches = scoring.greedy_matches(scoring.with_iou(scoring.candidates(a, b, keys)), keys)
    rows = truths.groupBy(*keys).agg(F.count("*").alias("truths")).join(seen.groupBy(*keys).agg(F.count("*").alias("detections")), keys, "left").join(matches, keys, "left")
    return rows.na.fill(0, ["detections", "matches"]).withColumn("f1", scoring.f1(F.col("matches"), F.col("detections"), F.col("truths")))


@query(sql(f"SELECT run_id, frame, ego_id, truths, detections, matches, {r('f1')} FROM platform_truth_scores", **SCORES))
def detection_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    sightings = scratch.written(V.sighted(spark, sf_dir).drop("c00", "c01", "c11"), "sightings")  # no score needs covariances
    return clean(_scores(_seen_by_each(sightings), _truth_of(sightings, EGO), EGO), *EGO, "truths", "detections", "matches", "f1")


def _both_counts(name: str, truth: str, seen: str) -> dict[str, str]:
    which = "e.ego_id = o.ego_id" if name == "own" else _CAV
    more = {f"{name}_{side}": _COUNT.format(pairs=f"({_RELATIVE.format(id='object_id', table=table, which=which)})") for side, table in (("truth", truth), ("seen", seen))}
    joined = " ".join(f"LEFT JOIN {name}_{side} {side[0]} ON e.run_id = {side[0]}.run_id AND e.frame = {side[0]}.frame AND e.ego_id = {side[0]}.ego_id" for side in ("truth", "seen"))
    rows = f"SELECT e.run_id, e.frame, e.ego_id, e.kind, coalesce(t.envelope, 0) AS envelope_truth, coalesce(t.ttc, 0) AS ttc_truth, coalesce(s.envelope, 0) AS envelope_seen, coalesce(s.ttc, 0) AS ttc_seen FROM poses_of e {joined}"
    return {**more, f"{name}_counts": f"SELECT *, {_confusion_sql('envelope')}, {_confusion_sql('ttc')} FROM ({rows})"}


_ROW = "run_id, frame, ego_id, " + ", ".join(report.COUNTERS)
METRICS = {
    **CONFUSION,
    **SCORES,
    **_both_counts("own", "platform_truth", "platform_seen"),
    **_both_counts("everyone", "all_truth", "all_seen"),
    "metrics": f"""SELECT c.kind AS source, {', '.join(f'c.{x}' for x in _ROW.split(', '))}, coalesce(s.f1, 0) AS f1, coalesce(s.truths, 0) AS truths FROM own_counts c LEFT JOIN platform_truth_scores s ON c.run_id = s.run_id AND c.frame = s.frame AND c.ego_id = s.ego_id
        UNION ALL SELECT 'Global', {_ROW}, 0, 0 FROM everyone_counts WHERE kind = 'CAV' UNION ALL SELECT 'Global', run_id, frame, NULL, {', '.join('0' for _ in report.COUNTERS)}, f1, truths FROM all_truth_scores""",
}


def _own_sides(sightings: DataFrame) -> DataFrame:
    """What each ego can see and what it sees, as sides of its counts: a sighting goes to its ego once, as one row, and is taken apart there."""
    first = F.row_number().over(Window.partitionBy(*EGO, "object_id").orderBy("sensor_idx")) == 1  # of the sensors that can see an object, one has its truth
    truth, seen = (F.struct(F.lit(side).alias("side"), F.col(x).alias("cx"), F.col(y).alias("cy")) for side, x, y in (("truth", "true_x", "true_y"), ("seen", "cx", "cy")))
    rows = sightings.select(*EGO, "sensor_idx", "object_id", "true_x", "true_y", "cx", "cy", "vx", "vy", "seen").repartition(*EGO).withColumn("_first", first)
    sides = F.array_compact(F.array(F.when(F.col("_first"), truth), F.when(F.col("seen"), seen)))
    return rows.select(*EGO, "object_id", "vx", "vy", F.inline(sides))


def _own_metrics(egos: DataFrame, sightings: DataFrame, envelopes: DataFrame, scored: bool, counted: bool) -> DataFrame:
    """A row for each ego on what it can see and sees. Scores, then counts, so that the disk holds what one of them shuffles."""
    spark = egos.sparkSession
    own = egos.select(*EGO, F.col("kind").alias("source"))
    if scored:
        scores = scratch.alone(spark, "scores", lambda: _scores(_seen_by_each(sightings), _truth_of(sightings, EGO), EGO).select(*EGO, "f1", "truths"))
        own = own.join(scores, EGO, "left").na.fill(0, ["f1", "truths"])
    if not counted:
        return own
    counts = _confused(safety.violations(egos.drop("kind"), _own_sides(sightings), EGO, envelopes.where("category = 'Aggressive'")))
    return scratch.alone(spark, "own", lambda: counts.join(own, EGO))


def _metrics(spark: SparkSession, sf_dir: str, scored: bool = True, counted: bool = True) -> DataFrame:
    """A row for each vehicle (CAV) and site (CIS) on what it can see and sees; for each vehicle on what all can and see (Global), and one more, without an ego, with the frame's score. The same rows without scores or without counts for reports that have no use for them."""
    envelopes, egos, sightings = catalogs.envelopes(spark), _as_egos(V.platforms(spark, sf_dir)), V.sightings(spark, sf_dir)
    own = _own_metrics(egos, sightings, envelopes, scored, counted)
    everyone = _global_metrics(_egos(spark, sf_dir), _truth_of(sightings, FRAME), _seen_by_all(sightings), envelopes, scored, counted)
    return own.unionByName(everyone.select(*own.columns))


def global_metrics(spark: SparkSession, sf_dir: str, seen: DataFrame) -> DataFrame:
    """The Global rows on what all platforms can see, against the given objects (run_id, frame, det_ord, object_id, cx, cy, vx, vy, width, length)."""
    truths = _truth_of(V.sighted(spark, sf_dir), FRAME)  # read once, and only what is there to see
    rows = _global_metrics(_egos(spark, sf_dir), truths, seen, catalogs.envelopes(spark))
    return clean(rows, "run_id", "source", "ego_id", "frame", *report.COUNTERS, "f1")


def _global_metrics(cavs: DataFrame, truths: DataFrame, seen: DataFrame, envelopes: DataFrame, scored: bool = True, counted: bool = True) -> DataFrame:
    nothing = {c: F.lit(0).cast("long") for c in report.COUNTERS}
    unscored = {"f1": F.lit(0.0), "truths": F.lit(0).cast("long")}
    rows = _confused(_counted(cavs, truths, seen, FRAME, envelopes)) if counted else cavs.select(*EGO).withColumns(nothing)
    rows = rows.withColumns(unscored)
    frames = _scores(seen, truths, FRAME) if scored else truths.select(*FRAME).distinct().withColumns(unscored)
    frames = frames.withColumns({"ego_id": F.lit(None).cast("string")} | nothing)
    return rows.unionByName(frames.select(*rows.columns)).withColumn("source", F.lit("Global"))


_NAMES = ", ".join(report.COUNTERS)


@query(sql(f"SELECT run_id, source, ego_id, frame, {_NAMES}, {r('f1')} FROM metrics", **METRICS))
def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(_metrics(spark, sf_dir), "run_id", "source", "ego_id", "frame", *report.COUNTERS, "f1")


TOTALS = {**METRICS, "totals": f"SELECT run_id, source, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in report.COUNTERS)}, sum(f1) AS f1_sum, count(ego_id) AS platform_frames, count(DISTINCT frame) AS steps FROM metrics GROUP BY ALL"}


@query(sql(f"SELECT run_id, source, {_NAMES}, {r('f1_sum')}, platform_frames, steps FROM totals", **TOTALS))
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(report.run_totals(_metrics(spark, sf_dir)), "run_id", "source", *report.COUNTERS, "f1_sum", "platform_frames", "steps")


@query(sql(f"SELECT run_id, source, {r('sum(CASE WHEN f1 <> 0 AND truths > 0 THEN f1 ELSE 0 END)', 'score_sum')}, count(*) FILTER (f1 <> 0 AND truths > 0) AS scored_frames, {r('coalesce(sum(f1) FILTER (f1 <> 0 AND truths > 0) / nullif(count(*) FILTER (f1 <> 0 AND truths > 0), 0), 0)', 'mean_score')} FROM metrics GROUP BY ALL", **METRICS))
def mean_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(report.mean_score(_metrics(spark, sf_dir, counted=False), ["run_id", "source"], "f1", "truths"), "run_id", "source", "score_sum", "scored_frames", "mean_score")


_LONG = " UNION ALL ".join(f"SELECT run_id, source || ' {c}' AS metric, CAST({c} AS DOUBLE) AS total FROM totals" for c in [*report.COUNTERS, "f1_sum", "platform_frames", "steps"])
_ERRORS = ["NONE", "LOCALIZATION", "MALICIOUS_REMOVAL"]


@query(sql(f"SELECT run_id, (['NONE', 'LOCALIZATION', 'MALICIOUS_REMOVAL'])[run_id // 10 + 1] AS error_type, CASE WHEN run_id < 30 THEN CAST(run_id % 10 AS INTEGER) END AS error_level, metric, {r('total')} FROM ({_LONG})", **TOTALS))
def totals_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = catalogs.sweep(spark, _ERRORS, list(range(10)))
    return clean(report.long_totals(report.run_totals(_metrics(spark, sf_dir)), runs), "run_id", "error_type", "error_level", "metric", "total")


_FRAME_SUMS = {**METRICS, "frames": "SELECT run_id, source, frame, CAST(sum(envelope_truth) AS BIGINT) AS envelope_truth, CAST(sum(ttc_seen) AS BIGINT) AS ttc_seen FROM metrics GROUP BY ALL"}


@query(sql("SELECT * FROM (SELECT run_id, source, frame, CAST(sum(envelope_truth) OVER w AS BIGINT) AS envelope_truth, CAST(sum(ttc_seen) OVER w AS BIGINT) AS ttc_seen FROM frames WINDOW w AS (PARTITION BY run_id, source ORDER BY frame)) WHERE frame % 100 = 0", **_FRAME_SUMS))
def progress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _metrics(spark, sf_dir, scored=False).groupBy("source", *FRAME).agg(F.sum("envelope_truth").alias("envelope_truth"), F.sum("ttc_seen").alias("ttc_seen"))
    return report.running(frames, ["envelope_truth", "ttc_seen"], keys=("run_id", "source"))


@query(sql("SELECT run_id, frame, object_id, arg_max(platform_id, (platform_id, sensor_idx)) AS platform_id, arg_max(sensor_idx, (platform_id, sensor_idx)) AS sensor_idx FROM thinned GROUP BY ALL"))
def visible_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.thinned(spark, sf_dir).select(*FRAME, "object_id", "platform_id", "sensor_idx")
    return report.last_writer(rows, [*FRAME, "object_id"], "platform_id", "sensor_idx")


@query(sql("SELECT run_id, frame, platform_id, count(*) AS detections, count(DISTINCT object_id) AS objects FROM thinned GROUP BY ALL"))
def all_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.thinned(spark, sf_dir).groupBy(*FRAME, "platform_id").agg(F.count("*").alias("detections"), F.count_distinct("object_id").alias("objects"))


def batch_order() -> list[Column]:
    """The sites' batches of a frame in order of site, then those of vehicles."""
    return [F.desc("kind"), F.asc("platform_id"), F.asc("sensor_idx")]


def batches(detections: DataFrame) -> DataFrame:
    """Adds batch_ord, by batch_order in a frame."""
    w = Window.partitionBy(*FRAME).orderBy(*batch_order())
    return detections.withColumn("batch_ord", F.dense_rank().over(w) - 1)


@query(sql("SELECT run_id, frame, platform_id, sensor_idx, object_id, CAST(dense_rank() OVER (PARTITION BY run_id, frame ORDER BY kind DESC, platform_id, sensor_idx) - 1 AS INTEGER) AS batch_ord FROM thinned"))
def global_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.thinned(spark, sf_dir)
    fixed, moving = rows.where("kind = 'CIS'"), rows.where("kind = 'CAV'")
    return batches(fixed.unionByName(moving)).select(*FRAME, "platform_id", "sensor_idx", "object_id", "batch_ord")


@query(sql("SELECT run_id, frame, platform_id, sensor_idx, object_id AS truth_id, object_id || '_' || CAST(row_number() OVER (PARTITION BY run_id, frame, platform_id, sensor_idx ORDER BY slot) - 1 AS VARCHAR) AS detection_id FROM thinned"))
def detection_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.thinned(spark, sf_dir).select(*FRAME, "platform_id", "sensor_idx", F.col("object_id").alias("truth_id"), "slot")
    return augment.numbered(rows, "slot").drop("slot")


@query(sql("""SELECT run_id, frame, object_id, coalesce(b IS NULL OR b < frame - 1, true) AS arrived, coalesce(a IS NULL OR a > frame + 1, true) AS departed FROM (SELECT *, lag(frame) OVER w AS b, lead(frame) OVER w AS a FROM state WHERE event_type <> 'error' WINDOW w AS (PARTITION BY run_id, object_id ORDER BY frame))
    WHERE b IS NULL OR b < frame - 1 OR a IS NULL OR a > frame + 1"""))
def arrivals_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.state(spark, sf_dir).where("event_type <> 'error'")
    return truth.changes(rows).where("arrived OR departed").select(*FRAME, "object_id", "arrived", "departed")


@query(sql("SELECT a.run_id, a.frame + 1 AS frame, a.object_id FROM state a WHERE a.event_type <> 'error' AND EXISTS (SELECT 1 FROM state b WHERE b.run_id = a.run_id AND b.frame = a.frame + 1 AND b.object_id = a.object_id AND b.event_type <> 'error')"))
def active_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = V.state(spark, sf_dir).where("event_type <> 'error'")
    return truth.still_active(present.select("run_id", (F.col("frame") + 1).alias("frame"), "object_id"), present)


_GATES = """SELECT run_id, frame, gt_ord, det_ord, round(1 - common / ((a_w + 0.5) * (a_l + 0.5) + b_w * b_l - common), 9) AS distance FROM (SELECT s.run_id, s.frame, s.slot AS gt_ord, d.det_ord, s.width AS a_w, s.length AS a_l, d.width AS b_w, d.length AS b_l,
    greatest(0, least(d.cx + d.width / 2, s.cx + (s.width + 0.5) / 2) - greatest(d.cx - d.width / 2, s.cx - (s.width + 0.5) / 2)) * greatest(0, least(d.cy + d.length / 2, s.cy + (s.length + 0.5) / 2) - greatest(d.cy - d.length / 2, s.cy - (s.length + 0.5) / 2)) AS common
    FROM state s JOIN detections d ON d.run_id = s.run_id AND d.frame = s.frame AND s.slot % 3 <> 0)"""


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three truth boxes as tracks, half a metre larger, against the detections of their frame."""
    a = V.boxes(V.state(spark, sf_dir).where("slot % 3 <> 0").withColumns({"width": F.col("width") + 0.5, "length": F.col("length") + 0.5}), "a", *FRAME, F.col("slot").alias("gt_ord"))
    b = V.boxes(V.detections(spark, sf_dir), "b", *FRAME, "det_ord")
    pairs = scoring.with_iou(scoring.candidates(a, b, FRAME))
    return pairs.select(*FRAME, "gt_ord", "det_ord", F.round(G.iou_distance(F.col("iou")), 9).alias("distance"))


@query(sql(f"SELECT run_id, frame, gt_ord, det_ord, {r('distance')} FROM (SELECT *, row_number() OVER (PARTITION BY run_id, frame, gt_ord ORDER BY distance, det_ord) AS n FROM gates WHERE distance < 0.5) WHERE n = 1", gates=_GATES))
def frame_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(scoring.nearest(_gates(spark, sf_dir), [*FRAME, "gt_ord"], "det_ord"), *FRAME, "gt_ord", "det_ord", "distance")


@query(sql("SELECT run_id, frame, det_ord FROM detections d WHERE NOT EXISTS (SELECT 1 FROM gates g WHERE g.run_id = d.run_id AND g.frame = d.frame AND g.det_ord = d.det_ord AND g.distance < 0.5)", gates=_GATES))
def unmatched_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [*FRAME, "det_ord"]
    return V.detections(spark, sf_dir).select(*keys).join(_gates(spark, sf_dir).where("distance < 0.5"), keys, "left_anti")


_TWINS = """SELECT run_id, frame, gt_ord AS a_id, det_ord + 100 AS b_id, 1 - iou AS distance, frame - gt_ord % 2 AS a_last, frame - det_ord % 2 AS b_last, gt_ord % 7 AS a_steps, det_ord % 9 AS b_steps FROM box_pairs WHERE iou > 1e-9"""
_A_WINS = "(a_last > b_last OR (a_last = b_last AND a_steps >= b_steps))"


@query(sql(f"SELECT run_id, frame, a_id, b_id, CASE WHEN {_A_WINS} THEN b_id ELSE a_id END AS loser FROM twins WHERE distance > 0.001 AND distance <= 0.25 AND CASE WHEN {_A_WINS} THEN a_steps ELSE b_steps END >= 4", twins=_TWINS))
def track_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("gt_ord"), F.col("det_ord")
    rows = V.overlaps(spark, sf_dir).where("iou > 1e-9").select(
        *FRAME, a.alias("a_id"), (b + 100).alias("b_id"), (1 - F.col("iou")).alias("distance"), (F.col("frame") - a % 2).alias("a_last"), (F.col("frame") - b % 2).alias("b_last"), (a % 7).alias("a_steps"), (b % 9).alias("b_steps")
    )
    return scoring.duplicate_loser(rows).select(*FRAME, "a_id", "b_id", "loser")


_MEASURED = """SELECT run_id, frame, object_id, cx, cy, a * cos(bearing) * cos(bearing) + b * sin(bearing) * sin(bearing) AS c00, (b - a) * sin(bearing) * cos(bearing) AS c01, a * sin(bearing) * sin(bearing) + b * cos(bearing) * cos(bearing) AS c11
    FROM (SELECT *, distance_error * distance_error AS a, radial_error * radial_error AS b FROM budgeted)"""


def _measured(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    cov = sensing.expected_covariance(F.col("distance_error"), F.col("radial_error"), F.col("bearing"))
    return rows.withColumns(dict(zip(("c00", "c01", "c11"), cov, strict=True)))


@query(sql(f"""SELECT run_id, frame, object_id, n, round(CASE WHEN n = 1 THEN x1 ELSE s00 * u + s01 * v END, 2) + 0.0 AS x, round(CASE WHEN n = 1 THEN y1 ELSE s01 * u + s11 * v END, 2) + 0.0 AS y, {r('s00', 'c00')}, {r('s11', 'c11')} FROM (SELECT run_id, frame, object_id, count(*) AS n, sum(c00) AS s00, sum(c01) AS s01, sum(c11) AS s11,
    sum(c00 * cx + c01 * cy) AS u, sum(c01 * cx + c11 * cy) AS v, first(cx) AS x1, first(cy) AS y1 FROM measured GROUP BY run_id, frame, object_id)""", measured=_MEASURED))
def pooled_measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracking.pooled(_measured(spark, sf_dir, V.budgeted(spark, sf_dir)), [*FRAME, "object_id"])
    return clean(rows.withColumns({c: K.clean(F.col(c), 2) for c in "xy"}), *FRAME, "object_id", "n", "x", "y", "c00", "c11")


FUSED_RADIUS = 0.02
_OFF = f"""SELECT platform_id, sensor_idx, sqrt(pow(e.cx - s.cx, 2) + pow(e.cy - s.cy, 2)) / nullif(sqrt(ex * ex + ey * ey) - {FUSED_RADIUS} * sqrt(2::DOUBLE), 0) AS score FROM (SELECT *, ea * eb / sqrt(ea * ea * sin(phi) * sin(phi) + eb * eb * cos(phi) * cos(phi) + 1e-10) AS ex,
    ea * eb / sqrt(ea * ea * sin(phi - pi() / 2) * sin(phi - pi() / 2) + eb * eb * cos(phi - pi() / 2) * cos(phi - pi() / 2) + 1e-10) AS ey FROM sides) e JOIN state s ON e.run_id = s.run_id AND e.frame = s.frame AND e.object_id = s.object_id"""
_SIDES = f"SELECT * REPLACE (sqrt({V.axis('+')}) AS ea, sqrt({V.axis('-')}) AS eb, atan2(2 * c01, c00 - c11) / 2 AS phi) FROM expected"


@query(sql("SELECT platform_id, sensor_idx, count(*) AS n, round(avg(greatest(-1000, least(1000, score))), 3) + 0.0 AS score FROM offs GROUP BY ALL", sides=_SIDES, offs=_OFF))
def sensor_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of measurements to their objects, over what their covariance lets expect beyond a fused track's."""
    rows = V.measured(spark, sf_dir)
    a, b, phi = G.ellipse(F.col("c00"), F.col("c01"), F.col("c11"), 1.0)
    ex, ey = G.radius_at(a, b, phi, F.lit(0.0)), G.radius_at(a, b, phi, F.pi() / 2)
    objects = V.state(spark, sf_dir).select(*FRAME, "object_id", F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    rows = rows.withColumn("expected", F.sqrt(ex * ex + ey * ey) - FUSED_RADIUS * F.sqrt(F.lit(2.0))).join(objects, [*FRAME, "object_id"])
    off = F.sqrt(F.pow(F.col("cx") - F.col("tx"), 2) + F.pow(F.col("cy") - F.col("ty"), 2))
    score = F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.try_divide(off, F.col("expected"))))
    found = rows.groupBy("platform_id", "sensor_idx").agg(F.count("*").alias("n"), F.avg(score).alias("score"))
    return found.withColumn("score", K.clean(F.col("score"), 3))


