"""Queries on scans, poses, visibility, expected errors, sampling and faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymesh.functions import geometry as G, kinematics as K
from waymesh.operators import augment, sensing, truth
from waymesh.sources import catalogs, telemetry

from . import views as V
from .registry import query
from .views import KEYS, SEED, clean, r, sql, u


@query(sql(f"SELECT run_id, frame, {r('t')}, object_id, object_type, {r('front_x')}, {r('front_y')}, {r('speed')}, {r('angle_deg')}, length, width FROM raw"))
def telemetry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(V.raw(spark, sf_dir), "run_id", "frame", "t", "object_id", "object_type", "front_x", "front_y", "speed", "angle_deg", "length", "width")


@query(sql("""SELECT a.run_id, a.frame, a.object_id, b.object_type, b.length, b.width FROM raw a JOIN
    (SELECT run_id, object_id, min_by(object_type, frame) AS object_type, min_by(length, frame) AS length, min_by(width, frame) AS width FROM raw GROUP BY ALL) b ON a.run_id = b.run_id AND a.object_id = b.object_id"""))
def static_attr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.raw(spark, sf_dir)
    return rows.select("run_id", "frame", "object_id").join(truth.static_attributes(rows), ["run_id", "object_id"], "left")


@query(sql("SELECT site_id, junction_id, x, y FROM sites"))
def site_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = telemetry.sites_from_regions(spark.read.parquet(f"{sf_dir}/region.parquet"))
    return telemetry.site_junctions(named, named.select("junction_id", "x", "y"))


@query(sql("""SELECT p.run_id, p.platform_frames, s.kind, s.sensor_idx, s.sensor_type, s.max_range, round(s.fov, 6) + 0.0 AS fov, d.detector_type, CAST(len(d.radial) AS INTEGER) AS terms FROM sensors s JOIN detector_types d ON s.detector_type = d.detector_type
    JOIN (SELECT run_id, kind, count(*) AS platform_frames FROM platforms GROUP BY ALL) p ON p.kind = s.kind"""))
def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = V.platforms(spark, sf_dir).groupBy("run_id", "kind").agg(F.count("*").alias("platform_frames"))
    rows = V.sensor_table(spark).join(catalogs.detector_types(spark), "detector_type").join(kinds, "kind")
    return clean(rows.withColumn("terms", F.array_size("radial")), "run_id", "kind", "sensor_idx", "sensor_type", "max_range", "fov", "detector_type", "terms", "platform_frames")


_RUNS = "SELECT CAST(row_number() OVER (ORDER BY e, l) - 1 AS INTEGER) AS run_id, (['NONE', 'MALICIOUS_REMOVAL', 'MALICIOUS_ADDITION', 'MALICIOUS_CONVOY', 'LOCALIZATION'])[e + 1] AS error_type, CAST(30 * l AS INTEGER) AS error_level, CAST(30 * l AS DOUBLE) / 100 AS probability FROM range(5) a(e), range(1, 4) b(l)"
_SWEEP = (["NONE", "MALICIOUS_REMOVAL", "MALICIOUS_ADDITION", "MALICIOUS_CONVOY", "LOCALIZATION"], [30, 60, 90])


def _with_runs(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows under each run of the sweep: every fifteenth frame's rows go to a run of the sweep."""
    return rows.withColumn("run_id", F.col("frame") % 15)


@query(sql("SELECT r.run_id, r.error_type, r.error_level, CAST(count(*) AS BIGINT) AS n_rows FROM runs r JOIN raw a ON a.frame % 15 = r.run_id GROUP BY ALL", runs=_RUNS))
def run_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = catalogs.sweep(spark, *_SWEEP)
    return _with_runs(V.raw(spark, sf_dir), spark).join(runs, "run_id").groupBy("run_id", "error_type", "error_level").agg(F.count("*").alias("n_rows"))


@query(sql(f"SELECT run_id, frame, object_id, {r('cx')}, {r('cy')}, {r('angle')}, {r('vx')}, {r('vy')}, length, width FROM state"))
def truth_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(V.state(spark, sf_dir), "run_id", "frame", "object_id", "cx", "cy", "angle", "vx", "vy", "length", "width")


def _corner_sql(signs, angle: str, view: str) -> str:
    def one(k: int, a: int, b: int) -> str:
        dx, dy = f"({a} * width / 2)", f"({b} * length / 2)"
        return f"{r(f'cx + {dx} * cos({angle}) - {dy} * sin({angle})', f'x{k}')}, {r(f'cy + {dx} * sin({angle}) + {dy} * cos({angle})', f'y{k}')}"

    return ", ".join(one(k, a, b) for k, (a, b) in enumerate(signs))


def _flat(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, *(K.clean(F.col("bbox")[k][c]).alias(f"{c}{k}") for k in range(4) for c in "xy"))


@query(sql(f"SELECT run_id, frame, object_id, {_corner_sql(G.TRUTH_CORNERS, '(angle - pi())', 'state')} FROM state"))
def truth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(truth.with_box(V.state(spark, sf_dir)), "run_id", "frame", "object_id")


@query(sql(f"SELECT run_id, frame, truth_id, {_corner_sql(G.TRACK_CORNERS, 'angle', 'detections')} FROM detections"))
def track_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(truth.with_box(V.detections(spark, sf_dir), G.TRACK_CORNERS, turn_back=False), "run_id", "frame", "truth_id")


@query(sql("SELECT site_id AS object_id, 'traffic_light' AS object_type, x AS cx, y AS cy, 0::DOUBLE AS vx, 0::DOUBLE AS vy, x - 50 AS x0, y - 50 AS y0, x + 50 AS x2, y + 50 AS y2 FROM sites"))
def site_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = truth.site_truth(V.sites(spark, sf_dir))
    return rows.select("object_id", "object_type", "cx", "cy", "vx", "vy", *(K.clean(F.col("bbox")[k][c]).alias(f"{c}{k}") for k in (0, 2) for c in "xy"))


@query(sql(f"SELECT run_id, frame, platform_id, sensor_idx, object_id, detector_type, {r('radial_error')}, {r('distance_error')}, {r('bbox_error')}, {r('probability')} FROM budgeted"))
def error_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(V.budgeted(spark, sf_dir), *KEYS, "detector_type", "radial_error", "distance_error", "bbox_error", "probability")


@query(sql(f"SELECT run_id, frame, platform_id, {r('x')}, {r('y')}, {r('yaw')}, {r('speed')} FROM egos"))
def localized_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(V.egos(spark, sf_dir), "run_id", "frame", "platform_id", "x", "y", "yaw", "speed")


@query(sql(f"SELECT run_id, frame, platform_id, sensor_idx, sensor_type, {r('x')}, {r('y')}, {r('yaw')} FROM poses"))
def sensor_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(V.poses(spark, sf_dir), "run_id", "frame", "platform_id", "sensor_idx", "sensor_type", "x", "y", "yaw")


@query(sql(f"SELECT s.run_id, s.frame, p.site_id, s.object_id, {r('sqrt((s.cx - p.x) * (s.cx - p.x) + (s.cy - p.y) * (s.cy - p.y))', 'distance')} FROM state s JOIN sites p ON sqrt((s.cx - p.x) * (s.cx - p.x) + (s.cy - p.y) * (s.cy - p.y)) <= 30"))
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = V.state(spark, sf_dir).select("run_id", "frame", "object_id", "cx", "cy")
    pairs = sensing.within_range(V.sites(spark, sf_dir).select("site_id", "x", "y"), objects, 30.0, keys=())
    return clean(pairs, "run_id", "frame", "site_id", "object_id", "distance")


@query(sql(f"SELECT run_id, frame, platform_id, sensor_idx, object_id, {r('distance')}, {r('bearing')} FROM visible"))
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(V.visible(spark, sf_dir), *KEYS, "distance", "bearing")


_COV = """SELECT run_id, frame, platform_id, sensor_idx, object_id, a * cos(bearing) * cos(bearing) + b * sin(bearing) * sin(bearing) AS c00, (b - a) * sin(bearing) * cos(bearing) AS c01,
    a * sin(bearing) * sin(bearing) + b * cos(bearing) * cos(bearing) AS c11, distance FROM (SELECT *, distance_error * distance_error AS a, radial_error * radial_error AS b FROM budgeted)"""


def _covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = sensing.expected_covariance(F.col("distance_error"), F.col("radial_error"), F.col("bearing"))
    return V.budgeted(spark, sf_dir).select(*KEYS, *(c.alias(n) for c, n in zip(cov, ("c00", "c01", "c11"), strict=True)), "distance")


@query(sql(f"SELECT run_id, frame, platform_id, sensor_idx, object_id, {r('c00')}, {r('c01')}, {r('c11')} FROM cov", cov=_COV))
def expected_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(_covariances(spark, sf_dir), *KEYS, "c00", "c01", "c11")


@query(sql(f"SELECT run_id, frame, platform_id, sensor_idx, object_id, {r(f'3 * sqrt({V.axis(chr(43))})', 'a')}, {r(f'3 * sqrt({V.axis(chr(45))})', 'b')}, {r(V.axis(chr(43)), 'va')}, {r(V.axis(chr(45)), 'vb')} FROM cov", cov=_COV))
def error_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _covariances(spark, sf_dir)
    c = [F.col(x) for x in ("c00", "c01", "c11")]
    a, b, _ = G.ellipse(*c)
    va, vb, _ = G.ellipse(*c, 1.0, deviation=False)
    return clean(rows.withColumns({"a": a, "b": b, "va": va, "vb": vb}), *KEYS, "a", "b", "va", "vb")


_EDGE = "ea * eb / sqrt(ea * ea * sin({p}) * sin({p}) + eb * eb * cos({p}) * cos({p}) + 1e-10)"


@query(sql(f"SELECT run_id, frame, platform_id, sensor_idx, object_id, {r(_EDGE.format(p='phi'), 'reach_x')}, {r(_EDGE.format(p='(phi - pi() / 2)'), 'reach_y')} FROM ell", cov=_COV, ell=f"SELECT *, {V.axis('+')} AS ea, {V.axis('-')} AS eb, atan2(2 * c01, c00 - c11) / 2 AS phi FROM cov"))
def ellipse_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = G.extents(F.col("c00"), F.col("c01"), F.col("c11"))
    return clean(_covariances(spark, sf_dir).withColumns({"reach_x": x, "reach_y": y}), *KEYS, "reach_x", "reach_y")


_TWO = ", ".join(f"max(c{k}) FILTER (sensor_idx = {i}) AS c{k}_{i}" for i in (0, 1) for k in ("00", "01", "11"))


@query(sql(f"""SELECT run_id, frame, platform_id, object_id, {r('c00_0 + c00_1', 'sum00')}, {r('c01_0 + c01_1', 'sum01')}, {r('c11_0 + c11_1', 'sum11')}, {r('c00_0 - c00_1', 'dif00')}, {r('c11_0 - c11_1', 'dif11')}
    FROM (SELECT run_id, frame, platform_id, object_id, {_TWO} FROM cov GROUP BY ALL) WHERE c00_0 IS NOT NULL AND c00_1 IS NOT NULL""", cov=_COV))
def cov_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["run_id", "frame", "platform_id", "object_id"]
    of = lambda c, i: F.max(F.when(F.col("sensor_idx") == i, F.col(c))).alias(f"{c}_{i}")
    both = _covariances(spark, sf_dir).groupBy(*keys).agg(*(of(c, i) for i in (0, 1) for c in ("c00", "c01", "c11"))).where("c00_0 IS NOT NULL AND c00_1 IS NOT NULL")
    sums = {f"sum{k}": F.col(f"c{k}_0") + F.col(f"c{k}_1") for k in ("00", "01", "11")} | {f"dif{k}": F.col(f"c{k}_0") - F.col(f"c{k}_1") for k in ("00", "11")}
    return clean(both.withColumns(sums), *keys, *sums)


@query(sql("SELECT DISTINCT platform_id, TRY_CAST(nullif(regexp_extract(platform_id, '[0-9]+'), '') AS BIGINT) AS number FROM platforms"))
def platform_int_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.platforms(spark, sf_dir).select("platform_id", K.integer_in(F.col("platform_id")).alias("number")).distinct()


@query(sql(f"SELECT DISTINCT run_id, object_id FROM raw WHERE {u('role', 'run_id', 'object_id')} <= 0.3"))
def role_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.sampled_roles(V.raw(spark, sf_dir), 0.3, SEED)


@query(sql(f"""SELECT run_id, object_id, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS name FROM (SELECT DISTINCT run_id, object_id, {u('package', 'run_id', 'object_id')} AS u FROM raw)"""))
def package_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "name string, weight double")
    rows = V.raw(spark, sf_dir).select("run_id", "object_id").distinct()
    return augment.chosen_packages(rows, packages, SEED, "run_id", "object_id").select("run_id", "object_id", "name")


@query(sql("SELECT run_id, frame, platform_id, sensor_idx, object_id FROM thinned"))
def detect_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.thinned(spark, sf_dir).select(*KEYS)


@query(sql(f"SELECT run_id, frame, platform_id, sensor_idx, object_id, round(cx, 4) + 0.0 AS cx, round(cy, 4) + 0.0 AS cy FROM perturbed"))
def detect_perturb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.perturbed(spark, sf_dir).select(*KEYS, *(K.clean(F.col(c), 4).alias(c) for c in ("cx", "cy")))


@query(sql(f"SELECT run_id, frame, platform_id, sensor_idx, object_id, round(cx - box_width / 2 * cos(angle) + box_length / 2 * sin(angle), 4) + 0.0 AS x0, round(cy - box_width / 2 * sin(angle) - box_length / 2 * cos(angle), 4) + 0.0 AS y0 FROM perturbed"))
def detect_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.perturbed(spark, sf_dir)
    x, y = G.corners(F.col("cx"), F.col("cy"), F.col("box_width"), F.col("box_length"), F.col("angle"))[0]
    return rows.select(*KEYS, K.clean(x, 4).alias("x0"), K.clean(y, 4).alias("y0"))


_FAULTY = "SELECT p.run_id AS run_id, p.platform_id, s.sensor_idx, 0.5::DOUBLE AS probability FROM (SELECT DISTINCT run_id, platform_id, kind FROM platforms) p JOIN sensors s ON p.kind = s.kind"


def _faulty_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.platforms(spark, sf_dir).select("run_id", "platform_id", "kind").distinct().join(F.broadcast(V.sensor_table(spark)), "kind")
    return rows.withColumn("probability", F.lit(0.5))


def _offset_sql(name: str, drawn: str, *keys: str) -> str:
    return ", ".join(r(f"CASE WHEN {drawn} THEN -{m} + 2 * CAST({m} AS DOUBLE) * {u(f'{name}.{c}', *keys)} ELSE 0 END", f"d{c}") for c, m in (("x", 1.0), ("y", 1.0), ("yaw", 0.17)))


@query(sql(f"""SELECT run_id, platform_id, sensor_idx, {_offset_sql('one', "hit AND pick = 1", 'run_id', 'platform_id')} FROM (SELECT *, {u('fault', 'run_id', 'platform_id')} < probability AS hit,
    row_number() OVER (PARTITION BY run_id, platform_id ORDER BY {u('pick', 'run_id', 'platform_id', 'sensor_idx')}, sensor_idx) AS pick FROM faulty)""", faulty=_FAULTY))
def fault_single_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(augment.extrinsics_fault(_faulty_sensors(spark, sf_dir), SEED, single=True), "run_id", "platform_id", "sensor_idx", "dx", "dy", "dyaw")


@query(sql(f"SELECT run_id, platform_id, sensor_idx, {_offset_sql('all', 'hit', 'run_id', 'platform_id')} FROM (SELECT *, {u('fault', 'run_id', 'platform_id')} < probability AS hit FROM faulty)", faulty=_FAULTY))
def fault_multi_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(augment.extrinsics_fault(_faulty_sensors(spark, sf_dir), SEED, single=False), "run_id", "platform_id", "sensor_idx", "dx", "dy", "dyaw")


def _pose_off(c: str, most: str) -> str:
    return f"CASE WHEN {u('fault', 'run_id', 'platform_id', 'frame')} < 0.4 THEN (-{most} + 2 * CAST({most} AS DOUBLE) * {u(f'pose.{c}', 'run_id', 'platform_id', 'frame')}) * 0.4::DOUBLE ELSE 0 END"


@query(sql(f"SELECT run_id, frame, platform_id, {r('x + ' + _pose_off('x', '1.0'), 'x')}, {r('y + ' + _pose_off('y', '1.0'), 'y')}, {r('yaw + ' + _pose_off('yaw', '0.17'), 'yaw')} FROM egos"))
def fault_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = augment.localization_fault(V.egos(spark, sf_dir).withColumn("probability", F.lit(0.4)), SEED)
    return clean(rows, "run_id", "frame", "platform_id", "x", "y", "yaw")


_FRAME_KEYS = ("run_id", "frame", "platform_id", "sensor_idx")
_STRUCK = f"({u('inject', *_FRAME_KEYS)} < probability AND {u('fault', *_FRAME_KEYS)} < probability)"
_SEEN = "SELECT frame % 15 AS run_id, frame, platform_id, sensor_idx, slot AS det_ord, object_id AS truth_id, cx, cy FROM thinned"


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_runs(V.thinned(spark, sf_dir), spark).select(*_FRAME_KEYS, F.col("slot").alias("det_ord"), F.col("object_id").alias("truth_id"), "cx", "cy")


_VICTIM = f"row_number() OVER (PARTITION BY run_id, frame, platform_id, sensor_idx ORDER BY {u('victim', *_FRAME_KEYS, 'det_ord')}, det_ord)"


@query(sql(f"SELECT run_id, frame, platform_id, sensor_idx, truth_id FROM (SELECT *, {_STRUCK} AS struck, {_VICTIM} AS n FROM (SELECT *, 0.7::DOUBLE AS probability FROM seen)) WHERE NOT (struck AND n = 1)", seen=_SEEN))
def fault_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = augment.removal_fault(_seen(spark, sf_dir).withColumn("probability", F.lit(0.7)), SEED)
    return rows.select(*_FRAME_KEYS, "truth_id")


def _fake(low: float, high: float) -> str:
    def draw(name: str, a: float, b: float) -> str:
        return f"CAST({a} AS DOUBLE) + CAST({b - a} AS DOUBLE) * {u(f'fake.{name}', *_FRAME_KEYS)}"

    return f"'fake_' || CAST(CAST(100000 + floor({u('fake.id', *_FRAME_KEYS)} * 900000) AS BIGINT) AS VARCHAR) AS detection_id, {r(draw('x', low, high), 'cx')}, {r(draw('y', low, high), 'cy')}, {r(draw('w', 1.5, 2.5), 'width')}, {r(draw('vx', -5.0, 5.0), 'vx')}, {r(draw('c00', 0.1, 0.5), 'c00')}"


_FAKE_COLUMNS = (*_FRAME_KEYS, "detection_id", "cx", "cy", "width", "vx", "c00")


@query(sql(f"SELECT run_id, frame, platform_id, sensor_idx, {_fake(-100.0, 100.0)} FROM (SELECT DISTINCT run_id, frame, platform_id, sensor_idx, 0.7::DOUBLE AS probability FROM seen) WHERE {_STRUCK}", seen=_SEEN))
def fault_addition(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _seen(spark, sf_dir).select(*_FRAME_KEYS).distinct().withColumn("probability", F.lit(0.7))
    return clean(augment.fake_rows(frames, SEED), *_FAKE_COLUMNS)


@query(sql(f"SELECT run_id, frame, platform_id, sensor_idx, {_fake(20.0, 40.0)} FROM (SELECT DISTINCT run_id, frame, platform_id, sensor_idx, 0.7::DOUBLE AS probability FROM seen) WHERE {_STRUCK}", seen=_SEEN))
def fault_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _seen(spark, sf_dir).select(*_FRAME_KEYS).distinct().withColumn("probability", F.lit(0.7))
    return clean(augment.fake_rows(frames, SEED, (20.0, 40.0)), *_FAKE_COLUMNS)


_FAULTS = (["NONE", "MALICIOUS_REMOVAL", "MALICIOUS_ADDITION", "MALICIOUS_CONVOY", "LOCALIZATION", "SINGLE_SENSOR_EXTRINSICS", "MULTI_SENSOR_EXTRINSICS"], [30, 60, 90])
_FAULT_RUNS = f"SELECT CAST(row_number() OVER (ORDER BY e, l) - 1 AS INTEGER) AS run_id, ({_FAULTS[0]})[e + 1] AS error_type, CAST(30 * l AS DOUBLE) / 100 AS probability FROM range(7) a(e), range(1, 4) b(l)"


def _drawn(hit: str, name: str, most: str, *keys: str, scale: str = "1") -> str:
    return f"CASE WHEN {hit} THEN (-{most} + 2 * CAST({most} AS DOUBLE) * {u(name, *keys)}) * {scale} ELSE 0 END"


_OWN = ("run_id", "platform_id")
_LOST = f"error_type = 'LOCALIZATION' AND {u('fault', *_OWN, 'frame')} < probability"
_OFF = {c: f"{_drawn('single', f'one.{c}', m, *_OWN)} + {_drawn('multi', f'all.{c}', m, *_OWN)}" for c, m in (("x", "1.0"), ("y", "1.0"), ("yaw", "0.17"))}
#: Views of all runs of faults: telemetry under their numbers, platforms and sensors with the faults of their run.
_DISPATCHED = {
    "raw": V.VIEWS["raw"].replace("event_id // 4000", "(event_id // 20) % 21"),
    "platforms": f"SELECT * EXCLUDE (error_type, probability) REPLACE ({', '.join(f'{c} + {_drawn(_LOST, f"pose.{c}", m, *_OWN, "frame", scale="probability")} AS {c}' for c, m in (('x', '1.0'), ('y', '1.0'), ('yaw', '0.17')))}) FROM (SELECT p.*, r.error_type, r.probability FROM ({V.VIEWS['platforms']}) p JOIN ({_FAULT_RUNS}) r ON p.run_id = r.run_id)",
    "poses": f"""SELECT p.run_id, p.frame, p.t, p.platform_id, p.kind, s.sensor_idx, s.sensor_type, s.detector_type, s.max_range, s.fov, s.center, p.x + (s.ex + s.dx) * cos(p.yaw) - (s.ey + s.dy) * sin(p.yaw) AS x, p.y + (s.ex + s.dx) * sin(p.yaw) + (s.ey + s.dy) * cos(p.yaw) AS y, p.yaw + s.eyaw + s.dyaw AS yaw
        FROM platforms p JOIN (SELECT *, {', '.join(f'{e} AS d{c}' for c, e in _OFF.items())} FROM (SELECT *, hit AND error_type = 'SINGLE_SENSOR_EXTRINSICS' AND pick = 1 AS single, hit AND error_type = 'MULTI_SENSOR_EXTRINSICS' AS multi FROM
        (SELECT *, {u('fault', *_OWN)} < probability AS hit, row_number() OVER (PARTITION BY run_id, platform_id ORDER BY {u('pick', *_OWN, 'sensor_idx')}, sensor_idx) AS pick FROM (SELECT q.run_id, q.platform_id, r.error_type, r.probability, s.* FROM (SELECT DISTINCT run_id, platform_id, kind FROM platforms) q JOIN ({_FAULT_RUNS}) r ON q.run_id = r.run_id JOIN sensors s ON q.kind = s.kind)))) s ON p.run_id = s.run_id AND p.platform_id = s.platform_id""",
    "seen": "SELECT run_id, frame, platform_id, sensor_idx, slot AS det_ord, object_id AS truth_id FROM thinned",
    "runs": _FAULT_RUNS,
}


@query(sql(f"""SELECT run_id, error_type, frame, platform_id, sensor_idx, truth_id, NULL AS detection_id FROM (SELECT *, {_STRUCK} AS struck, {_VICTIM} AS n FROM (SELECT s.*, r.error_type, r.probability FROM seen s JOIN runs r ON s.run_id = r.run_id))
    WHERE NOT (error_type = 'MALICIOUS_REMOVAL' AND struck AND n = 1)
    UNION ALL SELECT run_id, error_type, frame, platform_id, sensor_idx, NULL, detection_id FROM (SELECT *, {_fake(0.0, 1.0).split(' AS detection_id')[0]} AS detection_id FROM
    (SELECT DISTINCT s.run_id, s.frame, s.platform_id, s.sensor_idx, r.error_type, r.probability FROM seen s JOIN runs r ON s.run_id = r.run_id WHERE r.error_type IN ('MALICIOUS_ADDITION', 'MALICIOUS_CONVOY'))) WHERE {_STRUCK}""", **_DISPATCHED))
def fault_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run detects under its own fault: of poses and of sensors, which change what is seen, or of detections."""
    runs = catalogs.sweep(spark, *_FAULTS)
    placed = lambda rows: rows.withColumn("run_id", F.col("frame") % 21)
    poses, sensors = augment.dispatched_poses(placed(V.platforms(spark, sf_dir)), V.sensor_table(spark), runs, SEED)
    visible = V.seen_from(sensing.sensor_poses(poses, sensors), placed(V.state(spark, sf_dir)))
    rows = augment.thinned(sensing.budget(visible, catalogs.detector_types(spark)), SEED, *KEYS)
    rows = rows.select(*_FRAME_KEYS, F.col("slot").alias("det_ord"), F.col("object_id").alias("truth_id"), "cx", "cy")
    return augment.dispatched(rows, runs, SEED).select("run_id", "error_type", "frame", "platform_id", "sensor_idx", "truth_id", "detection_id")
