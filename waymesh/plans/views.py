"""The tables that queries share, from the event and region tables; each in Spark, and as a named SQL view."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymesh import scratch
from waymesh.functions import kinematics as K, seeded
from waymesh.operators import augment, scoring, sensing, truth
from waymesh.sources import catalogs, telemetry

SEED = 42
#: Sensors of a platform's kind: index, types, extrinsics.
SENSORS = [("CAV", 0, "CAMERA", "YOLO", 1.0, 0.5, 0.0), ("CAV", 1, "RADAR", "SSD", -1.0, 0.0, 3.0), ("CIS", 0, "OS1_128", "POINT_PILLARS", 0.0, 0.0, 0.0)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.from_events(events(spark, sf_dir))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.state(raw(spark, sf_dir))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.site_junctions(telemetry.sites_from_regions(spark.read.parquet(f"{sf_dir}/region.parquet")))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of frames without an error event, off by up to half a metre."""
    frame, slot = F.col("frame"), F.col("slot")
    rows = state(spark, sf_dir).where(F.col("event_type") != "error")
    off = lambda a, b: ((frame * a + slot * b) % 21 - 10).cast("double") / 20
    return rows.select("run_id", "frame", "t", slot.alias("det_ord"), (slot % 2).alias("sensor_idx"), F.col("object_id").alias("truth_id"), (F.col("cx") + off(7, 13)).alias("cx"), (F.col("cy") + off(11, 17)).alias("cy"), "width", "length", "angle", "vx", "vy")


def egos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth object as an ego, at its localized pose."""
    rows = state(spark, sf_dir).where("slot % 5 = 0")
    rows = rows.select("run_id", "frame", "t", F.col("object_id").alias("platform_id"), F.lit("CAV").alias("kind"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("angle").alias("yaw"), "vx", "vy", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("speed"))
    return sensing.localized(rows, catalogs.POSE_ERROR, catalogs.POSE_ERROR)


def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Egos, and the sites in each frame."""
    frames = raw(spark, sf_dir).select("run_id", "frame", "t").distinct()
    fixed = frames.crossJoin(F.broadcast(sites(spark, sf_dir)))  # the four sites in each frame
    fixed = fixed.select("run_id", "frame", "t", F.concat(F.lit("site"), "site_id").alias("platform_id"), F.lit("CIS").alias("kind"), "x", "y", F.lit(0.0).alias("yaw"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("speed"))
    return egos(spark, sf_dir).unionByName(fixed)


def sensor_table(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(*s, 0.0, 0.0, 0.0) for s in SENSORS], "kind string, sensor_idx int, sensor_type string, detector_type string, ex double, ey double, eyaw double, dx double, dy double, dyaw double")
    return rows.join(catalogs.sensor_types(spark), "sensor_type")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensing.sensor_poses(platforms(spark, sf_dir), sensor_table(spark))


def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_from(poses(spark, sf_dir), state(spark, sf_dir))


def seen_from(poses: DataFrame, state: DataFrame) -> DataFrame:
    sensors = poses.select("run_id", "frame", "platform_id", "kind", "sensor_idx", "detector_type", "x", "y", "yaw", "max_range", "fov", "center")
    objects = state.select("run_id", "frame", "t", "slot", "object_id", "cx", "cy", "angle", "width", "length", "vx", "vy")
    return sensing.visible(sensors, objects)


def budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensing.budget(visible(spark, sf_dir), catalogs.detector_types(spark))


KEYS = ("run_id", "frame", "platform_id", "sensor_idx", "object_id")


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.thinned(budgeted(spark, sf_dir), SEED, *KEYS)


def perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.perturbed(thinned(spark, sf_dir), SEED, *KEYS)


def sighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every platform can see, at its true place (true_x, true_y) and where it would be detected, with the expected covariance; and whether it is (seen)."""
    rows = budgeted(spark, sf_dir).withColumns({"true_x": F.col("cx"), "true_y": F.col("cy"), "seen": seeded.uniform(SEED, "detect", *KEYS) <= F.col("probability")})
    cov = sensing.expected_covariance(F.col("distance_error"), F.col("radial_error"), F.col("bearing"))
    rows = augment.perturbed(rows, SEED, *KEYS).withColumns(dict(zip(("c00", "c01", "c11"), cov, strict=True)))
    return rows.select("run_id", "frame", F.col("platform_id").alias("ego_id"), "sensor_idx", "slot", "object_id", "true_x", "true_y", "cx", "cy", "vx", "vy", "width", "length", "c00", "c01", "c11", "seen")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same; reports take it apart in many ways, so it is written."""
    return scratch.written(sighted(spark, sf_dir), "sightings")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with their expected covariances."""
    cov = sensing.expected_covariance(F.col("distance_error"), F.col("radial_error"), F.col("bearing"))
    return perturbed(spark, sf_dir).withColumns(dict(zip(("c00", "c01", "c11"), cov, strict=True)))


def boxes(rows: DataFrame, side: str, *keep: str) -> DataFrame:
    """Box columns named for one side of a pair; boxes axis-parallel, as closed forms check them."""
    names = {"x": "cx", "y": "cy", "w": "width", "l": "length"}
    return rows.select(*keep, *(F.col(c).alias(f"{side}_{k}") for k, c in names.items()), F.lit(0.0).alias(f"{side}_angle"))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections and truth of a frame whose boxes may overlap, with the overlap."""
    a = boxes(detections(spark, sf_dir), "a", "run_id", "frame", "det_ord")
    b = boxes(state(spark, sf_dir), "b", "run_id", "frame", F.col("slot").alias("gt_ord"))
    return scoring.with_iou(scoring.candidates(a, b, ["run_id", "frame"]))


def clean(rows: DataFrame, *columns: str) -> DataFrame:
    """The named columns, those of doubles rounded."""
    kinds = dict(rows.dtypes)
    return rows.select(*(K.clean(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns))


_U = "(CAST(('0x' || substr(md5('{seed}:{name}:' || {keys}), 1, 8)) AS UBIGINT) / 4294967296.0)"


def u(name: str, *keys: str) -> str:
    """The SQL of a seeded uniform."""
    return _U.format(seed=SEED, name=name, keys=" || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys))


def normal(name: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln(({u(name + '.r', *keys)} * 4294967296.0 + 1) / 4294967297.0)) * cos(2 * pi() * {u(name + '.a', *keys)}))"


def r(expression: str, name: str | None = None) -> str:
    """Rounded as clean() does, under the column's own name or another."""
    return f"round({expression}, 6) + 0.0 AS {name or expression}"


def wrap(angle: str) -> str:
    return f"(({angle} + pi()) - 2 * pi() * floor(({angle} + pi()) / (2 * pi())) - pi())"


def axis(sign: str) -> str:
    return f"greatest(0, (c00 + c11) / 2 {sign} sqrt((c00 - c11) * (c00 - c11) / 4 + c01 * c01))"


def _rows(values: list[tuple]) -> str:
    def one(v) -> str:
        if isinstance(v, str):
            return f"'{v}'"
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]::DOUBLE[]"
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(map(one, row)) + ")" for row in values)


def _poly(coefficients: str, x: str) -> str:
    return f"list_sum(list_transform(range(len({coefficients})), lambda i: {coefficients}[i + 1] * pow({x}, i)))"


VIEWS = {
    "raw": """SELECT CAST(event_id // 4000 AS INTEGER) AS run_id, CAST(event_id // 20 AS INTEGER) AS frame, CAST(event_id // 20 AS DOUBLE) / 10 AS t, CAST(event_id % 20 AS INTEGER) AS slot,
        'veh' || CAST(event_id % 20 AS VARCHAR) AS object_id, CASE WHEN event_id % 4 = 3 THEN 'truck' ELSE 'veh_passenger' END AS object_type,
        CAST(((event_id % 20) * 37 + (event_id // 20) * (1 + (event_id % 20) % 7)) % 400 AS DOUBLE) / 4 AS front_x, CAST(((event_id % 20) * 53) % 100 AS DOUBLE) / 2 AS front_y,
        2.5::DOUBLE * (1 + (event_id % 20) % 7) AS speed, 18.0::DOUBLE * (event_id % 20) AS angle_deg, 4.5::DOUBLE AS length, 1.8::DOUBLE AS width, event_type, value FROM events""",
    "state": """SELECT run_id, frame, t, slot, object_id, object_type, length, width, event_type, value, speed * cos(radians(-angle_deg)) AS vx, speed * sin(radians(-angle_deg)) AS vy,
        radians(-angle_deg) + pi() AS angle, front_x - length / 2 * cos(radians(-angle_deg) + pi() / 2) AS cx, front_y - length / 2 * sin(radians(-angle_deg) + pi() / 2) AS cy FROM raw""",
    "sites": """SELECT CAST(r_regionkey AS VARCHAR) AS site_id, 'J' || CAST(r_regionkey AS VARCHAR) AS junction_id, 20::DOUBLE * r_regionkey AS x, 25::DOUBLE AS y FROM region WHERE r_regionkey <> 4""",
    "detections": """SELECT run_id, frame, t, slot AS det_ord, slot % 2 AS sensor_idx, object_id AS truth_id, cx + CAST((frame * 7 + slot * 13) % 21 - 10 AS DOUBLE) / 20 AS cx,
        cy + CAST((frame * 11 + slot * 17) % 21 - 10 AS DOUBLE) / 20 AS cy, width, length, angle, vx, vy FROM state WHERE event_type <> 'error'""",
    "egos": """SELECT run_id, frame, t, object_id AS platform_id, 'CAV' AS kind, cx + e * cos(angle) - e * sin(angle) AS x, cy + e * sin(angle) + e * cos(angle) AS y, angle AS yaw, vx, vy, speed
        FROM (SELECT *, sqrt(vx * vx + vy * vy) AS speed, CAST(0.01 AS DOUBLE) + CAST(0.001 AS DOUBLE) * sqrt(vx * vx + vy * vy) AS e FROM state WHERE slot % 5 = 0)""",
    "platforms": """SELECT * FROM egos UNION ALL SELECT f.run_id, f.frame, f.t, 'site' || s.site_id, 'CIS', s.x, s.y, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT run_id, frame, t FROM raw) f CROSS JOIN sites s""",
    "sensor_types": f"SELECT * FROM (VALUES {_rows(catalogs.SENSOR_TYPES)}) t(sensor_type, max_range, fov, center)",
    "detector_types": f"SELECT * FROM (VALUES {_rows(catalogs.DETECTOR_TYPES)}) t(detector_type, radial, distance, bbox, prob)",
    "sensors": f"SELECT * FROM (VALUES {_rows(SENSORS)}) t(kind, sensor_idx, sensor_type, detector_type, ex, ey, eyaw) JOIN sensor_types USING (sensor_type)",
    "poses": """SELECT p.run_id, p.frame, p.t, p.platform_id, p.kind, s.sensor_idx, s.sensor_type, s.detector_type, s.max_range, s.fov, s.center, p.x + s.ex * cos(p.yaw) - s.ey * sin(p.yaw) AS x,
        p.y + s.ex * sin(p.yaw) + s.ey * cos(p.yaw) AS y, p.yaw + s.eyaw AS yaw FROM platforms p JOIN sensors s ON p.kind = s.kind""",
    "visible": f"""SELECT * FROM (SELECT s.run_id, s.frame, o.t, s.platform_id, s.kind, s.sensor_idx, s.detector_type, s.max_range, s.fov, s.center, o.slot, o.object_id, o.cx, o.cy, o.angle, o.width, o.length, o.vx, o.vy,
        sqrt((o.cx - s.x) * (o.cx - s.x) + (o.cy - s.y) * (o.cy - s.y)) AS distance, {wrap("(atan2(o.cy - s.y, o.cx - s.x) - s.yaw)")} AS bearing FROM poses s JOIN state o ON s.run_id = o.run_id AND s.frame = o.frame)
        WHERE distance <= max_range AND distance > 0.001 AND object_id <> platform_id AND abs({wrap("(center - bearing)")}) <= fov""",
    "budgeted": f"""SELECT v.*, {_poly("d.radial", "v.distance")} AS radial_error, {_poly("d.distance", "v.distance")} AS distance_error, {_poly("d.bbox", "v.distance")} AS bbox_error, {_poly("d.prob", "v.distance")} AS probability
        FROM visible v JOIN detector_types d ON v.detector_type = d.detector_type""",
    "thinned": f"SELECT * FROM budgeted WHERE {u('detect', *KEYS)} <= probability",
    "drawn": f"""SELECT *, pow(distance_error * {normal("along", *KEYS)}, 2) AS va, pow(radial_error * {normal("across", *KEYS)}, 2) AS vb FROM thinned""",
    "shifted": """SELECT *, va * cos(bearing) * cos(bearing) + vb * sin(bearing) * sin(bearing) AS c00, (vb - va) * sin(bearing) * cos(bearing) AS c01, va * sin(bearing) * sin(bearing) + vb * cos(bearing) * cos(bearing) AS c11 FROM drawn""",
    "axes": f"SELECT *, {axis('+')} AS ea, {axis('-')} AS eb, atan2(2 * c01, c00 - c11) / 2 AS phi FROM shifted",
    "perturbed": f"""SELECT * REPLACE (cx + ea * eb / sqrt(ea * ea * sin(phi) * sin(phi) + eb * eb * cos(phi) * cos(phi) + 1e-10) AS cx,
        cy + ea * eb / sqrt(ea * ea * sin(phi - pi() / 2) * sin(phi - pi() / 2) + eb * eb * cos(phi - pi() / 2) * cos(phi - pi() / 2) + 1e-10) AS cy),
        width + bbox_error * {normal("width", *KEYS)} AS box_width, length + bbox_error * {normal("length", *KEYS)} AS box_length FROM axes""",
    "expected": """SELECT * REPLACE (distance_error * distance_error * cos(bearing) * cos(bearing) + radial_error * radial_error * sin(bearing) * sin(bearing) AS c00, (radial_error * radial_error - distance_error * distance_error) * sin(bearing) * cos(bearing) AS c01,
        distance_error * distance_error * sin(bearing) * sin(bearing) + radial_error * radial_error * cos(bearing) * cos(bearing) AS c11) FROM perturbed""",
    "box_pairs": """SELECT *, round(common / (a_w * a_l + b_w * b_l - common), 9) AS iou FROM (SELECT d.run_id, d.frame, d.det_ord, s.slot AS gt_ord, d.width AS a_w, d.length AS a_l, s.width AS b_w, s.length AS b_l,
        greatest(0, least(d.cx + d.width / 2, s.cx + s.width / 2) - greatest(d.cx - d.width / 2, s.cx - s.width / 2)) * greatest(0, least(d.cy + d.length / 2, s.cy + s.length / 2) - greatest(d.cy - d.length / 2, s.cy - s.length / 2)) AS common
        FROM detections d JOIN state s ON d.run_id = s.run_id AND d.frame = s.frame)""",
}


def sql(body: str, **more: str) -> str:
    """The query with the views it names, directly or through others, in front. More views are named first."""
    views = {**VIEWS, **more}
    needed, queue = set(), [body]
    while queue:
        text = queue.pop()
        for name in views:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                queue.append(views[name])
    order = [name for name in views if name in needed]
    return ("WITH " + ",\n".join(f"{name} AS ({views[name]})" for name in order) + "\n" if order else "") + body
