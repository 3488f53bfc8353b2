"""Poses of platforms and sensors, range joins, visibility and expected errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymesh.functions import geometry as G, kinematics as K


def localized(platforms: DataFrame, lateral: list[float], longitudinal: list[float]) -> DataFrame:
    """The pose a platform believes in: moved by polynomials of its speed; x, y, yaw and speed are given."""
    left, ahead = K.polynomial(lateral, F.col("speed")), K.polynomial(longitudinal, F.col("speed"))
    x, y = K.moved(F.col("x"), F.col("y"), F.col("yaw"), ahead, left)
    return platforms.withColumns({"x": x, "y": y})


def sensor_poses(platforms: DataFrame, sensors: DataFrame) -> DataFrame:
    """Each sensor of a platform's kind at its place: extrinsics and their error in the platform's frame. Sensors with a platform_id (and run_id) are that platform's own."""
    own = "platform_id" in sensors.columns
    rows = platforms.join(sensors, ["run_id", "platform_id", "kind"]) if own else platforms.join(F.broadcast(sensors), "kind")  # a row for each sensor of a kind
    x, y = K.moved(F.col("x"), F.col("y"), F.col("yaw"), F.col("ex") + F.col("dx"), F.col("ey") + F.col("dy"))
    return rows.withColumns({"x": x, "y": y, "yaw": F.col("yaw") + F.col("eyaw") + F.col("dyaw")})


#: Side of a cell of range joins with a reach of each sensor's own, in metres: the least range of the catalog's sensors.
CELL = 100.0


def within_range(sensors: DataFrame, objects: DataFrame, reach: float | str, keys: tuple[str, ...] = ("run_id", "frame"), cell: float | None = None) -> DataFrame:
    """Pairs of a sensor (x, y) and an object (cx, cy) of the same keys within reach, with their distance; reach is a number or a column of the sensors.

    The plane is cut into cells (of the reach, or CELL, unless given); a sensor goes to those that
    its reach touches and objects to their own, so that the join is on equal keys and cells, never
    on keys alone. Sensors and objects without a place have no pairs."""
    bound = F.col(reach) if isinstance(reach, str) else F.lit(float(reach))
    side = cell or (CELL if isinstance(reach, str) else float(reach))
    at = lambda c: F.floor(c / side).cast("int")
    touched = lambda c: F.explode(F.sequence(at(F.col(c) - bound - 1e-6), at(F.col(c) + bound + 1e-6)))
    near = sensors.withColumn("_cell_x", touched("x")).withColumn("_cell_y", touched("y"))
    # A few bytes of input make many pairs, so rows are dealt as the join wants them even where the objects are broadcast, not as files were cut.
    near = near.repartition(*keys, "_cell_x", "_cell_y")
    placed = objects.withColumns({"_cell_x": at(F.col("cx")), "_cell_y": at(F.col("cy"))})
    pairs = near.join(placed, [*keys, "_cell_x", "_cell_y"]).drop("_cell_x", "_cell_y")
    dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    return pairs.withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= bound)


def visible(sensors: DataFrame, objects: DataFrame, half_angle: bool = True) -> DataFrame:
    """Pairs that a sensor sees: within its own range (max_range) and field of view, not itself. The field counts to either side unless half_angle is false."""
    pairs = within_range(sensors, objects, "max_range").where((F.col("object_id") != F.col("platform_id")) & (F.col("distance") > 0.001))
    _, bearing = K.polar(F.col("cx"), F.col("cy"), F.col("x"), F.col("y"), F.col("yaw"))
    field = F.col("fov") if half_angle else F.col("fov") / 2
    return pairs.withColumn("bearing", bearing).where(F.abs(K.wrapped(F.col("center") - F.col("bearing"))) <= field)


def budget(rows: DataFrame, detectors: DataFrame) -> DataFrame:
    """Adds the detector's errors and detection probability at the distance."""
    curves = ("radial", "distance", "bbox", "prob")
    rows = rows.join(F.broadcast(detectors.withColumnsRenamed({c: f"_{c}" for c in curves})), "detector_type")  # a row for each detector
    names = ("radial_error", "distance_error", "bbox_error", "probability")
    return rows.withColumns({n: K.polynomial(F.col(f"_{c}"), F.col("distance")) for n, c in zip(names, curves, strict=True)}).drop(*(f"_{c}" for c in curves))


def expected_covariance(distance_error: Column, radial_error: Column, bearing: Column) -> tuple[Column, Column, Column]:
    return G.turned_covariance(distance_error * distance_error, radial_error * radial_error, bearing)
