"""Fixed tables: sensors, detectors, envelope categories, and the runs of an error sweep."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: Name, range in metres, field of view, centre.
SENSOR_TYPES = [("CAMERA", 100.0, math.radians(90), 0.0), ("LIDAR", 360.0, math.radians(90), 0.0), ("RADAR", 150.0, math.radians(90), 0.0), ("OS1_128", 100.0, math.radians(360), 0.0)]
#: Name, and coefficients (rising powers of distance) of radial, distance and box error and of the detection probability.
DETECTOR_TYPES = [
    ("PERFECT", [0.000001], [0.000001], [0.000001], [0.999999]),
    ("YOLO", [0.009, 0.02], [0.009, 0.02], [0.0009, 0.01], [-0.002, 0.7]),
    ("SSD", [0.2, 0.02, 0.002], [0.2, 0.02, 0.002], [0.2, 0.02, 0.002], [0.8, -0.003, 0.0]),
    ("FASTER_RCNN", [0.3, 0.03, 0.003], [0.3, 0.03, 0.003], [0.3, 0.03, 0.003], [0.7, -0.004, 0.0]),
    ("POINT_PILLARS", [0.0018, 0.02], [0.0018, 0.02], [0.0009, 0.01], [-0.002, 0.9]),
]
#: Category, response time, least deceleration.
ENVELOPES = [("Aggressive", 0.5, 4.6), ("Conservative", 1.9, 4.1), ("Naturalistic", 0.2, 3.6)]
#: The kinds of injected errors.
ERROR_TYPES = ["NONE", "SINGLE_SENSOR_EXTRINSICS", "MULTI_SENSOR_EXTRINSICS", "LOCALIZATION", "MALICIOUS_REMOVAL", "MALICIOUS_ADDITION", "MALICIOUS_CONVOY"]
POSE_ERROR = [0.01, 0.001]


def sensor_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENSOR_TYPES, "sensor_type string, max_range double, fov double, center double")


def detector_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DETECTOR_TYPES, "detector_type string, radial array<double>, distance array<double>, bbox array<double>, prob array<double>")


def envelopes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENVELOPES, "category string, rho double, decel_min double")


def sweep(spark: SparkSession, error_types: list[str], levels: list[int]) -> DataFrame:
    """One run for each kind and level of error, numbered in that order; probability is the level in percent."""
    rows = [(i, e, level, level / 100) for i, (e, level) in enumerate((e, level) for e in error_types for level in levels)]
    return spark.createDataFrame(rows, "run_id int, error_type string, error_level int, probability double")
