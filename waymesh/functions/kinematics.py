"""Column expressions for poses and motion. Angles are radians, counter-clockwise; positions are metres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

PI = F.pi
Number = Column | float


def heading(angle_deg: Column) -> Column:
    """The course of a clockwise compass angle in degrees."""
    return F.radians(-angle_deg)


def velocity(speed: Column, course: Column) -> tuple[Column, Column]:
    return speed * F.cos(course), speed * F.sin(course)


def centroid(front_x: Column, front_y: Column, length: Column, course: Column) -> tuple[Column, Column]:
    """Half a length back from the front bumper, a quarter turn off the course."""
    turned = course + F.pi() / 2
    return front_x - length / 2 * F.cos(turned), front_y - length / 2 * F.sin(turned)


def rotated(x: Column, y: Column, cx: Column, cy: Column, angle: Column) -> tuple[Column, Column]:
    dx, dy = x - cx, y - cy
    return cx + dx * F.cos(angle) - dy * F.sin(angle), cy + dx * F.sin(angle) + dy * F.cos(angle)


def moved(x: Column, y: Column, yaw: Column, ahead: Number, left: Number) -> tuple[Column, Column]:
    """A place given ahead and to the left of a pose."""
    return x + ahead * F.cos(yaw) - left * F.sin(yaw), y + ahead * F.sin(yaw) + left * F.cos(yaw)


def wrapped(angle: Column) -> Column:
    """The same angle in [-pi, pi)."""
    return F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi()


def polar(x: Column, y: Column, px: Column, py: Column, yaw: Column) -> tuple[Column, Column]:
    """Distance and bearing of a place as seen from a pose."""
    return F.sqrt((x - px) * (x - px) + (y - py) * (y - py)), wrapped(F.atan2(y - py, x - px) - yaw)


def in_frame(dx: Column, dy: Column, yaw: Column) -> tuple[Column, Column]:
    """A vector along and across a pose's heading."""
    return dx * F.cos(yaw) + dy * F.sin(yaw), -dx * F.sin(yaw) + dy * F.cos(yaw)


def polynomial(coefficients: Column | Sequence[float], x: Column) -> Column:
    """Sum of c[k] x^k; the coefficients are given, or an array column of any length."""
    if not isinstance(coefficients, Column):
        total = F.lit(0.0)
        for c in reversed(coefficients):
            total = total * x + F.lit(float(c))
        return total
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda total, c: total * x + c)


def integer_in(name: Column) -> Column:
    """The first number in an id, null if it has none."""
    return F.nullif(F.regexp_extract(name, r"\d+", 0), F.lit("")).cast("long")


def clean(x: Column, digits: int = 6) -> Column:
    """Rounded, and zero without a sign."""
    return F.round(x, digits) + F.lit(0.0)
