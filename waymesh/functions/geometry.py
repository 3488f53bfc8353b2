"""Oriented boxes, error ellipses and symmetric 2 x 2 covariances (c00, c01, c11) as column expressions; box overlap as a vectorised UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .kinematics import rotated

TRUTH_CORNERS = ((-1, -1), (1, -1), (1, 1), (-1, 1))
TRACK_CORNERS = ((-1, 1), (1, 1), (1, -1), (-1, -1))


def corners(cx: Column, cy: Column, width: Column, length: Column, angle: Column, order=TRUTH_CORNERS) -> list[tuple[Column, Column]]:
    """The four corners of a box, width along its own x axis, in the given order of signs."""
    return [rotated(cx + a * width / 2, cy + b * length / 2, cx, cy, angle) for a, b in order]


def polygon(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in points))


def turned_covariance(along: Column, across: Column, angle: Column) -> tuple[Column, Column, Column]:
    """R diag(along, across) R' with R = [[cos, sin], [-sin, cos]]."""
    c, s = F.cos(angle), F.sin(angle)
    return along * c * c + across * s * s, (across - along) * s * c, along * s * s + across * c * c


def ellipse(c00: Column, c01: Column, c11: Column, scale: float = 3.0, deviation: bool = True) -> tuple[Column, Column, Column]:
    """Half axes and direction: of scale standard deviations, or scale variances. A variance that is not a number gives zero."""
    mean, spread = (c00 + c11) / 2, F.sqrt((c00 - c11) * (c00 - c11) / 4 + c01 * c01)
    large, small = F.greatest(mean + spread, F.lit(0.0)), F.greatest(mean - spread, F.lit(0.0))
    axes = [scale * (F.sqrt(v) if deviation else v) for v in (large, small)]
    none = F.isnan(mean + spread)
    return *(F.when(none, 0.0).otherwise(a) for a in axes), F.when(none, 0.0).otherwise(F.atan2(2 * c01, c00 - c11) / 2)


def radius_at(a: Column, b: Column, phi: Column, theta: Column) -> Column:
    """Distance from the centre of an ellipse to its edge in a direction."""
    d = phi - theta
    return a * b / F.sqrt(a * a * F.sin(d) * F.sin(d) + b * b * F.cos(d) * F.cos(d) + 1e-10)


def extents(c00: Column, c01: Column, c11: Column) -> tuple[Column, Column]:
    """Reach of the variance ellipse along x and y, never negative."""
    a, b, phi = ellipse(c00, c01, c11, 1.0, deviation=False)
    return radius_at(a, b, phi, F.lit(0.0)), radius_at(a, b, phi, F.pi() / 2)


def may_overlap(dx: Column, dy: Column, width_a: Column, length_a: Column, width_b: Column, length_b: Column) -> Column:
    """Whether the circles around two boxes meet; boxes whose circles do not have nothing in common."""
    reach = (F.sqrt(width_a * width_a + length_a * length_a) + F.sqrt(width_b * width_b + length_b * length_b)) / 2
    return dx * dx + dy * dy <= reach * reach


def _box(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Corners, counter-clockwise, of n boxes: (n, 4, 2)."""
    signs = np.array([(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)])
    px, py = signs[:, 0] * w[:, None], signs[:, 1] * h[:, None]
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    return np.stack((x[:, None] + px * c - py * s, y[:, None] + px * s + py * c), axis=2)


def _following(values: np.ndarray, count: np.ndarray, row: np.ndarray) -> np.ndarray:
    """What comes after each of the first `count` of nine points, the first after the last."""
    out = np.roll(values, -1, axis=1)
    out[row, np.maximum(count, 1) - 1] = values[:, 0]
    return out


def overlap_area(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common area of n pairs of boxes, rows of (x, y, width, length, angle): each box of a is cut by the four sides of its partner."""
    n = len(a)
    if not n:
        return np.zeros(0)
    points = np.zeros((n, 9, 2))
    points[:, :4] = _box(np.zeros(n), np.zeros(n), a[:, 2], a[:, 3], a[:, 4])
    clip = _box(b[:, 0] - a[:, 0], b[:, 1] - a[:, 1], b[:, 2], b[:, 3], b[:, 4])
    count = np.full(n, 4)
    slot, row = np.arange(9), np.arange(n)
    for k in range(4):
        start, side = clip[:, k], clip[:, (k + 1) % 4] - clip[:, k]
        used = slot < count[:, None]
        height = side[:, None, 0] * (points[:, :, 1] - start[:, None, 1]) - side[:, None, 1] * (points[:, :, 0] - start[:, None, 0])
        next_height, next_point = _following(height, count, row), _following(points, count, row)
        inside, crosses = used & (height >= 0), used & ((height >= 0) != (next_height >= 0))
        r, c = np.nonzero(crosses)
        share = height[r, c] / (height[r, c] - next_height[r, c])
        both, keep = np.zeros((n, 9, 2, 2)), np.stack((inside, crosses), axis=2).reshape(n, 18)
        both[:, :, 0] = points
        both[r, c, 1] = points[r, c] + share[:, None] * (next_point[r, c] - points[r, c])
        count = keep.sum(axis=1)
        r, c = np.nonzero(keep)
        at = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        r, c, at = r[at < 9], c[at < 9], at[at < 9]
        points = np.zeros((n, 9, 2))
        points[r, at] = both.reshape(n, 18, 2)[r, c]
    used = slot < count[:, None]
    follow = _following(points, count, row)
    cross = points[:, :, 0] * follow[:, :, 1] - points[:, :, 1] * follow[:, :, 0]
    return np.maximum(np.where(used, cross, 0).sum(axis=1) / 2, 0)


def iou_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    common = overlap_area(a, b)
    union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def least_overlap(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the overlap of n pairs of boxes can exceed the least: what they have in common is inside the one, and inside the other's bounds along its axes. Boxes that are left out do not reach it."""
    areas = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3]
    needed = areas * least / (1 + least) * (1 - 1e-9)
    turn = b[:, 4] - a[:, 4]
    c, s = np.abs(np.cos(turn)), np.abs(np.sin(turn))
    dx, dy = b[:, 0] - a[:, 0], b[:, 1] - a[:, 1]
    can = np.ones(len(a), bool)
    for one, two in ((a, b), (b, a)):
        u, v = np.cos(one[:, 4]), np.sin(one[:, 4])
        along, across = np.abs(dx * u + dy * v), np.abs(dy * u - dx * v)
        w, h = (two[:, 2] * c + two[:, 3] * s) / 2, (two[:, 2] * s + two[:, 3] * c) / 2
        p, q = one[:, 2] / 2, one[:, 3] / 2
        p, q = np.minimum(p, along + w) - np.maximum(-p, along - w), np.minimum(q, across + h) - np.maximum(-q, across - h)
        can &= ~(np.maximum(p, 0) * np.maximum(q, 0) <= needed)
    return can


def iou(*box_columns: Column) -> Column:
    """Intersection over union of two boxes, each as x, y, width, length and angle; zero where the union is."""

    @F.pandas_udf(T.DoubleType())
    def of_pairs(ax: pd.Series, ay: pd.Series, aw: pd.Series, al: pd.Series, aa: pd.Series, bx: pd.Series, by: pd.Series, bw: pd.Series, bl: pd.Series, ba: pd.Series) -> pd.Series:
        columns = [s.to_numpy(dtype=float) for s in (ax, ay, aw, al, aa, bx, by, bw, bl, ba)]
        return pd.Series(iou_of(np.stack(columns[:5], axis=1), np.stack(columns[5:], axis=1)))

    return of_pairs(*box_columns)


def iou_distance(overlap: Column) -> Column:
    return F.when(overlap <= 0, 1.0).otherwise(1 - overlap)


def gated_distance(ax: Column, ay: Column, a_angle: Column, bx: Column, by: Column, width: Column, length: Column) -> Column:
    """A hundredth of the distance where a lies inside b's box, else one. The box turns by a's angle, which is read as degrees."""
    turn = F.radians(a_angle)
    dx, dy = ax - bx, ay - by
    u, v = dx * F.cos(turn) + dy * F.sin(turn), -dx * F.sin(turn) + dy * F.cos(turn)
    inside = (F.abs(u) < width / 2) & (F.abs(v) < length / 2)
    return F.when(inside, F.sqrt(dx * dx + dy * dy) / 100).otherwise(1.0)


def gated_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """gated_distance of n pairs of boxes, rows of (x, y, width, length, angle)."""
    turn = np.radians(a[:, 4])
    dx, dy = a[:, 0] - b[:, 0], a[:, 1] - b[:, 1]
    u, v = dx * np.cos(turn) + dy * np.sin(turn), -dx * np.sin(turn) + dy * np.cos(turn)
    inside = (np.abs(u) < b[:, 2] / 2) & (np.abs(v) < b[:, 3] / 2)
    return np.where(inside, np.sqrt(dx * dx + dy * dy) / 100, 1.0)
