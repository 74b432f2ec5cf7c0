"""Scalar functions: circular statistics, ratios, lines and polar coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def degrees_0_360(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def angle_difference(a: Column, b: Column) -> Column:
    """The smaller arc between two angles in degrees."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def circular_mean(angle: Column, weight: Column) -> Column:
    """An aggregate: the weighted circular mean in degrees, 0 to 360; NULL where all weights cancel out."""
    s, c = F.sum(weight * F.sin(F.radians(angle))), F.sum(weight * F.cos(F.radians(angle)))
    return F.when((F.abs(s) > 1e-12) | (F.abs(c) > 1e-12), degrees_0_360(F.degrees(F.atan2(s, c))))


def tanh_ratio(a: Column, b: Column) -> Column:
    """``tanh(a / b)``; without a denominator the sign of ``a``."""
    return F.when(b == 0, F.signum(a)).otherwise(F.tanh(a / b))


def contrast(a: Column, b: Column) -> Column:
    """``(a - b) / (a + b)``; 0 where the sum is 0."""
    return F.when(a + b == 0, 0.0).otherwise((a - b) / (a + b))


def corrected_angle(raw: Column, correction: Column) -> Column:
    """Rounded half-even to the next eighth of a turn, as three digits."""
    return F.lpad((F.pmod(F.bround((raw + correction) / 45.0) * 45.0, F.lit(360.0))).cast("int").cast("string"), 3, "0")


def vector_sum(rates: list[Column], harmonic: int) -> tuple[Column, Column]:
    """Components of the sum of eight rates at 45 degree steps, at a multiple of the angle."""
    n = len(rates)
    x = sum((r * math.cos(harmonic * 2 * math.pi * i / n) for i, r in enumerate(rates)), F.lit(0.0))
    y = sum((r * math.sin(harmonic * 2 * math.pi * i / n) for i, r in enumerate(rates)), F.lit(0.0))
    return x, y


def direction_index(rates: list[Column]) -> tuple[Column, Column]:
    """Length of the vector sum over the greatest rate (so up to 2.5), and its angle in degrees; 0 and NULL without a response."""
    x, y = vector_sum(rates, 1)
    top = F.greatest(*rates)
    return F.when(top > 0, F.sqrt(x * x + y * y) / top).otherwise(0.0), F.when(top > 0, degrees_0_360(F.degrees(F.atan2(y, x))))


def orientation_index(rates: list[Column]) -> Column:
    """Length of the vector sum at the doubled angle over the sum of rates."""
    x, y = vector_sum(rates, 2)
    s = sum(rates[1:], rates[0])
    return F.when(s > 0, F.sqrt(x * x + y * y) / s).otherwise(0.0)


def quadrant(dx: Column, dy: Column) -> Column:
    return F.when((dx >= 0) & (dy >= 0), "Q1").when((dx < 0) & (dy >= 0), "Q2").when((dx < 0) & (dy < 0), "Q3").when((dx >= 0) & (dy < 0), "Q4")


def retinal_quadrant(dv: Column, nt: Column) -> Column:
    return F.concat(F.when(dv >= 0, "dorsal").otherwise("ventral"), F.lit("-"), F.when(nt >= 0, "nasal").otherwise("temporal"))


def polar(dx: Column, dy: Column) -> tuple[Column, Column]:
    return F.sqrt(dx * dx + dy * dy), degrees_0_360(F.degrees(F.atan2(dy, dx)))


def line_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from the line through two others; from the first one where they are equal."""
    dx, dy = x1 - x0, y1 - y0
    size = F.sqrt(dx * dx + dy * dy)
    return F.when(size > 0, F.abs(dy * (px - x0) - dx * (py - y0)) / size).otherwise(F.sqrt((px - x0) * (px - x0) + (py - y0) * (py - y0)))


def points_toward(x: Column, y: Column, angle: Column, tx: Column, ty: Column) -> Column:
    """True where the ray from (x, y) at ``angle`` degrees makes at most a right angle with the way to the target."""
    return (F.cos(F.radians(angle)) * (tx - x) + F.sin(F.radians(angle)) * (ty - y)) >= 0


def coarse_to_fine(x: Column, factor: int = 20, offset: float = 0.0, size: int = 300) -> Column:
    """Truncated, scaled coordinate, clipped to the fine grid."""
    v = x * factor + offset
    cut = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    return F.least(F.greatest(cut, F.lit(0)), F.lit(size - 1)).cast("long")


def ellipse_area(sx: Column, sy: Column, scale: float = 15.0) -> Column:
    return F.lit(math.pi) * (sx / scale) * (sy / scale)
