"""Axon pathways: lines through centroids, their common point, and direction consensus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.functions.geometry import angle_difference, circular_mean


def fitted_lines(points: DataFrame, keys: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """``keys, n, slope, intercept, r2`` of the least-squares line per key; NULL line for fewer than ``least`` points or one x."""
    ok = (F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= least) & (F.var_pop(x) > 0)
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.when(ok, F.regr_slope(fy, fx)).alias("slope"), F.when(ok, F.regr_intercept(fy, fx)).alias("intercept"), F.when(ok, F.regr_r2(fy, fx)).alias("r2"))


def common_point(lines: DataFrame, by: list[str], slope: str, intercept: str, weight: str) -> DataFrame:
    """``by, n_lines, x, y``: the point of least weighted squared distance from all lines.

    The optimum solves a 2 x 2 system of sums over lines, so no pair of lines
    is formed; parallel lines have none (NULL).
    """
    m, c, w = F.col(slope), F.col(intercept), F.col(weight)
    q = w / (1 + m * m)
    sums = lines.where(m.isNotNull() & c.isNotNull() & (w > 0)).groupBy(*by).agg(F.count("*").alias("n_lines"), F.sum(q * m * m).alias("a"), F.sum(-q * m).alias("b"), F.sum(q).alias("d"), F.sum(-q * m * c).alias("e"), F.sum(q * c).alias("f"))
    det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
    ok = det > 1e-9 * F.col("a") * F.col("d")
    return sums.select(*by, "n_lines", F.when(ok, (F.col("d") * F.col("e") - F.col("b") * F.col("f")) / det).alias("x"), F.when(ok, (F.col("a") * F.col("f") - F.col("b") * F.col("e")) / det).alias("y"))


def consensus_direction(df: DataFrame, by: list[str], angle: str, r2: str, least: float = 0.8, tolerance: float = 45.0) -> DataFrame:
    """Rows with ``consensus`` (the R2-weighted circular mean of rows with at least ``least``) and whether they lie within ``tolerance``."""
    good = df.where(F.col(r2) >= least).groupBy(*by).agg(circular_mean(F.col(angle), F.col(r2)).alias("consensus"))
    return df.join(good, by, "left").withColumn("agrees", F.coalesce(angle_difference(F.col(angle), F.col("consensus")) <= tolerance, F.lit(False)))


def centroid_direction(centroids: DataFrame, keys: list[str], time: str, x: str, y: str) -> DataFrame:
    """``keys, direction``: the linearly weighted mean of the displacements from the first centroid in time, as degrees."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(time)
    first = centroids.withColumn("_i", F.row_number().over(w)).withColumn("_x", F.first(x).over(w)).withColumn("_y", F.first(y).over(w))
    dx, dy = F.sum(F.col("_i") * (F.col(x) - F.col("_x"))), F.sum(F.col("_i") * (F.col(y) - F.col("_y")))
    return first.groupBy(*keys).agg(F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))).alias("direction"))


def pair_intersections(slopes: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """Intersections of all pairs i < j of one recording's pathways (tens of lines), parallels left out; rows ``i, j, x, y``."""
    i, j = np.triu_indices(len(slopes), 1)
    d = slopes[i] - slopes[j]
    ok = np.abs(d) > 1e-10
    x = (intercepts[j][ok] - intercepts[i][ok]) / d[ok]
    return np.stack([i[ok], j[ok], x, slopes[i][ok] * x + intercepts[i][ok]], axis=1)


def largest_dense_group(points: np.ndarray, eps: float = 15.0, least: int = 3) -> np.ndarray:
    """The mask of the largest density-connected group of one recording's intersections; none if no point is dense."""
    n = len(points)
    near = ((points[:, None] - points[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(n, -1)
    k = 0
    for s in np.flatnonzero(core):
        if label[s] >= 0:
            continue
        stack = [s]
        while stack:
            p = stack.pop()
            if label[p] >= 0:
                continue
            label[p] = k
            if core[p]:
                stack += np.flatnonzero(near[p] & (label < 0)).tolist()
        k += 1
    return label == np.bincount(label[label >= 0]).argmax() if k else np.zeros(n, bool)


def union_area(centres: np.ndarray, radius: float = 3.0, steps: int = 400) -> float:
    """The area of a union of equal circles, by exact chords on ``steps`` lines per radius."""
    if not len(centres):
        return 0.0
    h = radius / steps
    ys = np.arange(centres[:, 1].min() - radius + h / 2, centres[:, 1].max() + radius, h)
    area = 0.0
    for y in ys:
        d = radius**2 - (centres[:, 1] - y) ** 2
        half = np.sqrt(d[d > 0])
        x = centres[d > 0, 0]
        end = -np.inf
        for a, b in sorted(zip(x - half, x + half)):
            area += max(0.0, b - max(a, end)) * h
            end = max(end, b)
    return float(area)


def best_head(starts: np.ndarray, angles: np.ndarray, center: tuple[float, float] = (33.0, 33.0), radius: float = 98.0, steps: int = 60) -> tuple[float, float] | None:
    """The point of least squared distance from all rays' lines, inside a circle; None for fewer than two lines or parallel ones.

    The cost is a convex quadratic, so the free optimum is one solve, and a
    constrained one lies on the circle, where its multiplier is found by
    halving.
    """
    n = np.stack([-np.sin(np.radians(angles)), np.cos(np.radians(angles))], axis=1)
    a = n.T @ n
    if len(starts) < 2 or abs(np.linalg.det(a)) < 1e-9 * max(np.trace(a), 1e-12) ** 2:
        return None
    c = np.array(center)
    b = n.T @ ((n * starts).sum(1) - n @ c)
    at = lambda lam: np.linalg.solve(a + lam * np.eye(2), b)
    p = at(0.0)
    if np.hypot(*p) > radius:
        lo, hi = 0.0, 1.0
        while np.hypot(*at(hi)) > radius:
            hi *= 2
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.hypot(*at(mid)) > radius else (lo, mid)
        p = at(hi)
    return float(p[0] + c[0]), float(p[1] + c[1])


def refined_head(starts: np.ndarray, angles: np.ndarray, keep: float = 0.8, rounds: int = 10, move: float = 0.1, **circle) -> tuple[tuple[float, float] | None, np.ndarray]:
    """``best_head`` after dropping the worst line per round, until ``keep`` of them are left, the point rests or ``rounds`` are over; and the lines kept."""
    use = np.ones(len(starts), bool)
    at = best_head(starts, angles, **circle)
    for _ in range(rounds):
        if at is None or use.sum() - 1 < keep * len(starts):
            break
        n = np.stack([-np.sin(np.radians(angles)), np.cos(np.radians(angles))], axis=1)
        miss = np.where(use, np.abs(((np.array(at) - starts) * n).sum(1)), -1.0)
        trial = use.copy()
        trial[int(miss.argmax())] = False
        new = best_head(starts[trial], angles[trial], **circle)
        if new is None:
            break
        rested = np.hypot(new[0] - at[0], new[1] - at[1]) < move
        use, at = trial, new
        if rested:
            break
    return at, use


def angle_correction(dv: float, nt: float, measured: float) -> float:
    """What turns the measured angle into that of the place in the eye, 0 to 360 degrees."""
    return float((np.degrees(np.arctan2(dv, nt)) - measured) % 360)
