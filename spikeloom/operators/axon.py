"""Axon tracking: from electrode images to somata, axon paths, the optic head of each recording and polar places of all units.

A unit's chain is one Arrow call on its electrode image: soma, axon initial
segment, a prediction cube, its clean-up, the path of centroids and the line
through it. The scorer that makes the prediction is a function of the caller,
as the library has no trained network; ``amplitude_score`` is the plain one. What
needs all units of a recording is one row per unit by then.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.functions.geometry import polar, quadrant, retinal_quadrant
from spikeloom.operators import imaging, pathways

UNIT = ["dataset_id", "unit_id"]
TRACK = (
    "status string, reason string, soma_t int, soma_row int, soma_col int, ais_t int, ais_row int, ais_col int, "
    "centroids array<struct<t: int, row: double, col: double>>, n_centroids int, slope double, intercept double, r2 double, angle double, start_row double, start_col double"
)


def amplitude_score(cube: np.ndarray) -> np.ndarray:
    """The size of each value beyond five times its electrode's own noise, 0..1: a stand-in for a trained scorer."""
    z = np.abs(cube - np.median(cube, axis=0)) / (1.4826 * np.median(np.abs(cube - np.median(cube, axis=0)), axis=0) + 1e-9)
    return np.clip((z - 5.0) / 10.0, 0.0, 1.0)


def local_support(prediction: np.ndarray, frames: int = 5) -> np.ndarray:
    """Each frame as the mean of itself and those around it, edges with what there is."""
    half, sums = frames // 2, np.cumsum(np.concatenate([np.zeros((1, *prediction.shape[1:])), prediction]), axis=0)
    n = len(prediction)
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    return (sums[hi] - sums[lo]) / (hi - lo)[:, None, None]


def centroids_of(prediction: np.ndarray, soma: tuple[int, int] | None, exclude: int = 5, threshold: float = 0.05, start: int = 0) -> np.ndarray:
    """Per frame the weighted middle of what exceeds ``threshold`` away from the soma: rows of frame, row, column."""
    mask = prediction > threshold
    if soma is not None:
        rr, cc = np.mgrid[: prediction.shape[1], : prediction.shape[2]]
        mask &= np.hypot(rr - soma[0], cc - soma[1]) > exclude
    out = []
    for t in range(start, len(prediction)):
        at = np.argwhere(mask[t])
        if len(at):
            w = prediction[t][mask[t]]
            out.append([t, *(at * w[:, None]).sum(0) / w.sum()])
    return np.array(out).reshape(-1, 3)


def line_of(points: np.ndarray, least: int = 10) -> dict[str, float] | None:
    """The line through centroids, with its direction in time: columns are x, rows y; None for fewer than ``least`` or a point."""
    if len(points) < least:
        return None
    x, y = points[:, 2], points[:, 1]
    dx, dy = x - x.mean(), y - y.mean()
    if (dx**2).sum() < 1e-12:
        return None
    slope = float((dx * dy).sum() / (dx**2).sum())
    miss = dy - slope * dx
    total = float((dy**2).sum())
    half = max(1, len(points) // 3)
    way = points[-half:, 1:].mean(0) - points[:half, 1:].mean(0)
    return {"slope": slope, "intercept": float(y.mean() - slope * x.mean()), "r2": 1.0 - float((miss**2).sum()) / total if total > 0 else 1.0, "angle": float(np.degrees(np.arctan2(way[0], way[1])) % 360)}


def track(cube: np.ndarray, scorer: Callable[[np.ndarray], np.ndarray] | None = None, jump: float = 5.0, least: int = 10, **kw) -> tuple:
    """The chain of one unit, in the order of ``TRACK``. Without a scorer only the soma and the initial segment are sought."""
    place = imaging.refined_soma(cube, imaging.soma_of(cube))
    ais = imaging.initial_segment(cube, place) or (None, None, None)
    empty = (None, 0, None, None, None, None, None, None)
    if scorer is None:
        return ("minimal", None, *place, *ais, *empty)
    got = centroids_of(local_support(imaging.clean_cube(scorer(cube))), place[1:], **kw)
    path = got[imaging.centroid_path(got[:, 1:], jump)] if len(got) else got
    line = line_of(path, least)
    points = [{"t": int(t), "row": float(r), "col": float(c)} for t, r, c in path]
    if line is None:
        return ("complete", "no pathway", *place, *ais, points, len(points), *[None] * 6)
    return ("complete", None, *place, *ais, points, len(points), line["slope"], line["intercept"], line["r2"], line["angle"], float(path[0, 1]), float(path[0, 2]))


def tracks(images: DataFrame, scorer: Callable[[np.ndarray], np.ndarray] | None = amplitude_score, data: str = "average", shape: str = "shape", **kw) -> DataFrame:
    """``dataset_id, unit_id`` and ``TRACK`` for each electrode image; a missing or broken image is ``skipped``, a failing unit ``failed``."""
    names = [f.name for f in T.StructType.fromDDL(TRACK).fields]

    def run(d: pd.Series, s: pd.Series) -> pd.DataFrame:
        rows = []
        for x, sh in zip(d, s):
            if x is None or sh is None or len(sh) != 3 or len(x) != int(np.prod(sh)) or not len(x):
                rows.append(("skipped", "no image", *[None] * (len(names) - 2)))
                continue
            cube = np.asarray(x, dtype=float).reshape([int(i) for i in sh])
            if not np.isfinite(cube).all():
                rows.append(("skipped", "values that aren't finite", *[None] * (len(names) - 2)))
                continue
            try:
                rows.append(track(cube, scorer, **kw))
            except (ValueError, IndexError, np.linalg.LinAlgError) as e:  # one unit doesn't end the others
                rows.append(("failed", str(e)[:200], *[None] * (len(names) - 2)))
        out = pd.DataFrame(rows, columns=names)
        for c in names:
            if c.endswith(("_t", "_row", "_col")) and not c.startswith("start") or c == "n_centroids":
                out[c] = out[c].astype("Int32")
        return out

    call = F.pandas_udf(run, T.StructType.fromDDL(TRACK))
    return images.select(*UNIT, call(data, shape).alias("t")).select(*UNIT, "t.*")


def heads(found: DataFrame, center: tuple[float, float] = (33.0, 33.0), radius: float = 98.0, tolerance: float = 45.0, least_r2: float = 0.0) -> DataFrame:
    """The optic head of each recording: ``dataset_id, head_x, head_y, n_pathways, n_used, rms, method``.

    Pathways off the consensus direction by more than ``tolerance`` are left
    out; then the point nearest to all lines inside a circle, refined by
    dropping the worst. With fewer than two lines the circle's middle is given
    as ``center``. A recording has a row per unit, a few hundred at most.
    """

    def solve(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own = part.dropna(subset=["angle", "start_row", "start_col"])
        own = own[own["r2"] >= least_r2]
        n = len(own)
        if n:
            a = np.radians(own["angle"].to_numpy(dtype=float))
            w = np.clip(own["r2"].to_numpy(dtype=float), 1e-6, None)
            mean = np.degrees(np.arctan2((w * np.sin(a)).sum(), (w * np.cos(a)).sum()))
            off = np.abs((own["angle"].to_numpy(dtype=float) - mean + 180) % 360 - 180)
            own = own[off <= tolerance]
        starts, angles = own[["start_col", "start_row"]].to_numpy(dtype=float), own["angle"].to_numpy(dtype=float)
        at, used = pathways.refined_head(starts, angles, center=center, radius=radius) if len(own) >= 2 else (None, np.zeros(len(own), bool))
        if at is None:
            return pd.DataFrame([(keys[0], *center, n, 0, None, "center")], columns=_HEAD)
        normal = np.stack([-np.sin(np.radians(angles[used])), np.cos(np.radians(angles[used]))], axis=1)
        miss = ((np.array(at) - starts[used]) * normal).sum(1)
        return pd.DataFrame([(keys[0], *at, n, int(used.sum()), float(np.sqrt((miss**2).mean())), "lines")], columns=_HEAD)

    return found.groupBy("dataset_id").applyInPandas(solve, "dataset_id string, head_x double, head_y double, n_pathways int, n_used int, rms double, method string")


_HEAD = ["dataset_id", "head_x", "head_y", "n_pathways", "n_used", "rms", "method"]


def polar_places(found: DataFrame, head: DataFrame, eye: DataFrame | None = None) -> DataFrame:
    """Each unit's place seen from its recording's head: ``radius, angle, quadrant``; with ``eye`` (``dataset_id, dv, nt``) the angle in the eye too.

    ``eye`` tells where the array lay; what turns the measured direction of the
    array's middle into that place turns every unit's angle.
    """
    one = found.where("soma_row IS NOT NULL").join(head.select("dataset_id", "head_x", "head_y"), "dataset_id")
    dx, dy = F.col("soma_col") - F.col("head_x"), F.col("soma_row") - F.col("head_y")
    r, a = polar(dx, dy)
    out = one.select(*UNIT, r.alias("radius"), a.alias("angle"), quadrant(dx, dy).alias("quadrant"), "head_x", "head_y")
    if eye is None:
        return out.drop("head_x", "head_y")
    turned = out.join(eye.select("dataset_id", "dv", "nt"), "dataset_id", "left")
    measured = F.degrees(F.atan2(33.0 - F.col("head_y"), 33.0 - F.col("head_x")))
    turn = F.degrees(F.atan2("dv", "nt")) - measured
    corrected = F.pmod(F.col("angle") + turn, F.lit(360.0))
    return turned.select(*UNIT, "radius", "angle", "quadrant", corrected.alias("eye_angle"), retinal_quadrant(F.col("radius") * F.sin(F.radians(corrected)), F.col("radius") * F.cos(F.radians(corrected))).alias("eye_quadrant"))


def projections(images: DataFrame, data: str = "average", shape: str = "shape") -> DataFrame:
    """``dataset_id, unit_id, row, col, swing``: per pixel the greatest less the least value in time."""
    n = F.get(shape, 1) * F.get(shape, 2)
    pix = images.where(F.size(shape) == 3).select(*UNIT, shape, F.posexplode(data).alias("i", "v"))
    place = F.col("i") % n
    return pix.groupBy(*UNIT, F.floor(place / F.get(shape, 2)).cast("int").alias("row"), (place % F.get(shape, 2)).cast("int").alias("col")).agg((F.max("v") - F.min("v")).alias("swing"))


def boundary_pull(points: DataFrame, by: list[str], unit: str, x: Column, y: Column, head_x: Column, head_y: Column, center: tuple[float, float] = (33.0, 33.0)) -> DataFrame:
    """How much each pathway's centroids pull the head outward: ``by, unit, pull, strongest``.

    The pull is the sum of the positive projections of (centroid - head) onto
    the outward direction at the head; none where the head lies in the middle.
    """
    ox, oy = head_x - center[0], head_y - center[1]
    size = F.sqrt(ox * ox + oy * oy)
    dot = F.when(size > 1e-9, ((x - head_x) * ox + (y - head_y) * oy) / size).otherwise(0.0)
    pull = points.groupBy(*by, unit).agg(F.sum(F.greatest(dot, F.lit(0.0))).alias("pull"))
    top = pull.groupBy(*by).agg(F.max_by(unit, F.struct("pull", F.col(unit))).alias("_top"))
    return pull.join(top, by).select(*by, unit, "pull", (F.col(unit) == F.col("_top")).alias("strongest"))


def axon_tracking(images: DataFrame, kinds: DataFrame | None = None, eye: DataFrame | None = None, scorer: Callable[[np.ndarray], np.ndarray] = amplitude_score, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole: tracks, heads and polar places. ``kinds`` (``dataset_id, unit_id, axon_type``) restricts axons to ganglion cells; others get a soma only."""
    if kinds is None:
        found = tracks(images, scorer, **kw)
    else:
        marked = images.join(kinds.select(*UNIT, F.lower("axon_type").alias("_k")), UNIT, "left")
        is_cell = F.coalesce(F.col("_k") == "rgc", F.lit(False))
        found = tracks(marked.where(is_cell), scorer, **kw).unionByName(tracks(marked.where(~is_cell), None))
    head = heads(found)
    return found, head, polar_places(found, head, eye)
