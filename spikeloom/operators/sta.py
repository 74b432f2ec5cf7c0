"""Spike-triggered averages, receptive fields and the linear-nonlinear model.

Averages are sums and counts per (unit, offset), so they combine before the
shuffle and across chunks: a partial result of one chunk of the recording is a
row that adds to the others, and no window is lost at a chunk's edge.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spike_triggered_average(spikes: DataFrame, frames: DataFrame, unit: str, frame: str, index: str, pixel: str | None, value: str, first: int, last: int, n_frames: int) -> DataFrame:
    """``unit, offset, [pixel], average, n_spikes``: the mean of the frames from ``first`` to ``last`` around each spike.

    A spike whose window leaves the ``n_frames`` frames is excluded; a unit
    without a spike left doesn't come out. Spikes are counted per frame first,
    so repeated spikes of a frame cost one join row.
    """
    inside = spikes.where((F.col(frame) + first >= 0) & (F.col(frame) + last < n_frames))
    counts = inside.groupBy(unit, frame).agg(F.count("*").alias("_n"))
    at = counts.withColumn("offset", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("_f", F.col(frame) + F.col("offset"))
    stim = frames.select(F.col(index).alias("_f"), *([pixel] if pixel else []), F.col(value).alias("_v"))
    by = [unit, "offset"] + ([pixel] if pixel else [])
    part = at.join(stim, "_f").groupBy(*by).agg(F.sum(F.col("_n") * F.col("_v")).alias("_s"), F.sum("_n").alias("n_spikes"))
    return part.select(*by, (F.col("_s") / F.col("n_spikes")).alias("average"), "n_spikes")


def excluded_spikes(spikes: DataFrame, unit: str, frame: str, first: int, last: int, n_frames: int) -> DataFrame:
    ok = (F.col(frame) + first >= 0) & (F.col(frame) + last < n_frames)
    return spikes.groupBy(unit).agg(F.count_if(ok).alias("n_used"), F.count_if(~ok).alias("n_excluded"))


def add_partials(parts: DataFrame, by: list[str]) -> DataFrame:
    """Merges partial sums of chunks: ``total`` and ``n`` add, ``average`` is their quotient (NULL where nothing counted)."""
    return parts.groupBy(*by).agg(F.sum("total").alias("total"), F.sum("n").alias("n")).withColumn("average", F.when(F.col("n") > 0, F.col("total") / F.col("n")))


def _least_squares(model, start: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, steps: int = 80) -> tuple[np.ndarray, float]:
    """Damped least squares with parameters clipped to their bounds; the parameters and R2."""
    p, lam = np.clip(start, low, high), 1e-2
    err = ((model(p) - target) ** 2).sum()
    for _ in range(steps):
        r = target - model(p)
        jac = np.stack([(model(p + d) - model(p - d)) / 2e-4 for d in np.eye(len(p)) * 1e-4], axis=1)
        hess = jac.T @ jac
        step = np.linalg.lstsq(hess + lam * np.diag(np.diag(hess) + 1e-9), jac.T @ r, rcond=None)[0]
        q = np.clip(p + step, low, high)
        new = ((model(q) - target) ** 2).sum()
        if new < err:
            done = err - new < 1e-12 * (1 + err)
            p, err, lam = q, new, lam / 3
            if done:
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    total = ((target - target.mean()) ** 2).sum()
    return p, float(1 - err / total) if total > 0 else 0.0


def gaussian_rf(cube: np.ndarray) -> dict[str, float] | None:
    """A rotated Gaussian fitted to the map of peak minus trough over time; None without contrast."""
    img = cube.max(0) - cube.min(0)
    h, w = img.shape
    if not np.isfinite(img).all() or np.ptp(img) <= 0:
        return None
    yy, xx = np.mgrid[:h, :w]
    y0, x0 = np.unravel_index(int(img.argmax()), img.shape)
    base = float(np.median(img))

    def model(q: np.ndarray) -> np.ndarray:
        a, cx, cy, sx, sy, th, off = q
        u, v = (xx - cx) * np.cos(th) + (yy - cy) * np.sin(th), -(xx - cx) * np.sin(th) + (yy - cy) * np.cos(th)
        return (a * np.exp(-0.5 * ((u / sx) ** 2 + (v / sy) ** 2)) + off).ravel()

    big = 10 * float(np.abs(img).max()) + 1
    start = np.array([img.max() - base, x0, y0, max(1.0, w / 8), max(1.0, h / 8), 0.0, base])
    p, r2 = _least_squares(model, start, np.array([-big, -w, -h, 0.3, 0.3, -np.pi, -big]), np.array([big, 2 * w, 2 * h, max(h, w), max(h, w), np.pi, big]), img.ravel())
    return dict(zip(("amplitude", "center_x", "center_y", "sigma_x", "sigma_y", "theta", "offset"), map(float, p))) | {"r_squared": r2}


def center_surround(diff: np.ndarray, around: tuple[int, int]) -> dict[str, float] | None:
    """A narrow Gaussian minus a wide one, both around a place near ``around`` (row, column).

    Amplitudes are at least 0, the widths 0.3 to 7.5 and 0.5 to 7.5, the
    centre within five pixels. None without contrast.
    """
    if not np.isfinite(diff).all() or np.ptp(diff) <= 0:
        return None
    yy, xx = np.mgrid[: diff.shape[0], : diff.shape[1]]

    def model(q: np.ndarray) -> np.ndarray:
        a, sa, b, sb, cx, cy, off = q
        d2 = (xx - cx) ** 2 + (yy - cy) ** 2
        return (a * np.exp(-0.5 * d2 / sa**2) - b * np.exp(-0.5 * d2 / sb**2) + off).ravel()

    top = float(np.abs(diff).max())
    r, c = around
    p, r2 = _least_squares(model, np.array([top, 1.5, top / 4, 3.0, c, r, 0.0]), np.array([0, 0.3, 0, 0.5, c - 5, r - 5, -top]), np.array([20 * top, 7.5, 20 * top, 7.5, c + 5, r + 5, top]), diff.ravel().astype(float))
    return dict(zip(("amp_center", "sigma_center", "amp_surround", "sigma_surround", "center_x", "center_y", "offset"), map(float, p))) | {"r_squared": r2}


def on_off_fields(diff: np.ndarray, around: tuple[int, int]) -> dict[str, dict[str, float] | None]:
    """``center_surround`` of the positive and of the negated negative part; None for a part that isn't there."""
    parts = {"on": np.maximum(diff, 0), "off": np.maximum(-diff, 0)}
    return {k: center_surround(v, around) if v.max() > 0 else None for k, v in parts.items()}


def generator_signal(stimulus: np.ndarray, sta: np.ndarray) -> np.ndarray:
    """The sliding product of the stimulus with the centred average: one value per frame from the first full window on."""
    k = len(sta)
    flat, f = stimulus.reshape(len(stimulus), -1).astype(float), sta.reshape(k, -1) - sta.mean()
    return sum(flat[i : len(flat) - k + 1 + i] @ f[i] for i in range(k))


def nonlinearity(g: np.ndarray, spikes: np.ndarray, bins: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Mean spikes per bin of the generator signal, with one percent of margin; NaN in empty bins."""
    lo, hi = g.min(), g.max()
    pad = 0.01 * (hi - lo or 1.0)
    edges = np.linspace(lo - pad, hi + pad, bins + 1)
    n, s = np.histogram(g, edges)[0], np.histogram(g, edges, weights=spikes)[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        return (edges[:-1] + edges[1:]) / 2, np.where(n > 0, s / n, np.nan)


def bits_per_spike(g: np.ndarray, spikes: np.ndarray, a: float, b: float) -> float:
    """What the fitted rate tells over the mean rate, in bits per spike; 0 without spikes."""
    n = float(spikes.sum())
    if n == 0:
        return 0.0
    rate, mean = np.exp(np.clip(a + b * g, -30, 30)), float(spikes.mean())
    return float(((spikes * np.log(rate / mean)).sum() - (rate - mean).sum()) / n / np.log(2))


def poisson_exponential(g: np.ndarray, spikes: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Maximum likelihood of ``rate = exp(a + b g)``, by Newton steps."""
    a, b = float(np.log(max(spikes.mean(), 1e-9))), 0.0
    for _ in range(steps):
        rate = np.exp(np.clip(a + b * g, -30, 30))
        grad = np.array([(spikes - rate).sum(), ((spikes - rate) * g).sum()])
        hess = np.array([[rate.sum(), (rate * g).sum()], [(rate * g).sum(), (rate * g * g).sum()]]) + 1e-9 * np.eye(2)
        d = np.linalg.solve(hess, grad)
        a, b = a + float(d[0]), b + float(d[1])
        if np.abs(d).max() < 1e-10:
            break
    return a, b
