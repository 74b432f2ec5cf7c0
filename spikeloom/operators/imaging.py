"""Kernels on a unit's cube (time, row, column) and their column form: receptive field, soma, axon.

A cube travels as ``array<double>`` with its shape, one row per unit, so each
kernel is an Arrow-batched function of a row and no unit is gathered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.functions.signal import butter_highpass, find_peaks, gaussian_smooth, savitzky_golay


def components_2d(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 4-connected parts of a mask, 0 outside: the smallest index spreads to neighbours and jumps along itself."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        padded = np.pad(np.where(mask, label, big), 1, constant_values=big)
        near = np.minimum.reduce([padded[1:-1, 1:-1], padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])
        new = np.where(mask, near, 0)
        new = np.where(mask, new.ravel()[np.maximum(new - 1, 0)], 0)
        if np.array_equal(new, label):
            return np.unique(label, return_inverse=True)[1].reshape(h, w) if not mask.all() else np.ones_like(label)
        label = new


def without_specks(mask: np.ndarray, least: int = 3) -> np.ndarray:
    """The mask without parts of fewer than ``least`` pixels."""
    label = components_2d(mask)
    size = np.bincount(label.ravel())
    return mask & (size[label] >= least)


def clean_cube(cube: np.ndarray, threshold: float = 0.1, least: int = 3, support: int = 2) -> np.ndarray:
    """Values above ``threshold`` in parts of ``least`` pixels or more, that appear in ``support`` frames or more; else 0."""
    mask = np.stack([without_specks(f > threshold, least) for f in cube])
    return np.where(mask & (mask.sum(0) >= support), cube, 0.0)


def prepared_sta(cube: np.ndarray, baseline: int = 5, pad: int = 2, blur: float = 1.0, smooth: float = 1.0) -> np.ndarray:
    """Minus the mean of the first frames, padded, blurred in space, smoothed in time."""
    out = cube - np.nanmean(cube[:baseline], axis=0)
    if pad:
        out = np.pad(out, ((0, 0), (pad, pad), (pad, pad)))
    if blur:
        out = gaussian_smooth(np.moveaxis(gaussian_smooth(out, blur), 1, 2), blur)
        out = np.moveaxis(out, 1, 2)
    return np.moveaxis(gaussian_smooth(np.moveaxis(out, 0, -1), smooth), -1, 0) if smooth else out


def extreme_map(cube: np.ndarray) -> np.ndarray:
    """The signed value of greatest magnitude per pixel."""
    at = np.abs(cube).argmax(0)
    return np.take_along_axis(cube, at[None], 0)[0]


def swing_center(cube: np.ndarray) -> tuple[int, int]:
    """The pixel whose smoothed course swings most between peak and trough; the first of equals."""
    s = savitzky_golay(np.moveaxis(cube, 0, -1))
    swing = s.max(-1) - s.min(-1)
    return tuple(int(i) for i in np.unravel_index(int(swing.argmax()), swing.shape))


def field_size(cube: np.ndarray, frames: tuple[int, int] = (40, 60), share: float = 0.5) -> dict[str, float]:
    """The part of the peak-minus-trough map above ``share`` of its maximum that holds the centre: area, box and equivalent diameter."""
    part = cube[frames[0] : frames[1]] if cube.shape[0] > frames[0] else cube
    img = part.max(0) - part.min(0)
    r, c = np.unravel_index(int(img.argmax()), img.shape)
    label = components_2d(img >= share * img.max()) if img.max() > 0 else np.zeros(img.shape, int)
    own = label == label[r, c] if label[r, c] else np.zeros(img.shape, bool)
    rows, cols = np.flatnonzero(own.any(1)), np.flatnonzero(own.any(0))
    area = float(own.sum())
    return {
        "center_row": float(r), "center_col": float(c), "area": area, "height": float(np.ptp(rows) + 1) if area else 0.0,
        "width": float(np.ptp(cols) + 1) if area else 0.0, "diameter": 2 * float(np.sqrt(area / np.pi)),
    }


def signal_quality(cube: np.ndarray, center: tuple[int, int], least: float = 3.0, near: float = 0.3) -> tuple[float, bool]:
    """The 10-90 percentile range at the centre over that of the background, which leaves out the nearest ``near`` of the pixels."""
    span = np.percentile(cube, 90, axis=0) - np.percentile(cube, 10, axis=0)
    yy, xx = np.mgrid[: cube.shape[1], : cube.shape[2]]
    gap = (yy - center[0]) ** 2 + (xx - center[1]) ** 2
    far = gap.ravel().argsort(kind="stable")[int(near * gap.size) :]
    back = np.percentile(cube.reshape(len(cube), -1)[:, far], 90) - np.percentile(cube.reshape(len(cube), -1)[:, far], 10)
    ratio = float(span[center] / back) if back > 0 else 0.0
    return ratio, ratio >= least


def soma_of(cube: np.ndarray, times: float = 3.0) -> tuple[int, int]:
    """The mean place of electrodes whose deviation in time exceeds ``times`` that of the whole, else the strongest one."""
    dev = cube.std(0)
    hit = np.argwhere(dev > times * cube.std())
    return tuple(int(round(x)) for x in hit.mean(0)) if len(hit) else tuple(int(i) for i in np.unravel_index(int(dev.argmax()), dev.shape))


def refined_soma(cube: np.ndarray, at: tuple[int, int], reach: int = 5) -> tuple[int, int, int]:
    """Frame, row and column of the lowest value within ``reach`` pixels, over all frames."""
    r0, c0 = max(0, at[0] - reach), max(0, at[1] - reach)
    part = cube[:, r0 : at[0] + reach + 1, c0 : at[1] + reach + 1]
    t, r, c = np.unravel_index(int(part.argmin()), part.shape)
    return int(t), int(r) + r0, int(c) + c0


def initial_segment(cube: np.ndarray, soma: tuple[int, int, int], reach: int = 5, frames: int = 5, share: float = 0.3) -> tuple[int, int, int] | None:
    """Of pixels near the soma whose minimum is below ``share`` of its minimum, the one whose minimum comes first; None without any."""
    t, r, c = soma
    low = share * cube[t, r, c]
    best = None
    t0, r0, c0 = max(0, t - frames), max(0, r - reach), max(0, c - reach)
    part = cube[t0 : t + frames + 1, r0 : r + reach + 1, c0 : c + reach + 1]
    first, least = part.argmin(0), part.min(0)
    for i, j in np.argwhere(least < low):
        if (i + r0, j + c0) != (r, c) and (best is None or first[i, j] + t0 < best[0]):
            best = (int(first[i, j]) + t0, int(i) + r0, int(j) + c0)
    return best


def lanes_filled(cube: np.ndarray, lanes: list[int]) -> np.ndarray:
    """Bad columns set to the mean of the whole."""
    out = np.array(cube, dtype=float)
    out[:, :, [x for x in lanes if 0 <= x < cube.shape[2]]] = cube.mean()
    return out


def small_cubes(cube: np.ndarray, edge: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All inner cubes of ``edge`` and the places of their middles; empty where the cube is too small."""
    if min(cube.shape) < edge:
        return np.zeros((0, edge, edge, edge)), np.zeros((0, 3), int)
    win = np.lib.stride_tricks.sliding_window_view(cube, (edge,) * 3)
    at = np.stack(np.meshgrid(*[np.arange(n) for n in win.shape[:3]], indexing="ij"), -1).reshape(-1, 3) + edge // 2
    return win.reshape(-1, edge, edge, edge), at


def responsive(cube: np.ndarray, times: float = 3.0) -> np.ndarray:
    """Places whose deviation exceeds ``times`` the global one, row by row."""
    return np.argwhere(cube.std(0) > times * cube.std())


def highpassed(cube: np.ndarray, cutoff: float = 100.0, rate: float = 20000.0) -> np.ndarray:
    """Every electrode's course without slow drift."""
    flat = cube.reshape(len(cube), -1).T.astype(float)
    return butter_highpass(flat, cutoff, rate).T.reshape(cube.shape)


def centroid_path(points: np.ndarray, max_jump: float) -> np.ndarray:
    """The mask of centroids accepted in order: each within ``max_jump`` of the last accepted one."""
    keep, last = np.zeros(len(points), bool), None
    for i, p in enumerate(points):
        if last is None or np.hypot(*(p - last)) <= max_jump:
            keep[i], last = True, p
    return keep


def onset_candidates(segment: np.ndarray, share: float = 0.3) -> np.ndarray:
    """Peaks as prominent as ``share`` of the maximum; without any, the greatest value."""
    top = float(segment.max()) if len(segment) else 0.0
    at = find_peaks(segment, prominence=share * top)[0] if top > 0 else np.zeros(0, int)
    return at if len(at) else np.array([int(segment.argmax())] if len(segment) else [], int)


def first_off(segment: np.ndarray, on: int, on_value: float) -> int:
    """After ``on``, the first difference at or below ``min(-|on| / 2, -50)``, else the lowest value."""
    d = np.diff(segment[on:])
    hit = np.flatnonzero(d <= min(-0.5 * abs(on_value), -50.0))
    return on + int(hit[0]) + 1 if len(hit) else on + int(segment[on:].argmin())


def area_mean(cube: np.ndarray, row: int, col: int, side: int) -> np.ndarray:
    """The mean course of a square whose middle is moved inside the image."""
    h = side // 2
    r, c = min(max(row, h), cube.shape[1] - h - 1), min(max(col, h), cube.shape[2] - h - 1)
    return cube[:, r - h : r + h + 1, c - h : c + h + 1].mean((1, 2))


def cube_udf(kernel: Callable[[np.ndarray], dict[str, float] | None], fields: list[str]) -> Callable[[Column, Column], Column]:
    """A column function of ``(data, shape)``: a struct of doubles, NULL fields where the kernel gives none or the cube is missing or broken."""
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in fields])

    def run(data: pd.Series, shape: pd.Series) -> pd.DataFrame:
        rows = []
        for d, s in zip(data, shape):
            got = None
            if d is not None and s is not None and len(s) == 3 and len(d) == int(np.prod(s)) and len(d):
                x = np.asarray(d, dtype=float).reshape([int(i) for i in s])
                got = kernel(x) if np.isfinite(x).all() else None
            rows.append([np.nan] * len(fields) if got is None else [got[f] for f in fields])
        return pd.DataFrame(rows, columns=fields, dtype="float64")

    return lambda data, shape: F.pandas_udf(run, schema)(data, shape)
