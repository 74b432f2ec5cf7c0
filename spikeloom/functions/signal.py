"""Signal kernels on matrices of traces (one row per trace), and their Arrow-batched column forms.

Only numpy is used. A batch of traces of one length is filtered as one matrix.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _digital(poles: np.ndarray, cutoff: float, rate: float, high: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bilinear transform of an all-pole analog prototype at ``cutoff``."""
    warped = 4.0 * math.tan(math.pi * cutoff / rate)
    n = len(poles)
    if high:
        gain = float(np.real(1.0 / np.prod(-poles)))
        p, z = warped / poles, np.zeros(n)
        zd = (4.0 + z) / (4.0 - z)
        gain = gain * float(np.real(np.prod(4.0 - z) / np.prod(4.0 - p)))
    else:
        p = poles * warped
        zd = -np.ones(n)
        gain = float(np.real(np.prod(-p) / np.prod(4.0 - p)))
    pd_ = (4.0 + p) / (4.0 - p)
    return np.real(gain * np.poly(zd)), np.real(np.poly(pd_))


def butterworth(order: int, cutoff: float, rate: float, high: bool = False) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(-order + 1, order, 2)
    return _digital(-np.exp(1j * math.pi * k / (2 * order)), cutoff, rate, high)


def bessel(order: int, cutoff: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass with the phase normalisation: roots of the reverse Bessel polynomial, scaled by its constant term."""
    coeff = [math.factorial(2 * order - k) / (2 ** (order - k) * math.factorial(k) * math.factorial(order - k)) for k in range(order + 1)]
    roots = np.roots(coeff[::-1])
    return _digital(roots * coeff[0] ** (-1.0 / order), cutoff, rate, False)


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Transposed direct form over the last axis, all rows at once."""
    y = np.empty_like(x)
    for t in range(x.shape[1]):
        v = x[:, t]
        out = b[0] * v + z[0]
        for i in range(len(z) - 1):
            z[i] = b[i + 1] * v + z[i + 1] - a[i + 1] * out
        z[-1] = b[-1] * v - a[-1] * out
        y[:, t] = out
    return y


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd padding of ``3 * max(len(a), len(b))`` and steady-state starts. Rows too short stay."""
    b, a = b / a[0], a / a[0]
    pad = 3 * max(len(a), len(b))
    if x.shape[1] <= pad:
        return x.copy()
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:]
    companion[1:, :-1] = np.eye(n - 1)
    zi = np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    ext = np.concatenate([left, x, right], axis=1)
    for _ in range(2):
        ext = _filter(b, a, ext, [k * ext[:, 0] for k in zi])[:, ::-1]
    return ext[:, pad:-pad]


def bessel_lowpass(x: np.ndarray, cutoff: float = 10.0, rate: float = 60.0, order: int = 5) -> np.ndarray:
    """Unchanged where the cutoff reaches half the rate."""
    return x.copy() if cutoff >= rate / 2 else zero_phase(*bessel(order, cutoff, rate), x)


def butter_lowpass(x: np.ndarray, cutoff: float = 10.0, rate: float = 60.0, order: int = 4) -> np.ndarray:
    return x.copy() if cutoff >= rate / 2 or x.shape[1] < 3 * order else zero_phase(*butterworth(order, cutoff, rate), x)


def butter_highpass(x: np.ndarray, cutoff: float = 100.0, rate: float = 20000.0, order: int = 2) -> np.ndarray:
    return zero_phase(*butterworth(order, cutoff, rate, high=True), x)


def find_peaks(x: np.ndarray, height: float | None = None, distance: int = 0, prominence: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Local maxima (the middle of a plateau) and their prominences.

    Peaks lower than ``height`` go; of peaks closer than ``distance`` the
    higher ones stay; then those less prominent than ``prominence`` go.
    """
    peaks, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                peaks.append((i + j) // 2)
            i = j
        i += 1
    at = np.array(peaks, dtype=int)
    if height is not None:
        at = at[x[at] >= height]
    if distance > 1 and len(at):
        keep = np.ones(len(at), bool)
        for k in np.argsort(x[at], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(at - at[k]) < distance
                near[k] = False
                keep[near] = False
        at = at[keep]
    prom = np.empty(len(at))
    for k, p in enumerate(at):
        higher = np.flatnonzero(x[:p] > x[p])
        left = x[(higher[-1] if len(higher) else 0) : p + 1].min()
        higher = np.flatnonzero(x[p + 1 :] > x[p])
        right = x[p : (p + 1 + higher[0]) if len(higher) else n].min()
        prom[k] = x[p] - max(left, right)
    if prominence is not None:
        ok = prom >= prominence
        at, prom = at[ok], prom[ok]
    return at, prom


def extreme_peak(x: np.ndarray, base: float, spread: float, times: float = 2.0) -> tuple[float, float]:
    """The most prominent rise or dip against ``base``, whichever is larger (the rise on a tie), and where; 0 and NaN if none stands out by ``times * spread``."""
    best = [0.0, float("nan")]
    for sign in (1.0, -1.0):
        at, prom = find_peaks(sign * x, prominence=times * spread)
        if len(at):
            k = int(at[int(np.argmax(prom))])
            v = float(x[k] - base)
            if math.isnan(best[1]) or abs(v) > abs(best[0]):
                best = [v, float(k)]
    return best[0], best[1]


def savitzky_golay(x: np.ndarray, width: int = 7, degree: int = 3) -> np.ndarray:
    """Local polynomial smoothing; the ends take the polynomial of the first and last window."""
    h = width // 2
    grid = np.vander(np.arange(-h, h + 1), degree + 1, increasing=True)
    hat = grid @ np.linalg.pinv(grid)
    out = np.array(x, dtype=float)
    n = x.shape[-1]
    if n < width:
        return out
    win = np.lib.stride_tricks.sliding_window_view(x, width, axis=-1)
    out[..., h : n - h] = win @ hat[h]
    out[..., :h] = x[..., :width] @ hat[:h].T
    out[..., n - h :] = x[..., n - width :] @ hat[h + 1 :].T
    return out


def gaussian_smooth(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Along the last axis, the nearest value beyond the ends."""
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    k /= k.sum()
    ext = np.concatenate([np.repeat(x[..., :1], r, -1), x, np.repeat(x[..., -1:], r, -1)], axis=-1)
    return np.lib.stride_tricks.sliding_window_view(ext, len(k), axis=-1) @ k[::-1]


def kernel_smooth(x: np.ndarray, width: int, shape: str = "boxcar") -> np.ndarray:
    """Same-length convolution with a boxcar, triangular or gaussian kernel."""
    if shape == "boxcar":
        k = np.ones(width)
    elif shape == "triangular":
        k = 1 - np.abs(np.arange(width) - (width - 1) / 2) / (width / 2 if width % 2 == 0 else (width + 1) / 2)
    elif shape == "gaussian":
        k = np.exp(-0.5 * ((np.arange(width) - (width - 1) / 2) / (width / 6)) ** 2)
    else:
        raise ValueError(f"no kernel named {shape!r}")
    return np.convolve(x, k / k.sum(), mode="same")


def sine_fit(y: np.ndarray, freq: float, rate: float = 60.0, start: int = 0, amp_max: float = 400.0) -> tuple[float, float, float, float]:
    """Least squares of ``amp * sin(2 pi f t + phase) + offset``: amplitude, phase, offset and R2; amplitude 0 and no phase without a fit.

    At a fixed frequency the model is linear in a sine, a cosine and a
    constant, so the optimum needs no search.
    """
    if len(y) < 3:
        return 0.0, float("nan"), 0.0, 0.0
    t = (start + np.arange(len(y))) / rate
    g = np.stack([np.sin(2 * np.pi * freq * t), np.cos(2 * np.pi * freq * t), np.ones(len(y))], axis=1)
    c, *_ = np.linalg.lstsq(g, y, rcond=None)
    total = float(((y - y.mean()) ** 2).sum())
    r2 = 0.0 if total < 1e-10 else 1 - float(((y - g @ c) ** 2).sum()) / total
    return min(float(np.hypot(c[0], c[1])), amp_max), float(np.arctan2(c[1], c[0])), float(c[2]), r2


def onsets(signal: np.ndarray, threshold: float, min_distance: int = 0) -> np.ndarray:
    """Samples just before the steps of a signal."""
    return find_peaks(np.concatenate([[-np.inf], np.diff(signal), [-np.inf]]), height=threshold, distance=min_distance)[0] - 1


def _by_length(traces: pd.Series, kernel) -> pd.Series:
    out: list = [None] * len(traces)
    groups: dict[int, list[int]] = {}
    for i, t in enumerate(traces):
        if t is not None:
            groups.setdefault(len(t), []).append(i)
    for n, rows in groups.items():
        res = kernel(np.stack([np.asarray(traces.iloc[i], dtype=float) for i in rows])) if n else [np.zeros(0)] * len(rows)
        for i, r in zip(rows, res):
            out[i] = r
    return pd.Series(out, dtype=object)


def lowpass(trace: Column, cutoff: float = 10.0, rate: float = 60.0, order: int = 5) -> Column:
    """Zero-phase Bessel low-pass of an ``array<double>``."""

    def run(s: pd.Series) -> pd.Series:
        return _by_length(s, lambda x: bessel_lowpass(x, cutoff, rate, order))

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(trace)


def peak_positions(trace: Column, height: float | None = None, distance: int = 0, prominence: float | None = None) -> Column:
    """Positions of peaks as ``array<bigint>``."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else find_peaks(np.asarray(t, dtype=float), height, distance, prominence)[0].astype("int64") for t in s], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.LongType()))(trace)
