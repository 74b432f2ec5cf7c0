"""Response features of a cell's mean traces, as one Arrow-batched struct per stimulus; and counted features in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.functions.geometry import contrast
from spikeloom.functions.signal import extreme_peak, sine_fit

# Windows in samples at 60 Hz.
STEP = {"base": (0, 60), "on": (60, 120), "on_sustained": (239, 299), "off": (360, 420), "off_sustained": (539, 599)}
COLOUR = {"base": (0, 60), "green_on": (60, 120), "green_off": (240, 300), "blue_on": (420, 480), "blue_off": (600, 660)}
FREQUENCIES = (0.5, 1.0, 2.0, 4.0, 10.0)
FREQ_FIRST, FREQ_LENGTH, FREQ_GAP, FREQ_SKIP, FREQ_R2 = 30, 240, 60, 60, 0.1
MAX_RATE = 400.0

STEP_NAMES = ("on_peak_extreme", "on_sustained", "off_peak_extreme", "off_sustained", "base_mean", "base_std", "time_to_on_peak_extreme", "time_to_off_peak_extreme", "on_off_ratio", "on_trans_sus_ratio", "off_trans_sus_ratio", "on_off_sus_ratio")
COLOUR_NAMES = ("green_on_peak_extreme", "blue_on_peak_extreme", "green_off_peak_extreme", "blue_off_peak_extreme", "gb_base_mean", "gb_base_std", "time_to_green_on_peak", "time_to_blue_on_peak", "time_to_green_off_peak", "time_to_blue_off_peak", "green_blue_on_ratio", "green_blue_off_ratio")
FREQ_NAMES = tuple(f"freq_step_{str(f if f % 1 else int(f)).replace('.', '')}hz_{n}" for f in FREQUENCIES for n in ("amp", "phase", "r_squared", "offset", "std"))


def _ratio(a: float, b: float) -> float:
    return float(np.sign(a)) if b == 0 else float(np.tanh(a / b))


def step_features(x: np.ndarray) -> list[float]:
    base = x[slice(*STEP["base"])]
    m, s = float(base.mean()), float(base.std())
    on, t_on = extreme_peak(x[slice(*STEP["on"])], m, s)
    off, t_off = extreme_peak(x[slice(*STEP["off"])], m, s)
    on_s, off_s = float(x[slice(*STEP["on_sustained"])].mean()) - m, float(x[slice(*STEP["off_sustained"])].mean()) - m
    return [on, on_s, off, off_s, m, s, t_on, t_off, _ratio(on, off), _ratio(on, on_s), _ratio(off, off_s), _ratio(on_s, off_s)]


def colour_features(x: np.ndarray) -> list[float]:
    base = x[slice(*COLOUR["base"])]
    m, s = float(base.mean()), float(base.std())
    got = {k: extreme_peak(x[slice(*COLOUR[k])], m, s) for k in ("green_on", "blue_on", "green_off", "blue_off")}
    v = {k: g[0] for k, g in got.items()}
    return [v["green_on"], v["blue_on"], v["green_off"], v["blue_off"], m, s, *[got[k][1] for k in ("green_on", "blue_on", "green_off", "blue_off")], _ratio(v["green_on"], v["blue_on"]), _ratio(v["green_off"], v["blue_off"])]


def frequency_features(x: np.ndarray) -> list[float]:
    out: list[float] = []
    for i, f in enumerate(FREQUENCIES):
        a = FREQ_FIRST + i * (FREQ_LENGTH + FREQ_GAP)
        seg = x[a : a + FREQ_LENGTH]
        amp, phase, offset, r2 = sine_fit(seg[FREQ_SKIP:], f, start=FREQ_SKIP, amp_max=MAX_RATE)
        if r2 < FREQ_R2:
            amp, phase = 0.0, float("nan")
        out += [amp, phase, r2, offset, float(seg.std())]
    return out


def _struct_udf(kernel, names: tuple[str, ...], least: int):
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            x = None if t is None or len(t) < least else np.asarray(t, dtype=float)
            if x is None or not np.isfinite(x).all() or np.abs(x).max() > MAX_RATE:
                rows.append([np.nan] * len(names))
            else:
                rows.append(kernel(x))
        return pd.DataFrame(rows, columns=list(names), dtype="float64")

    return lambda trace: F.pandas_udf(run, schema)(trace)


def step_feature_struct(mean_trace: Column) -> Column:
    """Twelve features of the step response; NULL fields for a trace that is NULL, shorter than 599, not finite or beyond 400 Hz."""
    return _struct_udf(step_features, STEP_NAMES, 599)(mean_trace)


def colour_feature_struct(mean_trace: Column) -> Column:
    return _struct_udf(colour_features, COLOUR_NAMES, 660)(mean_trace)


def frequency_feature_struct(mean_trace: Column) -> Column:
    return _struct_udf(frequency_features, FREQ_NAMES, 1470)(mean_trace)


def step_response_counts(events: DataFrame, keys: list[str], time: str, onset: float, offset: float, base: float) -> DataFrame:
    """Counted step features: rates in five windows around onset and offset, flags at twice the baseline, latency and contrast.

    Windows: base before onset, on transient and sustained halves, off
    transient and sustained halves, each of half the step.
    """
    half = (offset - onset) / 2
    t = F.col(time)
    windows = {"base": (onset - base, onset), "on": (onset, onset + half), "on_late": (onset + half, offset), "off": (offset, offset + half), "off_late": (offset + half, offset + 2 * half)}
    rate = {n: F.count_if((t >= a) & (t < b)) / F.lit(float(b - a)) for n, (a, b) in windows.items()}
    first = F.min(F.when((t >= onset) & (t < offset), t)) - onset
    got = events.groupBy(*keys).agg(*[r.alias(f"{n}_rate") for n, r in rate.items()], first.alias("on_latency"))
    return got.withColumns({
        "is_on": F.col("on_rate") > 2 * F.col("base_rate"), "is_off": F.col("off_rate") > 2 * F.col("base_rate"),
        "on_off_index": contrast(F.col("on_rate"), F.col("off_rate")),
    })


def waveform_features(waveform: Column, rate: float = 20000.0) -> Column:
    """``struct<trough, peak, width_ms, amplitude>``: the trough, the first greatest value after it, and the way between them."""
    lo = F.array_position(waveform, F.array_min(waveform)).cast("int")
    after = F.slice(waveform, lo, F.size(waveform))
    hi = lo + F.array_position(after, F.array_max(after)).cast("int") - 1
    ok = F.size(waveform) > 0
    return F.when(ok, F.struct((lo - 1).cast("long").alias("trough"), (hi - 1).cast("long").alias("peak"), ((hi - lo) * 1000.0 / rate).alias("width_ms"), (F.element_at(waveform, hi) - F.element_at(waveform, lo)).cast("double").alias("amplitude")))
