"""Preparing response traces for classifiers: segments by name, filtered, thinned, cut, normalised and laid end to end.

A segment's rule says what is done to it; all cells of a table are treated at
once. Lengths that have to agree over cells come from one small aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.functions import arrays as A
from spikeloom.functions.signal import bessel_lowpass, butter_lowpass

TRACE = T.ArrayType(T.DoubleType())
RATE = 60.0


@dataclass(frozen=True)
class Rule:
    """What is done to a segment: samples cut at either end or kept from the start, cutoff and target rate in Hz (None: not done)."""

    edge: int = 0
    first: int | None = None
    cutoff: float | None = 10.0
    target: float | None = 10.0


# The segments with rules of their own; others take the plain rule.
RULES = {"freq_section_10hz": Rule(edge=60, cutoff=None, target=None), "sta_time_course": Rule(cutoff=None, target=None), "iprgc_test": Rule(first=1800)}
LEAST_FILTER = 16  # samples; shorter traces aren't filtered
DIRECTIONS = ("000", "045", "090", "135", "180", "225", "270", "315")


def _kernel(cutoff: float, rate: float, order: int, kind: str):
    filt = butter_lowpass if kind == "butterworth" else bessel_lowpass

    def run(traces: pd.Series) -> pd.Series:
        out = [None if x is None else np.asarray(x, dtype=float) for x in traces]
        by_length: dict[int, list[int]] = {}
        for i, x in enumerate(out):
            if x is not None and len(x) >= LEAST_FILTER and np.isfinite(x).all():
                by_length.setdefault(len(x), []).append(i)
        for at in by_length.values():  # rows of a length are filtered together
            for i, y in zip(at, filt(np.stack([out[i] for i in at]), cutoff, rate, order)):
                out[i] = y
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, TRACE)


def lowpassed(trace: Column, cutoff: float = 10.0, rate: float = RATE, order: int = 4, kind: str = "butterworth") -> Column:
    """Zero-phase low-pass; NULL stays NULL, a trace that is short or not finite stays as it is, and so do all where the cutoff reaches half the rate."""
    return trace if cutoff >= rate / 2 else _kernel(cutoff, rate, order, kind)(trace)


def thinned(trace: Column, rate: float = RATE, target: float | None = 10.0) -> Column:
    """Every ``rate / target``-th sample, the first included."""
    return trace if target is None or target >= rate else A.every_nth(trace, int(round(rate / target)))


def segment(trace: Column, name: str, rate: float = RATE, order: int = 4) -> Column:
    """One segment by its rule."""
    r = RULES.get(name, Rule())
    x = trace
    if r.edge:
        x = F.when(F.size(x) > 2 * r.edge, F.slice(x, r.edge + 1, F.greatest(F.size(x) - 2 * r.edge, F.lit(0)))).otherwise(x)
    if r.first is not None:
        x = F.slice(x, 1, r.first)
    if r.cutoff is not None:
        x = lowpassed(x, r.cutoff, rate, order)
    return thinned(x, rate, r.target)


def mean_of_trials(trials: Column, filtered: bool = False, cutoff: float = 10.0, rate: float = RATE) -> Column:
    """The mean trace of trials cut to the shortest; with ``filtered`` it is low-passed (filtering is linear, so this is the mean of filtered trials). NULL without trials."""
    m = F.when(F.size(trials) > 0, A.mean_trace(trials))
    return lowpassed(m, cutoff, rate, 5, "bessel") if filtered else m


def last_trial(trials: Column) -> Column:
    return F.when(F.size(trials) > 0, F.element_at(trials, -1))


def normalized(trace: Column, how: str = "zscore") -> Column:
    """``zscore``, ``maxabs``, ``minmax``, ``baseline`` (less the mean of the first tenth) or ``none``; a constant trace becomes zeros under the first three."""
    if how == "none":
        return trace
    if how == "baseline":
        return A.let(lambda v: F.transform(v.x, lambda y: y - v.m), x=trace, m=A.mean(F.slice(trace, 1, F.greatest(F.lit(1), (F.size(trace) / 10).cast("int")))))
    if how == "zscore":
        low, span = A.mean(trace), A.std_pop(trace)
    elif how == "maxabs":
        low, span = F.lit(0.0), A.max_abs(trace)
    elif how == "minmax":
        low, span = F.array_min(trace), F.array_max(trace) - F.array_min(trace)
    else:
        raise ValueError(f"no normalisation {how!r}")
    return A.let(lambda v: F.transform(v.x, lambda y: (y - v.low) / F.when(v.span > 1e-10, v.span).otherwise(1.0)), x=trace, low=low, span=span)


def bar_trace(df: DataFrame, template: str = "corrected_moving_h_bar_s5_d8_3x_{}") -> Column:
    """The mean traces of the eight directions, end to end; NULL where one of them is missing."""
    parts = [mean_of_trials(F.col(template.format(d))) for d in DIRECTIONS]
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat(*parts))


def cut_to_shortest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each trace column cut to its shortest trace over all rows; NULL and empty traces don't count and stay. One aggregate of one row."""
    least = df.agg(*[F.min(F.when(F.size(c) > 0, F.size(c))).alias(f"_n_{c}") for c in columns])
    both = df.join(F.broadcast(least))  # one row
    return both.select(*[F.slice(c, 1, F.coalesce(F.col(f"_n_{c}"), F.lit(1))).alias(c) if c in columns else F.col(c) for c in df.columns])


def modal_length(df: DataFrame, column: str) -> DataFrame:
    """The traces padded with zeros or cut to the most frequent length (the smallest of several)."""
    from spikeloom.operators.rates import pad_or_trim

    sizes = df.where(F.size(column) > 0).groupBy(F.size(column).alias("n")).agg(F.count("*").alias("k"))
    mode = sizes.agg(F.max_by("n", F.struct("k", -F.col("n"))).alias("_mode"))
    both = df.join(F.broadcast(mode))  # one row
    return both.select(*[F.when(F.col(c).isNotNull(), pad_or_trim(F.col(c), F.col("_mode"))).alias(c) if c == column else F.col(c) for c in df.columns])


def segments(df: DataFrame, keys: list[str], columns: dict[str, Column], how: str = "none", rate: float = RATE) -> DataFrame:
    """``keys`` and a column per segment: prepared by its rule, cut to the shortest over all cells, normalised.

    ``columns`` gives each segment's raw trace. Rows that lack one of the
    segments, or hold a value that isn't finite, are left out, as a classifier
    needs whole rows.
    """
    made = df.select(*keys, *[segment(c, n, rate).alias(n) for n, c in columns.items()])
    whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() & (F.size(n) > 0) & ~A.has_bad(F.col(n)) for n in columns])
    short = cut_to_shortest(made.where(whole), list(columns))
    return short.select(*keys, *[normalized(F.col(n), how).alias(n) for n in columns])


def end_to_end(df: DataFrame, keys: list[str], names: list[str], out: str = "trace") -> DataFrame:
    """The segments of a row as one trace."""
    return df.select(*keys, F.concat(*names).alias(out))


def segment_map(df: DataFrame, names: list[str]) -> DataFrame:
    """Where each segment lies in the trace laid end to end: ``segment, start, end``; from the shortest length of each."""
    sizes = df.agg(*[F.min(F.size(n)).alias(n) for n in names])
    ends = [sum((F.col(x) for x in names[: i + 1]), F.lit(0)) for i in range(len(names))]
    return sizes.select(F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), (e - F.col(n)).cast("long").alias("start"), e.cast("long").alias("end")) for n, e in zip(names, ends)])).alias("s")).select("s.*")


def bar_factors(trials: list[Column]) -> Column:
    """``struct<time_course, tuning, share>``: the first singular pair of the eight directions' mean traces, scaled by their greatest value; its share of the variance.

    The pair's sign is free; the tuning curve's sum is made positive.
    """
    schema = T.StructType.fromDDL("time_course array<double>, tuning array<double>, share double")

    def run(*cols: pd.Series) -> pd.DataFrame:
        rows = []
        for trials in zip(*cols):
            if any(x is None or not len(x) or any(t is None or not len(t) for t in x) for x in trials):
                rows.append((None, None, None))
                continue
            own = [np.mean([np.asarray(t, dtype=float)[: min(map(len, x))] for t in x], axis=0) for x in trials]
            n = min(map(len, own))
            m = np.stack([np.asarray(x, dtype=float)[:n] for x in own], axis=1)
            if not np.isfinite(m).all():
                rows.append((None, None, None))
                continue
            u, s, vt = np.linalg.svd(m / (np.abs(m).max() + 1e-8), full_matrices=False)
            sign = -1.0 if vt[0].sum() < 0 else 1.0
            rows.append((sign * u[:, 0] * s[0], sign * vt[0], float(s[0] ** 2 / max((s**2).sum(), 1e-300))))
        return pd.DataFrame(rows, columns=["time_course", "tuning", "share"])

    return F.pandas_udf(run, schema)(*trials)
