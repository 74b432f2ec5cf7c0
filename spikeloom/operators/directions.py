"""Moving-bar responses: sectioning by direction, and selectivity with permutation tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.operators.joins import range_join

DIRECTIONS = 8


def direction_spans(centres: DataFrame, timing: DataFrame, start: str, pad: int = 10) -> DataFrame:
    """A row per unit and trial: ``direction, rep, from_frame, to_frame`` from the pixel's on and off frames.

    ``timing`` has ``row, col, on array<int>, off array<int>`` with a trial per
    element: direction is the trial modulo 8, repetition its quotient. Units
    whose pixel isn't listed have none.
    """
    trial = centres.join(timing, ["row", "col"]).select("*", F.posexplode(F.arrays_zip("on", "off")).alias("trial", "z"))
    return trial.select(
        *[c for c in centres.columns], F.pmod("trial", F.lit(DIRECTIONS)).cast("int").alias("direction"), F.floor(F.col("trial") / DIRECTIONS).cast("int").alias("rep"),
        (F.col(start) + F.col("z.on") - pad).alias("from_frame"), (F.col(start) + F.col("z.off") + pad).alias("to_frame"),
    )


def section_by_direction(spikes: DataFrame, spans: DataFrame, keys: list[str], frame: str, start: str, width: int = 600) -> DataFrame:
    """Spikes inside their unit's trials, both bounds included, in frames relative to the movie's start."""
    cols = spans.select(*keys, "direction", "rep", "from_frame", "to_frame", F.col(start).alias("_start"))
    got = range_join(spikes, cols, keys, frame, "from_frame", "to_frame", float(width), closed=True)
    return got.withColumn("movie_frame", F.col(frame) - F.col("_start")).drop("_start")


def selectivity(totals: np.ndarray, seed: int, rounds: int = 2000) -> list[float]:
    """From an 8 x 3 matrix of summed rates: direction index, orientation index, preferred angle and two permutation p-values.

    The direction index is the vector sum over the greatest mean rate. A p is
    one minus the normal distribution of the z-score against shuffles of all
    trials, 1 where shuffling changes nothing.
    """
    if totals.shape != (DIRECTIONS, 3) or not np.isfinite(totals).all():
        return [math.nan] * 5
    angle = np.arange(DIRECTIONS) * 2 * np.pi / DIRECTIONS

    def index(mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, o = np.abs(mean @ np.exp(1j * angle)), np.abs(mean @ np.exp(2j * angle))
        top, total = mean.max(-1), mean.sum(-1)
        return np.where(top > 0, d / np.where(top > 0, top, 1), 0.0), np.where(total > 0, o / np.where(total > 0, total, 1), 0.0)

    mean = totals.mean(1)
    rng = np.random.default_rng(seed)
    shuffled = rng.permuted(np.tile(totals.ravel(), (rounds, 1)), axis=1).reshape(rounds, DIRECTIONS, 3).mean(2)
    out = []
    for real, null in zip(index(mean), index(shuffled)):
        s = null.std()
        z = (float(real) - null.mean()) / s if s > 1e-12 else None
        out.append((float(real), 1.0 if z is None else 0.5 * math.erfc(z / math.sqrt(2))))
    vector = mean @ np.exp(1j * angle)
    preferred = float(np.degrees(np.angle(vector)) % 360) if abs(vector) > 1e-12 else math.nan
    preferred = 0.0 if preferred == 360.0 else preferred  # the remainder of a tiny negative angle
    return [out[0][0], out[1][0], preferred, out[0][1], out[1][1]]


def selectivity_struct(totals: Column, key: Column, rounds: int = 2000) -> Column:
    """``struct<dsi, osi, preferred, ds_p, os_p>`` of an ``array<array<double>>`` (8 directions x 3 trials); seeded by the key, so repeatable."""
    names = ["dsi", "osi", "preferred", "ds_p", "os_p"]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    def run(m: pd.Series, seed: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(m, seed):
            ok = t is not None and len(t) == DIRECTIONS and all(x is not None and len(x) == 3 for x in t)
            rows.append(selectivity(np.array([list(x) for x in t], dtype=float), int(s) & 0x7FFFFFFF, rounds) if ok else [math.nan] * 5)
        return pd.DataFrame(rows, columns=names, dtype="float64")

    return F.pandas_udf(run, schema)(totals, F.xxhash64(key))


def duration_stats(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """``by, n, shortest, longest, mean, sd, n_negative`` of durations, with the population deviation."""
    d = F.col(end) - F.col(start)
    return spans.groupBy(*by).agg(F.count(d).alias("n"), F.min(d).alias("shortest"), F.max(d).alias("longest"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.count_if(d < 0).alias("n_negative"))
