"""Response quality: variance-ratio and correlation indices, interval statistics, conditional counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from functools import reduce

from pyspark.sql import functions as F

from spikeloom.functions import arrays as A
from spikeloom.operators.ordered import exact_median, with_previous


def variance_ratio_qi(long: DataFrame, keys: list[str], trial: str, sample: str, value: str) -> DataFrame:
    """``keys, qi``: variance of the mean trace over the mean variance of the trials (population variances).

    ``long`` is dense: every trial has every sample. Fewer than two trials, a
    NULL or NaN value, or constant trials give NULL.
    """
    bad = F.max(F.col(value).isNull() | F.isnan(value))
    per_trial = long.groupBy(*keys, trial).agg(F.var_pop(value).alias("v"), bad.alias("bad"))
    per_trial = per_trial.groupBy(*keys).agg(F.avg("v").alias("noise"), F.count("*").alias("k"), F.max("bad").alias("bad"))
    per_sample = long.groupBy(*keys, sample).agg(F.avg(value).alias("m")).groupBy(*keys).agg(F.var_pop("m").alias("signal"))
    ok = (F.col("k") >= 2) & ~F.col("bad") & (F.col("noise") > 0)
    return per_trial.join(per_sample, keys).select(*keys, F.when(ok, F.col("signal") / F.col("noise")).alias("qi"))


def pearson_qi(long: DataFrame, keys: list[str], trial: str, sample: str, value: str) -> DataFrame:
    """``keys, qi``: the mean correlation of each trial with the mean of all trials; constant trials are skipped."""
    mean = long.groupBy(*keys, sample).agg(F.avg(value).alias("_m"))
    moments = [F.covar_pop(value, "_m").alias("c"), F.stddev_pop(value).alias("v"), F.stddev_pop("_m").alias("w")]
    each = long.join(mean, [*keys, sample]).groupBy(*keys, trial).agg(*moments)
    return each.groupBy(*keys).agg(F.avg(F.when((F.col("v") > 0) & (F.col("w") > 0), F.col("c") / (F.col("v") * F.col("w")))).alias("qi"))


def variance_ratio_of(trials: Column) -> Column:
    """The same index for an ``array<array<double>>`` of equal lengths, inside one row."""
    noise = A.mean(F.transform(trials, A.var_pop))
    qi = lambda v: F.when((F.size(v.t) >= 2) & (v.noise > 0), A.var_pop(v.m) / v.noise)
    return A.let(qi, t=trials, m=A.mean_trace(trials), noise=noise)


def interval_stats(events: DataFrame, keys: list[str], time: str, bucket: float) -> DataFrame:
    """``keys, n, isi_mean, isi_cv, isi_median``: intervals between consecutive events; CV with the population deviation.

    Events are ordered inside buckets of ``bucket`` and one event per bucket is
    carried over. The median is exact and comes from counts of equal intervals.
    """
    rows = events.where(F.col(time).isNotNull()).select(*keys, time)
    d = with_previous(rows, keys, [time], F.floor(F.col(time) / F.lit(bucket)), F.col(time), "_before").withColumn("d", F.col(time) - F.col("_before"))
    m = F.avg("d")
    whole = d.groupBy(*keys).agg(F.count("*").alias("n"), m.alias("isi_mean"), F.when(m > 0, F.stddev_pop("d") / m).alias("isi_cv"))
    middle = exact_median(d, keys, "d", 1.0, "isi_median")
    on = reduce(lambda x, y: x & y, [whole[k].eqNullSafe(middle[k]) for k in keys])
    return whole.join(middle, on, "left").select(*[whole[k] for k in keys], "n", "isi_mean", "isi_cv", "isi_median")


def conditional_counts(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Counts of rows that meet each condition, put back onto every row of the group. Aggregated, then joined."""
    counts = df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    return df.join(counts, by, "left").fillna(0, list(conditions))


def snr(signal: Column, noise: Column, top: float = 10.0) -> Column:
    """Signal over noise, clipped to 0..top; NULL noise or zero gives 0."""
    return F.when(noise > 0, F.greatest(F.lit(0.0), F.least(F.lit(top), signal / noise))).otherwise(0.0)
