"""Summaries of responses: histograms around events, rank tests, cluster indices, average curves, missing-value reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psth(events: DataFrame, keys: list[str], trial: str, since: str, width: float, n_trials: Column) -> DataFrame:
    """``keys, bin_no, n, rate``: events of all trials per bin since their trial's start, over the number of trials and the width."""
    b = F.floor(F.col(since) / F.lit(width)).cast("long").alias("bin_no")
    return events.where(F.col(since) >= 0).groupBy(*keys, b).agg(F.count("*").alias("n")).withColumn("rate", F.col("n") / (n_trials * width))


def rank_sum(df: DataFrame, by: list[str], group: Column, value: str) -> DataFrame:
    """``by, n_a, n_b, u, z``: the Mann-Whitney statistic of the true group, with mean ranks for ties and its normal score.

    Ranks come from counts per distinct value, so a group with many equal
    values is small before it is ordered.
    """
    rows = df.withColumn("_g", group).where(F.col("_g").isNotNull() & F.col(value).isNotNull())
    per = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"), F.count_if(F.col("_g")).alias("_a"))
    below = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_rank", F.coalesce(F.sum("_n").over(below), F.lit(0)) + (F.col("_n") + 1) / 2.0)
    s = per.groupBy(*by).agg(F.sum("_a").alias("n_a"), (F.sum("_n") - F.sum("_a")).alias("n_b"), F.sum(F.col("_a") * F.col("_rank")).alias("r"), F.sum(F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")).alias("t"))
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = a + b
    u = F.col("r") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))
    ok = (a > 0) & (b > 0) & (n > 1)
    return s.select(*by, "n_a", "n_b", F.when(ok, u).alias("u"), F.when(ok, F.when(sd > 0, (u - a * b / 2) / sd)).alias("z"))


def paired_t(df: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """``by, n, mean_difference, t`` of pairs with both values; NULL t without spread or for fewer than two pairs."""
    d = F.col(after) - F.col(before)
    s = df.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_s"))
    t = F.when((F.col("n") > 1) & (F.col("_s") > 0), F.col("mean_difference") / (F.col("_s") / F.sqrt("n")))
    return s.select(*by, "n", "mean_difference", t.alias("t"))


def cluster_indices(df: DataFrame, dims: list[str], cluster: str) -> DataFrame:
    """One row: ``n, k, calinski_harabasz, davies_bouldin``, from sizes, centres and scatters per cluster.

    Pairs of clusters are formed for the second index: as many as clusters
    squared, never rows.
    """
    rows = df.dropna(subset=[*dims, cluster])
    centres = rows.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in dims])
    d2 = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in dims])
    scatter = rows.join(centres.drop("n"), cluster).groupBy(cluster).agg(F.avg(F.sqrt(d2)).alias("s"), F.sum(d2).alias("w"))
    one = centres.join(scatter, cluster)
    whole = rows.agg(*[F.avg(c).alias(f"g_{c}") for c in dims])
    between = reduce(lambda a, b: a + b, [(F.col(f"m_{c}") - F.col(f"g_{c}")) * (F.col(f"m_{c}") - F.col(f"g_{c}")) for c in dims])
    ch = one.join(F.broadcast(whole)).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * between).alias("b"), F.sum("w").alias("w"))  # one row
    a, b = one.select(F.col(cluster).alias("ca"), F.col("s").alias("sa"), *[F.col(f"m_{c}").alias(f"a_{c}") for c in dims]), one.select(F.col(cluster).alias("cb"), F.col("s").alias("sb"), *[F.col(f"m_{c}").alias(f"b_{c}") for c in dims])
    gap = F.sqrt(reduce(lambda x, y: x + y, [(F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in dims]))
    db = a.join(b, F.col("ca") != F.col("cb")).where(gap > 0).groupBy("ca").agg(F.max((F.col("sa") + F.col("sb")) / gap).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    index = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("w") > 0), (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))))
    return ch.withColumn("calinski_harabasz", index).join(F.broadcast(db)).select("n", "k", "calinski_harabasz", "davies_bouldin")  # one row each


def falling_curves(df: DataFrame, cluster: str, value: str, points: int = 11) -> DataFrame:
    """``cluster, point, value``: each cluster's values in falling order, read at ``points`` even places by linear interpolation.

    The places are exact percentiles, which are the same interpolation.
    """
    shares = [1 - i / (points - 1) for i in range(points)]
    got = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.percentile(value, F.array(*[F.lit(s) for s in shares])).alias("v"))
    return got.select(cluster, F.posexplode("v").alias("point", "value"))


def missing_report(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``by, column, n_missing, percent``: NULL or NaN per column, from one pass."""
    bad = {c: F.count_if(F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))) for c in columns}
    wide = df.groupBy(*by).agg(F.count("*").alias("_n"), *[e.alias(c) for c, e in bad.items()])
    long = wide.select(*by, "_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])).alias("e"))
    return long.select(*by, "e.column", "e.n_missing", (100.0 * F.col("e.n_missing") / F.col("_n")).alias("percent"))


def threshold_grid(df: DataFrame, by: list[str], value: str, thresholds: list[float], edges: list[int]) -> DataFrame:
    """``threshold, bucket, n_groups``: how many groups keep a count in each right-closed bucket at each threshold; empty buckets are 0."""
    wide = df.groupBy(*by).agg(*[F.count_if(F.col(value) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    cols = [F.count_if((F.col(f"t{i}") > a) & (F.col(f"t{i}") <= b)).alias(f"c{i}_{j}") for i in range(len(thresholds)) for j, (a, b) in enumerate(zip(edges, edges[1:]))]
    one = wide.agg(*cols)
    cells = [F.struct(F.lit(float(t)).alias("threshold"), F.lit(j).cast("long").alias("bucket"), F.col(f"c{i}_{j}").alias("n_groups")) for i, t in enumerate(thresholds) for j in range(len(edges) - 1)]
    return one.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def zero_filled(chain: DataFrame, values: DataFrame, key: str, value: str, steps: int) -> DataFrame:
    """Values along chains ``n0..n{steps}``, 0 where the chain has ended; chains without a second member are dropped."""
    out = chain.where(F.col("n1").isNotNull())
    for i in range(steps + 1):
        v = values.select(F.col(key).alias(f"n{i}"), F.col(value).alias(f"v{i}"))
        out = out.join(v, f"n{i}", "left").withColumn(f"v{i}", F.coalesce(f"v{i}", F.lit(0.0)))
    return out.select(*[f"n{i}" for i in range(steps + 1)], *[f"v{i}" for i in range(steps + 1)])
