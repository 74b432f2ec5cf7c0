"""Statistics over a population of cells: groups, purity, enrichment, significance, binned courses."""

from __future__ import annotations

from functools import reduce

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def priority_group(flags: list[tuple[str, Column]], other: str = "Other") -> Column:
    """The first label whose flag holds; NULL flags don't."""
    out = None
    for name, flag in flags:
        ok = F.coalesce(flag, F.lit(False))
        out = F.when(ok, name) if out is None else out.when(ok, name)
    return out.otherwise(other)


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> tuple[DataFrame, Column]:
    """Filters in turn. The rows that pass all, and a column that names the first step a row fails (NULL if none); NULL conditions fail."""
    reason = None
    for name, ok in steps:
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    return df.where(reason.isNull()), reason


def in_groups_of(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows: a semi join with the counted groups."""
    big = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return df.join(big.select(*by), by, "left_semi")


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """``cluster, n, top_label, purity``: the share of the most frequent label, the smallest of several."""
    c = df.groupBy(cluster, label).agg(F.count("*").alias("k"))
    w = c.groupBy(cluster).agg(F.sum("k").alias("n"), F.max("k").alias("top"))
    first = c.join(w, cluster).where("k = top").groupBy(cluster).agg(F.min(label).alias("top_label"))
    return w.join(first, cluster).select(cluster, "n", "top_label", (F.col("top") / F.col("n")).alias("purity"))


def binary_purity(df: DataFrame, by: list[str], cluster: str, label: Column) -> DataFrame:
    """``by, n, purity``: the larger side of a yes-or-no label summed over clusters, over all rows; what clustering without that label keeps of it."""
    c = df.withColumn("_y", label).where("_y IS NOT NULL").groupBy(*by, cluster).agg(F.count_if("_y").alias("p"), F.count("*").alias("k"))
    return c.groupBy(*by).agg(F.sum("k").alias("n"), (F.sum(F.greatest(F.col("p"), F.col("k") - F.col("p"))) / F.sum("k")).alias("purity"))


def _joined(a: DataFrame, b: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """``a`` with the other columns of ``b`` where ``cols`` are equal, NULL being equal to NULL; ``a`` and ``b`` may come from one table."""
    other = b.select(*[F.col(c).alias(f"_b_{c}") for c in cols], *[c for c in b.columns if c not in cols])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in cols])
    return a.join(other, on, how).drop(*[f"_b_{c}" for c in cols])


def enrichment(df: DataFrame, cluster: str, positive: Column, top: int = 3) -> DataFrame:
    """``cluster, n, n_positive, fraction, enrichment, purity, rank`` of the ``top`` clusters by enrichment; ties by cluster."""
    per = df.groupBy(cluster).agg(F.count("*").alias("n"), F.count_if(positive).alias("n_positive"))
    base = per.agg((F.sum("n_positive") / F.sum("n")).alias("_base"))
    frac = F.col("n_positive") / F.col("n")
    out = per.join(F.broadcast(base)).select(cluster, "n", "n_positive", frac.alias("fraction"), F.when(F.col("_base") > 0, frac / F.col("_base")).otherwise(0.0).alias("enrichment"), F.greatest(frac, 1 - frac).alias("purity"))  # one row
    best = out.orderBy(F.desc("enrichment"), cluster).limit(top)  # each task keeps its own best only
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("enrichment"), cluster)).cast("long"))


def fdr_adjusted(df: DataFrame, by: list[str], p: str, out: str = "p_adjusted", cells: int = 4096) -> DataFrame:
    """Step-up adjusted p-values: the running minimum from the greatest p of ``p * n / rank``, at most 1. NULL p don't count and are left out.

    Equal p share the rank of the last of them. They are counted first, then
    ranked inside (group, cell of p), with one row per cell that carries over,
    so neither a hot group nor the whole table is ordered by one task.
    """
    have = df.where(F.col(p).isNotNull())
    keys = by or ["_all"]
    have = have if by else have.withColumn("_all", F.lit(0))
    cell = F.least(F.floor(F.col("_p") * cells), F.lit(cells - 1))
    c = have.groupBy(*keys, F.col(p).alias("_p")).agg(F.count("*").alias("_k")).withColumn("_cell", cell)
    inside = Window.partitionBy(*keys, "_cell").orderBy("_p")
    over = Window.partitionBy(*keys).orderBy("_cell")  # at most ``cells`` rows
    sums = c.groupBy(*keys, "_cell").agg(F.sum("_k").alias("_t"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_t").over(Window.partitionBy(*keys)))
    ranked = _joined(c, sums.select(*keys, "_cell", "_before", "_n"), [*keys, "_cell"])
    ranked = ranked.withColumn("_r", F.col("_before") + F.sum("_k").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_v", F.col("_p") * F.col("_n") / F.col("_r"))
    lows = ranked.groupBy(*keys, "_cell").agg(F.min("_v").alias("_low"))
    lows = lows.select(*keys, "_cell", F.min("_low").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    low = _joined(ranked, lows, [*keys, "_cell"], "left")
    here = F.min("_v").over(inside.rowsBetween(0, Window.unboundedFollowing))
    adjusted = low.withColumn(out, F.least(F.lit(1.0), here, "_above")).select(*keys, "_p", out)
    got = _joined(have.withColumn("_p", F.col(p)), adjusted, [*keys, "_p"])
    return got.select(*df.columns, out)


def log_bayes_choice(df: DataFrame, by: list[str], k: str, bic: str, least: float = 6.0) -> DataFrame:
    """``by, k``: the first k after which a further component gains a log Bayes factor below ``least``, else that of the lowest BIC."""
    w = Window.partitionBy(*by).orderBy(k)
    lbf = df.withColumn("_l", -0.5 * (F.lead(bic).over(w) - F.col(bic)))
    low = F.min_by(k, F.struct(bic, k))
    return lbf.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("_l") < least, F.col(k))), low).alias("k"))


def bic_choice(df: DataFrame, by: list[str], k: str, bic: str, elbow: float = 0.01) -> DataFrame:
    """``by, k_min, k_elbow``: the k of the lowest BIC (the smaller of equals), and the last k before the relative gain falls below ``elbow``, else that of the lowest."""
    w = Window.partitionBy(*by).orderBy(k)
    before = df.withColumn("_b", F.lag(bic).over(w)).withColumn("_k", F.lag(k).over(w))
    low = F.min_by(k, F.struct(bic, k))
    small = (F.col("_b") - F.col(bic)) / F.abs("_b") < elbow
    return before.groupBy(*by).agg(low.alias("k_min"), F.coalesce(F.min(F.when(small, F.col("_k"))), low).alias("k_elbow"))


def encoded(df: DataFrame, label: str, out: str) -> DataFrame:
    """Add ``out``: the place of each label in their order, from 0; NULL stays NULL. The labels are aggregated first."""
    codes = df.where(F.col(label).isNotNull()).select(label).distinct().withColumn(out, (F.row_number().over(Window.orderBy(label)) - 1).cast("long"))  # a row per label
    return df.join(codes, label, "left").select(*df.columns, out)


def binned_course(df: DataFrame, by: list[str], unit: str, time: str, value: str, width: float) -> DataFrame:
    """Means per unit and bin first, then over units: ``by, bin_no, n_units, mean, sem`` with the sample deviation."""
    b = F.floor(F.col(time) / F.lit(width)).cast("long").alias("bin_no")
    each = df.groupBy(*by, unit, b).agg(F.avg(value).alias("m"))
    return each.groupBy(*by, "bin_no").agg(F.count("m").alias("n_units"), F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"))


def normalized_to_first(df: DataFrame, by: list[str], order: list[str], value: str, n: int, out: str = "normalized") -> DataFrame:
    """Values over the mean of the first ``n`` of their group; NULL where that is 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).groupBy(*by).agg(F.avg(value).alias("_m"))
    return df.join(first, by).withColumn(out, F.when(F.col("_m") != 0, F.col(value) / F.col("_m"))).drop("_m")


def treatment_effect(df: DataFrame, by: list[str], unit: str, time: str, value: str, at: float, span: float) -> DataFrame:
    """Percent change of the mean from ``[at - span, at)`` to ``[at, at + span)`` per unit, then ``n_units, mean_effect, sd_effect`` (sample deviation)."""
    pre = F.avg(F.when((F.col(time) >= at - span) & (F.col(time) < at), F.col(value)))
    post = F.avg(F.when((F.col(time) >= at) & (F.col(time) < at + span), F.col(value)))
    each = df.groupBy(*by, unit).agg(pre.alias("pre"), post.alias("post")).where("pre > 0 AND post IS NOT NULL")
    effect = 100.0 * (F.col("post") - F.col("pre")) / F.col("pre")
    return each.groupBy(*by).agg(F.count("*").alias("n_units"), F.avg(effect).alias("mean_effect"), F.stddev_samp(effect).alias("sd_effect"))


def memberships(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """A row per combination of flags, the absent ones with 0 included where ``by`` is empty."""
    cols = [F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()]
    return df.select(*by, *cols).groupBy(*by, *flags).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts by ``row`` and the given values of ``col``, absent ones 0, with percent of the row."""
    wide = df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(f"n_{v}") for v in values])
    all_ = reduce(lambda a, b: a + b, [F.col(f"n_{v}") for v in values])
    return wide.select(row, *[f"n_{v}" for v in values], *[F.when(all_ > 0, 100.0 * F.col(f"n_{v}") / all_).alias(f"pct_{v}") for v in values])


def coverage(df: DataFrame, by: list[str], area: str, factor: float, least: float = 0.8) -> DataFrame:
    """``n, median_area, coverage, covered``: median area times count over ``factor``."""
    c = F.col("median_area") * F.col("n") / factor
    return df.groupBy(*by).agg(F.count(area).alias("n"), F.median(area).alias("median_area")).withColumn("coverage", c).withColumn("covered", F.col("coverage") > least)


def two_level(df: DataFrame, by: list[str], inner: list[str], value: str) -> DataFrame:
    """The mean of inner means, and the sum of inner counts; not the direct mean."""
    each = df.groupBy(*by, *inner).agg(F.avg(value).alias("m"), F.count("*").alias("k"))
    return each.groupBy(*by).agg(F.avg("m").alias("mean"), F.sum("k").alias("n"))


def welch(df: DataFrame, by: list[str], group: Column, value: str) -> DataFrame:
    """Two groups by a boolean: sizes, means, Welch's t, its degrees of freedom, Cohen's d and the two-sided p."""
    v = F.col(value)
    a = df.withColumn("_g", group).where("_g IS NOT NULL").groupBy(*by).agg(
        *[f.alias(n) for g, s in ((True, "a"), (False, "b")) for n, f in (
            (f"n_{s}", F.count(F.when(F.col("_g") == g, v))), (f"mean_{s}", F.avg(F.when(F.col("_g") == g, v))), (f"var_{s}", F.var_samp(F.when(F.col("_g") == g, v))))]
    )
    se_a, se_b = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    ok = (F.col("n_a") > 1) & (F.col("n_b") > 1) & (se_a + se_b > 0)
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(se_a + se_b)
    df_ = (se_a + se_b) * (se_a + se_b) / (se_a * se_a / (F.col("n_a") - 1) + se_b * se_b / (F.col("n_b") - 1))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    d = F.when(pooled > 0, (F.col("mean_a") - F.col("mean_b")) / pooled)
    out = a.select(*by, "n_a", "n_b", "mean_a", "mean_b", F.when(ok, t).alias("t"), F.when(ok, df_).alias("df"), F.when(ok, d).alias("cohen_d"))
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def _betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    from math import exp, lgamma, log, log1p

    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _betainc(b, a, 1 - x)
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + num * d, 1.0 + num / c
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            f *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return front * f / a


def student_p(t: float, df: float) -> float:
    return _betainc(df / 2, 0.5, df / (df + t * t))


def binomial_p(k: int, n: int, p: float) -> float:
    """The exact two-sided binomial test: the chance of outcomes no likelier than ``k``."""
    from math import exp, lgamma, log

    if n == 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(k == (0 if p <= 0 else n))
    i = np.arange(n + 1)
    logs = np.array([lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) for x in i]) + i * log(p) + (n - i) * log(1 - p)
    pmf = np.exp(logs)
    return float(min(1.0, pmf[pmf <= exp(logs[k]) * (1 + 1e-7)].sum()))


def t_two_sided(t: Column, df: Column) -> Column:
    def run(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, b) if a == a and b == b and a is not None else None for a, b in zip(ts, dfs)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())(t, df)


def binomial_two_sided(k: Column, n: Column, p: Column) -> Column:
    def run(ks: pd.Series, ns: pd.Series, ps: pd.Series) -> pd.Series:
        return pd.Series([binomial_p(int(a), int(b), float(c)) for a, b, c in zip(ks, ns, ps)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())(k, n, p)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their key, the same rows in any engine: MD5 of ``seed:key``."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def bucketed_counts(df: DataFrame, value: str, edges: list[float], by: list[str]) -> DataFrame:
    """Counts per right-closed bucket ``(edge, next]``; a column per bucket, absent ones 0."""
    cols = [F.count_if((F.col(value) > a) & (F.col(value) <= b)).alias(f"n_{i}") for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return df.groupBy(*by).agg(*cols)


def add_missing_first(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Incremental union: rows of ``old``, then rows of ``new`` under keys that ``old`` lacks; columns are the union of both."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return old.unionByName(fresh, allowMissingColumns=True)
