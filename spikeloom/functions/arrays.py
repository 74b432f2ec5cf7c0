"""Column functions on ``array<double>`` traces; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body, **cols: Column) -> Column:
    """``body`` of a struct of columns, each computed once: inside a lambda Spark would compute them per element."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    """NULL for an empty array."""
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def var_pop(a: Column) -> Column:
    """Two passes, so that a large mean costs no digits."""
    return let(lambda v: F.when(F.size(v.a) > 0, F.aggregate(v.a, F.lit(0.0), lambda s, x: s + (x - v.m) * (x - v.m)) / F.size(v.a)), a=a, m=mean(a))


def std_pop(a: Column) -> Column:
    return F.sqrt(var_pop(a))


def zscore(a: Column) -> Column:
    """Population z-score; a constant trace becomes zeros."""
    s = std_pop(a)
    return let(lambda v: F.transform(v.a, lambda x: (x - v.m) / v.s), a=a, m=mean(a), s=F.when(s < 1e-10, F.lit(1.0)).otherwise(s))


def max_abs(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))


def by_max_abs(a: Column, eps: float = 1e-8) -> Column:
    """Scaled to at most 1; a trace near zero becomes zeros."""
    return let(lambda v: F.transform(v.a, lambda x: F.when(v.m < 1e-10, F.lit(0.0)).otherwise(x / (v.m + eps))), a=a, m=max_abs(a))


def min_max(a: Column) -> Column:
    width = (F.array_max(a) - F.array_min(a)).cast("double")
    return let(lambda v: F.transform(v.a, lambda x: (x - v.lo) / v.w), a=a, lo=F.array_min(a), w=F.when(width < 1e-10, F.lit(1.0)).otherwise(width))


def median_first(a: Column, n: int) -> Column:
    """The median of the first ``n`` values."""
    k = lambda v: F.size(v.s)
    at = lambda v, i: F.get(v.s, F.floor(i).cast("int")).cast("double")
    return let(lambda v: F.when(k(v) > 0, (at(v, (k(v) - 1) / 2) + at(v, k(v) / 2)) / 2), s=F.sort_array(F.slice(a, 1, n)))


def minus_baseline(a: Column, n: int) -> Column:
    return let(lambda v: F.transform(v.a, lambda x: x - v.b), a=a, b=median_first(a, n))


def every_nth(a: Column, n: int) -> Column:
    return F.filter(F.transform(a, lambda x, i: F.when(i % n == 0, F.struct(x.alias("x")))), lambda s: s.isNotNull())["x"]


def block_mean(a: Column, n: int) -> Column:
    """Means of consecutive blocks of ``n``; an incomplete last block is dropped."""
    blocks = F.floor(F.size(a) / n).cast("int")
    return F.when(blocks > 0, F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: mean(F.slice(a, i * n + 1, F.lit(n))))).otherwise(F.array().cast("array<double>"))


def window(a: Column, start: int, end: int) -> Column:
    """Samples ``start`` up to ``end``, 0-based, the end left out."""
    return F.slice(a, start + 1, end - start)


def extreme(a: Column) -> Column:
    """The value of greatest magnitude; the positive one on a tie, 0 for an empty window."""
    hi, lo = F.array_max(a), F.array_min(a)
    return F.when(F.size(a) > 0, F.when(F.abs(lo) > F.abs(hi), lo).otherwise(hi)).otherwise(0.0).cast("double")


def argmax(a: Column) -> Column:
    """0-based; the first of equal values."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("long")


def has_bad(a: Column) -> Column:
    """True where the trace is NULL or holds a NULL, a NaN or an infinite value."""
    return a.isNull() | F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def nan_to_zero(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x.cast("double")))


def mean_trace(trials: Column) -> Column:
    """The mean over trials, cut to the shortest; NULL without trials."""
    n = F.array_min(F.transform(trials, lambda t: F.size(t)))
    add = lambda acc, t: F.zip_with(acc, F.slice(t, 1, F.size(acc)), lambda x, y: x + y.cast("double"))
    sums = F.aggregate(trials, F.array_repeat(F.lit(0.0), n), add)
    body = lambda v: F.transform(v.s, lambda x: x / v.k)
    return F.when(F.size(trials) > 0, F.when(n > 0, let(body, s=sums, k=F.size(trials))).otherwise(F.array().cast("array<double>")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance on the common prefix; infinite where there is none."""
    n = F.least(F.size(a), F.size(b))
    sq = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(n > 0, F.sqrt(sq)).otherwise(F.lit(float("inf")))


def peak_normalized(a: Column) -> Column:
    """Divided by its greatest magnitude; zeros stay."""
    return let(lambda v: F.transform(v.a, lambda x: F.when(v.m > 0, x / v.m).otherwise(F.lit(0.0))), a=a, m=max_abs(a))


def summary_columns(a: Column, name: str, width: int = 10) -> list[Column]:
    """Flat columns of an array: its values up to ``width``, else NULLs, beside mean, population deviation, minimum and maximum of longer ones."""
    short = F.size(a) <= width
    cols = [F.when(short, F.get(a, F.lit(i))).cast("double").alias(f"{name}_{i}") for i in range(width)]
    stats = {"mean": mean(a), "std": std_pop(a), "min": F.array_min(a), "max": F.array_max(a)}
    return cols + [F.when(~short, c).cast("double").alias(f"{name}_{n}") for n, c in stats.items()]
