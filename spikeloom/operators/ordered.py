"""Ordered-sequence operators that don't put a whole key into one task.

A window over ``partition by key order by time`` sorts all rows of a key in
one task. Here rows are cut into (key, bucket of time); inside a bucket the
window is Spark's own, and what crosses a bucket's edge is one carried row per
bucket, taken from a small table of bucket ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _match(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])


def with_previous(df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, value: Column, out: str, where: Column | None = None) -> DataFrame:
    """Add ``out``: ``value`` of the nearest earlier row of the same keys, of those rows for which ``where`` holds.

    ``bucket`` has to be monotone in the order. NULL where there is none. Keys
    that are NULL are a key like others. Rows of equal order are put in an
    arbitrary order, so give a total one where it matters.
    """
    keep = F.lit(True) if where is None else where
    cols = df.columns
    rows = df.withColumn("_bucket", bucket).withColumn("_v", F.when(keep, F.struct(value.alias("v"))))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("_here", F.last("_v", ignorenulls=True).over(before))
    # The last kept value of each bucket: max_by over the order, which needs no sort.
    sort_key = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    # Buckets without a kept row need the carry too, so every bucket that occurs is listed.
    listed = rows.groupBy(*keys, "_bucket").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), sort_key)).alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = listed.withColumn("_carry", F.last("_end", ignorenulls=True).over(over)).where("_carry IS NOT NULL").drop("_end")
    joined = here.join(carried, _match(here, carried, [*keys, "_bucket"]), "left")
    return joined.select(*[here[c] for c in cols], F.coalesce(here["_here"], carried["_carry"])["v"].alias(out))


def with_neighbours(df: DataFrame, keys: list[str], order: str, bucket: Column, value: Column, before: str, after: str) -> DataFrame:
    """Add ``before`` and ``after``: ``value`` of the row before and the row behind, of rows with the same keys. One shuffle for both.

    ``bucket`` has to be monotone in the order. NULL where there is none.
    """
    cols = df.columns
    rows = df.withColumn("_bucket", bucket).withColumn("_v", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    here = rows.withColumn("_a", F.lag("_v").over(inside)).withColumn("_b", F.lead("_v").over(inside))
    ends = rows.groupBy(*keys, "_bucket").agg(F.max_by("_v", order).alias("_last"), F.min_by("_v", order).alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_bucket")
    carried = ends.select(*keys, "_bucket", F.lag("_last").over(over).alias("_ca"), F.lead("_first").over(over).alias("_cb"))
    joined = here.join(carried, _match(here, carried, [*keys, "_bucket"]), "left")
    return joined.select(*[here[c] for c in cols], F.coalesce(here["_a"], carried["_ca"])["v"].alias(before), F.coalesce(here["_b"], carried["_cb"])["v"].alias(after))


def exact_median(df: DataFrame, keys: list[str], value: str, width: float, out: str = "median") -> DataFrame:
    """``keys, out``: the median of a number per key, the middle of two; NULL and NaN are left out.

    Equal values are counted first; counts are summed up inside (key, stretch
    of ``width`` of the values), and one row per stretch carries over. So no
    task holds all values of a key, as Spark's own median does.
    """
    c = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).alias("_x")).agg(F.count("*").alias("_k"))
    up = running_sum(c, keys, ["_x"], F.floor(F.col("_x") / F.lit(width)), F.col("_k"), "_before")
    n = c.groupBy(*keys).agg(F.sum("_k").alias("_n"))
    both = up.join(n, _match(up, n, keys)).select(*[up[k] for k in keys], "_x", "_k", "_before", "_n") if keys else up.join(F.broadcast(n))  # without keys, one row
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    holds = lambda i: (F.col("_before") <= i) & (i < F.col("_before") + F.col("_k"))
    mid = both.where(holds(lo) | holds(hi))
    return mid.groupBy(*keys).agg(((F.min("_x") + F.max("_x")) / 2).alias(out))


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the same keys, this row left out (0 for the first)."""
    cols = df.columns
    rows = df.withColumn("_bucket", bucket).withColumn("_v", F.coalesce(value.cast("double"), F.lit(0.0)))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("_here", F.coalesce(F.sum("_v").over(inside), F.lit(0.0)))
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_v").alias("_total"))
    over = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_carry", F.coalesce(F.sum("_total").over(over), F.lit(0.0))).drop("_total")
    joined = here.join(carried, _match(here, carried, [*keys, "_bucket"]))
    return joined.select(*[here[c] for c in cols], (here["_here"] + carried["_carry"]).alias(out))


def longest_run(df: DataFrame, keys: list[str], order: str, max_gap: float, bucket: float) -> DataFrame:
    """Gaps and islands: the longest run of rows whose steps in ``order`` are ``max_gap`` at most; ties go to the earliest.

    ``keys, run_start, run_end, n_rows``. Rows with a NULL order are left out.
    ``bucket`` is the width of the stretches of ``order`` one task sorts; runs
    are first found inside them, then joined over their edges, a row per run.
    """
    rows = df.where(F.col(order).isNotNull()).select(*keys, order, F.floor(F.col(order) / F.lit(bucket)).alias("_bucket"))
    w = Window.partitionBy(*keys, "_bucket").orderBy(order)
    marked = rows.withColumn("_new", F.when(F.col(order) - F.lag(order).over(w) > max_gap, 1).otherwise(0))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = runs.groupBy(*keys, "_bucket", "_run").agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n"))
    # Runs that reach over edges: only the parts of a bucket that lie at its ends can, so the others count as they are.
    ends = Window.partitionBy(*keys, "_bucket")
    part = part.withColumn("_edge", (F.col("_run") == 0) | (F.col("_run") == F.max("_run").over(ends)))
    over = Window.partitionBy(*keys).orderBy("a")
    edge = part.where("_edge").withColumn("_new", F.when(F.col("a") - F.lag("b").over(over) > max_gap, 1).otherwise(0))
    edge = edge.withColumn("_id", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy(*keys, "_id").agg(F.min("a").alias("run_start"), F.max("b").alias("run_end"), F.sum("n").alias("n_rows")).drop("_id")
    every = joined.unionByName(part.where("NOT _edge").select(*keys, F.col("a").alias("run_start"), F.col("b").alias("run_end"), F.col("n").alias("n_rows")))
    best = F.max_by(F.struct("run_start", "run_end", "n_rows"), F.struct("n_rows", (-F.col("run_start")).alias("s")))
    return every.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.run_start", "b.run_end", "b.n_rows")


def local_peaks(df: DataFrame, keys: list[str], order: str, value: str, height: float, bucket: float) -> DataFrame:
    """Rows above the row before and not below the row behind, and at least ``height``. Of a plateau of two, the first."""
    rows = with_neighbours(df, keys, order, F.floor(F.col(order) / F.lit(bucket)), F.col(value), "_before", "_after")
    return rows.where((F.col(value) >= height) & (F.col(value) > F.col("_before")) & (F.col(value) >= F.col("_after"))).drop("_before", "_after")
