"""Range, as-of and matching joins, as equi-joins on buckets with exact residual conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: float, closed: bool = False) -> DataFrame:
    """Points inside spans of the same keys: ``start <= at < end`` (``<= end`` where ``closed``).

    Both sides meet in buckets of ``width`` along the axis, so the join is an
    equi-join on (keys, bucket) and a key with a third of all points spreads
    over its buckets. A span enters each bucket that it touches; a point lies
    in one, so no pair comes twice. Points or spans with a NULL bound or key
    join nothing, as in SQL. Spans may overlap. Both sides must have no other
    column in common.
    """
    b = lambda c: F.floor(c / F.lit(width)).cast("long")
    left = points.where(F.col(at).isNotNull()).withColumn("_b", b(F.col(at)))
    right = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    right = right.withColumn("_b", F.explode(F.sequence(b(F.col(start)), b(F.col(end)))))
    upper = F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end)
    return left.join(right, [*keys, "_b"]).where((F.col(at) >= F.col(start)) & upper).drop("_b")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, take: list[str], direction: str = "backward", strict: bool = False, bucket: float = 86_400e6) -> DataFrame:
    """Each left row with the nearest right row of the same keys in time.

    ``backward``: the last right row at or before; ``forward``: the first at
    or after (``strict`` leaves out equal times); ``nearest``: the closer of
    both, the earlier one on a tie. ``take`` are right columns added to the
    left row, NULL where there is no partner. Times are numbers. Of right rows
    at one time, the greatest in ``take`` counts.

    Both sides are laid together and ordered inside (keys, time bucket), one
    shuffle for both directions; the first and last right row of each bucket
    are carried to the buckets behind and before it. NULL keys and times have
    no partner, as in SQL.
    """
    one = right.where(F.col(right_time).isNotNull())
    for k in keys:
        one = one.where(F.col(k).isNotNull())
    one = one.groupBy(*keys, F.col(right_time).alias("_t")).agg(F.max(F.struct(*take)).alias("_r"))
    # At equal times the right row is met first by a look back, and last by a look forward; a strict join turns that round.
    right_side = int((direction == "forward") != strict)
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1 - right_side).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(one.schema["_r"].dataType).alias("_r"))
    b = one.select(*keys, F.col("_t").cast(a.schema["_t"].dataType).alias("_t"), F.lit(right_side).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), "_r")
    both = a.unionByName(b).withColumn("_bucket", F.floor(F.col("_t") / F.lit(bucket))).withColumn("_p", F.when(F.col("_r").isNotNull(), F.struct("_t", "_r")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side")
    back, fore = direction in ("backward", "nearest"), direction in ("forward", "nearest")
    here = both
    if back:
        here = here.withColumn("_back", F.last("_p", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    if fore:
        here = here.withColumn("_fore", F.first("_p", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)))
    has = F.when(F.col("_p").isNotNull(), F.col("_t"))
    ends = both.groupBy(*keys, "_bucket").agg(F.max_by("_p", has).alias("_last"), F.min_by("_p", has).alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_bucket")
    before = F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    carried = ends.select(*keys, "_bucket", before.alias("_cb"), behind.alias("_cf"))
    got = here.where("_l IS NOT NULL").join(carried, [*keys, "_bucket"], "left")
    at = F.col("_t")
    hit_back, hit_fore = F.coalesce("_back", "_cb") if back else None, F.coalesce("_fore", "_cf") if fore else None
    if direction == "nearest":
        nearer = hit_fore["_t"].isNull() | (at - hit_back["_t"] <= hit_fore["_t"] - at)
        hit = F.when(hit_back["_t"].isNotNull() & nearer, hit_back).otherwise(hit_fore)
    else:
        hit = hit_back if back else hit_fore
    hit = F.when(at.isNotNull(), hit)
    return got.withColumn("_hit", hit).select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], *[F.col(f"_hit._r.{c}").alias(c) for c in take])


def mutual_best(pairs: DataFrame, a: str, b: str, order: list[Column]) -> DataFrame:
    """Pairs in which each side is the other's first choice; a total ``order`` makes the result unique."""
    wa, wb = Window.partitionBy(a).orderBy(*order), Window.partitionBy(b).orderBy(*order)
    ranked = pairs.withColumn("_ra", F.row_number().over(wa)).withColumn("_rb", F.row_number().over(wb))
    return ranked.where("_ra = 1 AND _rb = 1").drop("_ra", "_rb")


def progressive_match(pairs: DataFrame, a: str, b: str, distance: str, thresholds: list[float], order: list[Column]) -> DataFrame:
    """One-to-one matching under growing thresholds: each pass takes mutual first choices among what is still free.

    ``pairs`` are candidate pairs, kept within the largest threshold by a
    blocked join. Adds ``pass_no``. A pair with a NULL end or distance never
    matches.
    """
    free = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(distance).isNotNull())
    out = None
    for i, limit in enumerate(thresholds):
        got = mutual_best(free.where(F.col(distance) <= limit), a, b, order).withColumn("pass_no", F.lit(i).cast("long"))
        out = got if out is None else out.unionByName(got)
        if i + 1 < len(thresholds):
            free = free.join(got.select(a), a, "left_anti").join(got.select(b), b, "left_anti")
    return out


def left_chain(start: DataFrame, links: list[DataFrame], key: str) -> DataFrame:
    """A chain of left joins: ``start(key)``, then each ``links[i](key, next)`` applied to the column before it."""
    out = start.select(F.col(key).alias("n0")).distinct()
    for i, link in enumerate(links):
        step = link.select(F.col(link.columns[0]).alias(f"n{i}"), F.col(link.columns[1]).alias(f"n{i + 1}"))
        out = out.join(step, f"n{i}", "left")
    return out.select(*[f"n{i}" for i in range(len(links) + 1)])


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], value: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Rows of two tables against each other: ``keys, status`` in ``only_a``, ``only_b``, ``equal``, ``close``, ``differs``.

    Two NULLs are equal, and so are two NaN.
    """
    x, y = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ia")), b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_ib"))
    both = x.join(y, keys, "full")
    status = (
        F.when(F.col("_ib").isNull(), "only_a").when(F.col("_ia").isNull(), "only_b").when(F.col("_a").eqNullSafe(F.col("_b")), "equal")
        .when(F.abs(F.col("_a") - F.col("_b")) <= atol + rtol * F.abs(F.col("_b")), "close").otherwise("differs")
    )
    return both.select(*keys, status.alias("status"))
