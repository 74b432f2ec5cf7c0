"""Event counts and rates on fixed and irregular bins, and reshaping of trial traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikeloom.operators.joins import asof_join
from spikeloom.operators.ordered import with_previous


def fixed_bin_rates(events: DataFrame, spans: DataFrame, keys: list[str], time: str, length: str, step: float) -> DataFrame:
    """Dense rates: every bin of ``step`` from 0 to ``ceil(length / step)`` of each span, zero where nothing lies.

    ``spans`` has a row per key with its ``length``; ``keys, bin_no, n, rate``.
    An event at the very end of the last bin counts there. Counts are made
    before the join with the bins, so what is shuffled is at most a row per
    filled bin.
    """
    last = (F.ceil(F.col(length) / F.lit(step)) - 1).cast("long")
    at = F.floor(F.col(time) / F.lit(step)).cast("long")
    on_edge = F.count_if(F.col(time) == at * F.lit(step))
    counts = events.where(F.col(time) >= 0).groupBy(*keys, at.alias("_bin")).agg(F.count("*").alias("_all"), on_edge.alias("_edge"))
    ends = spans.select(*keys, last.alias("_last"), F.col(length).alias("_len")).where("_last >= 0")
    closing = (F.col("_bin") == F.col("_last") + 1) & (F.col("_bin") * F.lit(step) == F.col("_len"))
    exact = counts.join(ends, keys).withColumn("bin_no", F.when(closing, F.col("_last")).otherwise(F.col("_bin"))).withColumn("_n", F.when(closing, F.col("_edge")).otherwise(F.col("_all")))
    exact = exact.where("bin_no <= _last").groupBy(*keys, "bin_no").agg(F.sum("_n").alias("_n"))
    grid = ends.withColumn("bin_no", F.explode(F.sequence(F.lit(0).cast("long"), "_last"))).select(*keys, "bin_no")
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
    return grid.join(exact, [*keys, "bin_no"], "left").select(*keys, "bin_no", n.alias("n"), (n / F.lit(float(step))).alias("rate"))


def interval_rates(events: DataFrame, edges: DataFrame, keys: list[str], time: str, edge: str, bucket: float) -> DataFrame:
    """Counts between consecutive irregular edges: ``keys, edge_start, edge_end, n``; the last edge closes the last bin.

    An as-of join gives each event the last edge at or before it. Events
    outside the edges belong to no bin; repeated edges are one.
    """
    once = edges.where(F.col(edge).isNotNull()).select(*keys, F.col(edge).alias("edge_start")).distinct()
    back = once.withColumn("_o", -F.col("edge_start"))
    bins = with_previous(back, keys, ["_o"], F.floor(F.col("_o") / F.lit(bucket)), F.col("edge_start"), "edge_end").where("edge_end IS NOT NULL").drop("_o")
    last = once.groupBy(*keys).agg(F.max("edge_start").alias("_end"))
    # The very last edge counts into the bin before it: its events move to that bin's start.
    moved = events.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_t")).join(last, keys)
    placed = asof_join(moved, bins, keys, "_t", "edge_start", ["edge_start", "edge_end"], bucket=bucket)
    inside = placed.where("edge_start IS NOT NULL AND (_t < edge_end OR (_t = edge_end AND _t = _end))")
    n = inside.groupBy(*keys, "edge_start").agg(F.count("*").alias("n"))
    return bins.join(n, [*keys, "edge_start"], "left").select(*keys, "edge_start", "edge_end", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mode_value(df: DataFrame, by: list[str], value: str, out: str = "mode") -> DataFrame:
    """The most frequent value per group; the smallest of several."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("_n", (-F.col(value)).alias("v"))).alias(out))


def pad_or_trim(trace: Column, length: int | Column, fill: float = 0.0) -> Column:
    """The trace cut or filled at its end to ``length`` samples."""
    n = F.lit(length) if isinstance(length, int) else length
    padded = F.concat(trace, F.array_repeat(F.lit(fill), F.greatest(n - F.size(trace), F.lit(0))))
    return F.slice(padded, 1, n)


def stack_trials(df: DataFrame, keys: list[str], trial: str, trace: str, out: str = "trials") -> DataFrame:
    """One row per key: its trials in order, all cut to the shortest.

    A row holds all trials of a key, so ``keys`` have to name a unit and a
    movie, whose trials are as many as the stimulus has; for anything that
    grows with the data aggregate instead.
    """
    got = df.where(F.col(trace).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(trial, trace))).alias("_t"), F.min(F.size(trace)).alias("_n"))
    return got.select(*keys, F.transform("_t", lambda x: F.slice(x[trace], 1, F.col("_n"))).alias(out))


def time_course(events: DataFrame, keys: list[str], file_order: str, time: str, duration: str, step: float) -> DataFrame:
    """Rates over recordings laid end to end, each after the real duration of those before it: ``keys, bin_no, n, rate``."""
    files = events.groupBy(*keys, file_order).agg(F.max(duration).alias("_dur"))
    w = Window.partitionBy(*keys).orderBy(file_order).rowsBetween(Window.unboundedPreceding, -1)
    offs = files.withColumn("_off", F.coalesce(F.sum("_dur").over(w), F.lit(0.0))).drop("_dur")
    at = events.join(offs, [*keys, file_order]).withColumn("_b", F.floor((F.col(time) + F.col("_off")) / F.lit(step)).cast("long"))
    return at.where(F.col("_b") >= 0).groupBy(*keys, F.col("_b").alias("bin_no")).agg(F.count("*").alias("n")).withColumn("rate", F.col("n") / F.lit(float(step)))
