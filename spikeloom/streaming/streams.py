"""Structured Streaming forms: tumbling rates, incremental ingest, running averages, and sessions by distance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling_rates(events: DataFrame, keys: list[str], time: str, width: str, late: str) -> DataFrame:
    """Event counts per key and window; a window closes when the watermark ``late`` passes it."""
    at = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(*keys, F.window("_at", width).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows whose keys haven't been seen within the watermark: the incremental form of the union that keeps the first."""
    at = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return at.dropDuplicatesWithinWatermark(keys).drop("_at")


def running_sums(parts: DataFrame, by: list[str]) -> DataFrame:
    """Partial sums of chunks as they arrive; for the update or complete mode."""
    return parts.groupBy(*by).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def islands(events: DataFrame, key: str, time: str, max_gap_us: int, late: str = "0 seconds") -> DataFrame:
    """Runs of events whose steps are ``max_gap_us`` at most: a row per finished run, of stateful keys.

    A run is finished when the watermark (``late`` behind the latest event) has
    passed its end by the gap; then its state goes. So the last run of a key
    comes out as well, as soon as time goes on anywhere. Events behind the watermark are dropped.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        runs = list(map(tuple, state.get[0])) if state.exists else []
        for b in batches if not state.hasTimedOut else ():
            for t in b["t"].sort_values().tolist():
                # Events of a batch come in order; those of the next one may lie before, so runs are kept apart until time has passed them.
                near = [r for r in runs if r[0] - max_gap_us <= t <= r[1] + max_gap_us]
                runs = [r for r in runs if r not in near] + [(min([t, *[r[0] for r in near]]), max([t, *[r[1] for r in near]]), 1 + sum(r[2] for r in near))]
        passed = state.getCurrentWatermarkMs() * 1000
        done = [r for r in runs if r[1] + max_gap_us < passed]
        runs = [r for r in runs if r[1] + max_gap_us >= passed]
        if runs:
            state.update(([list(r) for r in runs],))
            state.setTimeoutTimestamp(max(min(r[1] for r in runs) + max_gap_us, state.getCurrentWatermarkMs() * 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(keys[0], *r) for r in sorted(done)], columns=["key", "run_start", "run_end", "n_rows"])

    rows = events.where(F.col(time).isNotNull()).withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    rows = rows.select(F.col(key).cast("long").alias("key"), F.unix_micros("_at").alias("t"), "_at")
    return rows.groupBy("key").applyInPandasWithState(step, "key long, run_start long, run_end long, n_rows long", "runs array<array<long>>", "append", "EventTimeTimeout")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what there is into a Parquet table and stop; a second run goes on from the checkpoint."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
