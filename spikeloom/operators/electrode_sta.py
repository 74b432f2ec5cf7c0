"""Electrode images: the spike-triggered average of a whole array, from a recording in chunks.

A chunk of the sensor cube is one row (see ``sources.stores``), read with an
overlap on either side. It is filtered or centred by itself, and each spike
whose window it holds adds its window to the unit's sum. Partial sums are cut
into blocks of electrodes, so what is added up in one task is a unit's window
over a block, never a recording. Sums of chunks add to each other, whatever
order they come in.

Filtered chunks can be kept: ``cached`` writes them under a key of the filter's
parameters and the source, and reads them back where key and length fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.functions import signal
from spikeloom.plans.registry import config_hash
from spikeloom.sources.writers import exists

CHUNK = "file string, start bigint, stop bigint, first bigint, shape array<int>, frames binary, dtype string"


def filtered(chunks: DataFrame, cutoff: float | None = 100.0, rate: float = 20_000.0, order: int = 2) -> DataFrame:
    """Chunks as ``float32``, high-passed along time; with ``cutoff`` None, less each electrode's mean over the chunk.

    The filter runs over the overlap too, so a chunk's own samples are free of
    its edges if the overlap outlasts the filter's ring.
    """
    if cutoff is not None and not 0 < cutoff < rate / 2:
        raise ValueError(f"a cutoff of {cutoff} Hz at {rate} Hz")
    if order < 1:
        raise ValueError("the order must be 1 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, a = signal.butterworth(order, cutoff, rate, high=True) if cutoff is not None else (None, None)
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["frames"], f"<{r['dtype']}").reshape(r["shape"]).astype(float)
                if cutoff is None:
                    x = x - x.mean(0, keepdims=True)
                elif len(x) > 3 * max(len(a), len(b)):
                    x = signal.zero_phase(b, a, x.reshape(len(x), -1).T).T.reshape(x.shape)
                yield pa.RecordBatch.from_pylist([r | {"frames": x.astype("<f4").tobytes(), "dtype": "f4"}], schema=_ARROW)

    return chunks.mapInArrow(run, CHUNK)


_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("first", pa.int64()), ("shape", pa.list_(pa.int32())), ("frames", pa.binary()), ("dtype", pa.string())])


def cached(chunks: DataFrame, folder: str, source: str, samples: int, cutoff: float | None = 100.0, rate: float = 20_000.0, order: int = 2) -> DataFrame:
    """``filtered``, kept under ``folder``: read back where source, filter and chunk layout are the same and as many samples were kept.

    A table that holds fewer samples than asked for is no hit and is written
    anew; one that holds more gives the chunks that are needed.
    """
    spark = chunks.sparkSession
    key = config_hash({"source": source, "cutoff": cutoff, "rate": rate, "order": order})
    path = f"{folder.rstrip('/')}/filtered-{key}"
    if exists(spark, path):
        kept = spark.read.parquet(path)
        if (kept.agg(F.max("stop")).first()[0] or 0) >= samples:
            return kept.where(F.col("start") < samples)
    filtered(chunks, cutoff, rate, order).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def window_sums(chunks: DataFrame, spikes: DataFrame, before: int, after: int, block: int = 256, limit: int | None = None, inside_core: bool = False) -> DataFrame:
    """``file, unit_id, block, sums, n_spikes, shape``: per unit and block of electrodes the sum of its windows.

    ``spikes`` has ``file, unit_id, sample``. A window reaches from ``before``
    samples before the spike to ``after`` behind it. A spike counts in the chunk
    that holds it if the chunk and its overlap hold the window (with
    ``inside_core`` the chunk alone has to); others are left out. ``limit``
    takes a unit's first spikes only, for the whole recording.
    """
    from pyspark.sql import Window

    own = spikes.where("sample IS NOT NULL").select("file", "unit_id", F.col("sample").cast("long").alias("sample"))
    if limit is not None:
        own = own.withColumn("_i", F.row_number().over(Window.partitionBy("file", "unit_id").orderBy("sample"))).where(F.col("_i") <= limit).drop("_i")  # Spark keeps a unit's first rows per task
    spans = chunks.select("file", "start", "stop")
    # Chunks of a file follow one another, so a spike's chunk is an as-of match.
    from spikeloom.operators.joins import asof_join

    placed = asof_join(own, spans, ["file"], "sample", "start", ["start", "stop"], bucket=1e6).where("start IS NOT NULL AND sample < stop")
    packed = placed.groupBy("file", "start").agg(F.collect_list(F.struct("unit_id", "sample")).alias("spikes"))  # the spikes of one chunk
    both = chunks.join(packed, ["file", "start"])
    width = before + after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["frames"], f"<{r['dtype']}").reshape(len(np.frombuffer(r["frames"], f"<{r['dtype']}")) // int(np.prod(r["shape"][1:])), -1).astype(float)
                lo, hi = (r["start"] - r["first"], r["stop"] - r["first"]) if inside_core else (0, len(x))
                by_unit: dict[str, list[int]] = {}
                for s in r["spikes"]:
                    by_unit.setdefault(s["unit_id"], []).append(s["sample"] - r["first"])
                rows = []
                for unit, at in by_unit.items():
                    good = [s - before for s in at if s - before >= lo and s + after <= hi]
                    if not good:
                        continue
                    total = np.zeros((width, x.shape[1]))
                    for s in good:
                        total += x[s : s + width]
                    for k in range(0, x.shape[1], block):
                        rows.append({"file": r["file"], "unit_id": unit, "block": k // block, "sums": total[:, k : k + block].ravel().tolist(), "n_spikes": len(good), "shape": [width, *r["shape"][1:]]})
                yield pa.RecordBatch.from_pylist(rows, schema=_SUMS)

    return both.mapInArrow(run, "file string, unit_id string, block int, sums array<double>, n_spikes long, shape array<int>")


_SUMS = pa.schema([("file", pa.string()), ("unit_id", pa.string()), ("block", pa.int32()), ("sums", pa.list_(pa.float64())), ("n_spikes", pa.int64()), ("shape", pa.list_(pa.int32()))])


def added(sums: DataFrame) -> DataFrame:
    """Partial sums of chunks added up: a row per unit and block. Works on sums that were added before, too."""

    def add(keys: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, shape = None, 0, None
        for part in parts:
            for s, k, sh in zip(part["sums"], part["n_spikes"], part["shape"]):
                total, n, shape = (np.array(s) if total is None else total + np.asarray(s)), n + int(k), sh
        yield pd.DataFrame([(*keys, total, n, shape)], columns=["file", "unit_id", "block", "sums", "n_spikes", "shape"])

    whole = lambda keys, part: next(add(keys, iter([part])))
    return sums.groupBy("file", "unit_id", "block").applyInPandas(whole, "file string, unit_id string, block int, sums array<double>, n_spikes long, shape array<int>")


def averages(sums: DataFrame) -> DataFrame:
    """``dataset_id, unit_id, shape, average, n_spikes``: the electrode image of each unit, time by row by column, flat."""

    def join(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        shape, n = [int(x) for x in part["shape"].iloc[0]], int(part["n_spikes"].iloc[0])
        cube = np.concatenate([np.array(s, dtype=float).reshape(shape[0], -1) for s in part["sums"]], axis=1) / n
        return pd.DataFrame([(keys[0], keys[1], shape, cube.ravel(), n)], columns=["dataset_id", "unit_id", "shape", "average", "n_spikes"])

    named = added(sums).withColumn("dataset_id", F.regexp_replace("file", r"\.(cmcr|h5|hdf5)$", ""))
    return named.groupBy("dataset_id", "unit_id").applyInPandas(join, "dataset_id string, unit_id string, shape array<int>, average array<double>, n_spikes long")


def electrode_images(chunks: DataFrame, spikes: DataFrame, before: int = 10, after: int = 40, cutoff: float | None = 100.0, rate: float = 20_000.0, order: int = 2, cache: tuple[str, str, int] | None = None, **window: object) -> DataFrame:
    """From raw chunks to a unit's electrode image; ``cache`` is the folder, source and number of samples of ``cached``."""
    clean = cached(chunks, *cache, cutoff, rate, order) if cache else filtered(chunks, cutoff, rate, order)
    return averages(window_sums(clean, spikes, before, after, **window))
