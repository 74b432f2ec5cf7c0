"""Irregular readings onto a regular grid, by compact-kernel local regression.

Every bin between a source's first and last filled bin gets one row. The value
at a bin's centre is a local linear fit of the nearby readings under the kernel
``w(d) = 1 - (d / h)^2``, ``h = bandwidth_bins + 1/2`` bins, which is zero
outside the bins that it spans. Because the kernel is a polynomial on whole
bins, all that the fit needs are sums of powers per bin, so each reading is
touched once and each grid bin reads at most ``2 * bandwidth_bins + 1`` rows.

Layout: a source's time line is cut into chunks of ``chunk_bins`` bins, and
rows are partitioned by (source, chunk), never by source alone, so a source
with a third of all rows spreads over as many tasks as it has chunks. Readings
within ``bandwidth_bins`` of a chunk's edge are copied to the neighbour. Chunks
are counted first; the readings of a chunk that holds more than ``hot_rows`` of
them are spread by time and reduced to power sums per bin before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikeloom.functions.keys import usable
from spikeloom.session import cut


LAST_BIN = 2.0**53  #: bins beyond can't be told apart


def _shifted(m: list[Column], g: Column, p: int) -> Column:
    """The sum of (x - g)^p from the sums of x^0..x^p."""
    binomial = {0: [1], 1: [1, 1], 2: [1, 2, 1], 3: [1, 3, 3, 1], 4: [1, 4, 6, 4, 1]}[p]
    out = None
    for k, c in enumerate(binomial):
        term = F.lit(float(c * (-1) ** (p - k))) * m[k]
        for _ in range(p - k):
            term = term * g
        out = term if out is None else out + term
    return out


def regular_grid(
    readings: DataFrame,
    source: str,
    time: str,
    value: str,
    step: float,
    newest: tuple[str, ...] = (),
    bandwidth_bins: int = 2,
    min_support: float = 2.0,
    chunk_bins: int = 32,
    hot_rows: int = 2_000_000,
) -> DataFrame:
    """One row per source and bin from the source's first to its last filled bin.

    ``source`` is a long column, ``bin_no = floor(time / step)``.

    Output: ``source_key, bin_no, n_readings, support, value, status``.
    ``support`` is the effective number of readings under the kernel,
    ``(sum w)^2 / sum w^2``; readings of less than a hundredth of the kernel's
    peak together, at its very edge, give none. ``status`` is ``observed`` where the bin holds a
    reading, ``filled`` where it holds none but the support is at least
    ``min_support``, else ``missing`` (value NULL).

    Nulls: rows without source, or whose time or value is NULL, NaN or
    negative, or whose time is infinite or behind bin ``LAST_BIN``, are no
    readings. Repeated rows and ties: of readings of one
    source at one time, the one greatest in the ``newest`` columns counts, then
    the greatest value. An empty table gives an empty grid. Other columns of
    the input, whatever their names, are ignored.
    """
    t, y = F.col(time), F.col(value)
    ok = readings.where(F.col(source).isNotNull() & usable(time) & (t < float("inf")) & (t < LAST_BIN * step) & usable(value))
    bin_no = F.floor(t / F.lit(step)).cast("long")
    rows = ok.select(
        F.col(source).cast("long").alias("source_key"),
        bin_no.alias("b"),
        (t / F.lit(step)).cast("double").alias("x"),
        F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(newest)], y.cast("double").alias("y")).alias("r"),
    )

    # One marker per (source, chunk) tells which bins the chunk has to report.
    k, size = bandwidth_bins, chunk_bins
    chunk = lambda b: F.floor(b / F.lit(size)).cast("long")
    counted = cut(rows.groupBy("source_key", chunk(F.col("b")).alias("chunk")).agg(F.count("*").alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi")), "chunks")
    hot = counted.where(F.col("n") > hot_rows).select("source_key", "chunk")
    spans = counted.groupBy("source_key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Chunks unfold in two steps, so that no row holds an array of more than a block of them, however far a source's times spread.
    block = lambda c: F.floor(c / F.lit(4096)).cast("long")
    blocks = spans.select("source_key", "lo", "hi", F.explode(F.sequence(block(chunk(F.col("lo"))), block(chunk(F.col("hi"))))).alias("block"))
    inside = F.sequence(F.greatest(chunk(F.col("lo")), F.col("block") * 4096), F.least(chunk(F.col("hi")), F.col("block") * 4096 + 4095))
    markers = blocks.select("source_key", "lo", "hi", F.explode(inside).alias("chunk")).select(
        "source_key", "chunk", F.greatest("lo", F.col("chunk") * size).alias("from"),
        F.least("hi", F.col("chunk") * size + size - 1).alias("to"),
    )

    homes = F.explode(F.array_distinct(F.array(chunk(F.col("b") - k), chunk(F.col("b")), chunk(F.col("b") + k)))).alias("chunk")
    # Powers count from the chunk's middle, which keeps them small and the sums exact enough.
    middle = (F.col("chunk") * size).cast("double") + size / 2
    local, yy = F.col("x") - middle, F.col("r.y")
    power = lambda p: F.lit(1.0) if p == 0 else local if p == 1 else power(p - 1) * local
    sums = [F.coalesce(F.sum(F.when(F.col("x").isNotNull(), power(p))), F.lit(0.0)).alias(f"m{p}") for p in range(5)]
    sums += [F.coalesce(F.sum(power(p) * yy), F.lit(0.0)).alias(f"y{p}") for p in range(4)]
    sums = [F.count("x").alias("n"), F.max(F.col("x").isNull()).alias("grid"), *sums]

    any_hot = hot.limit(1).count() > 0
    home = rows.withColumn("home", chunk(F.col("b"))) if any_hot else rows
    on = hot.select("source_key", F.col("chunk").alias("home"))
    calm = home.join(on, ["source_key", "home"], "left_anti").drop("home") if any_hot else rows
    kind = rows.schema["r"].dataType.simpleString()
    moved = calm.select("source_key", homes, "b", "x", "r", F.lit(None).cast("long").alias("to"))
    marked = markers.select("source_key", "chunk", F.col("from").alias("b"), F.lit(None).cast("double").alias("x"), F.lit(None).cast(kind).alias("r"), "to")
    placed = moved.unionByName(marked).repartition("source_key", "chunk")

    # After the one shuffle: a marker unfolds to its bins, repeats at one time collapse, bins get their power sums.
    bins = F.when(F.col("to").isNotNull(), F.sequence("b", "to")).otherwise(F.array("b"))
    single = placed.select("source_key", "chunk", F.explode(bins).alias("b"), "x", "r").groupBy("source_key", "chunk", "b", "x").agg(F.max("r").alias("r"))
    per_bin = single.groupBy("source_key", "chunk", "b").agg(*sums)
    if any_hot:
        crowd = home.join(on, ["source_key", "home"], "left_semi").groupBy("source_key", "b", "x").agg(F.max("r").alias("r"))
        crowd = crowd.select("source_key", homes, "b", "x", "r").groupBy("source_key", "chunk", "b").agg(*sums)
        both = [F.sum(c).alias(c) for c in per_bin.columns if c not in ("source_key", "chunk", "b", "grid")]
        per_bin = per_bin.unionByName(crowd).groupBy("source_key", "chunk", "b").agg(F.max("grid").alias("grid"), *both)

    near = Window.partitionBy("source_key", "chunk").orderBy("b").rangeBetween(-k, k)
    wide = per_bin.select("source_key", "chunk", "b", "n", "grid", *[F.sum(c).over(near).alias(c) for c in [f"m{p}" for p in range(5)] + [f"y{p}" for p in range(4)]])
    wide = wide.where("grid")
    g = F.col("b").cast("double") + 0.5 - middle
    m, ty = [F.col(f"m{p}") for p in range(5)], [F.col(f"y{p}") for p in range(4)]
    h2 = (k + 0.5) ** 2
    d = wide.select("source_key", "b", "n", *[_shifted(m, g, p).alias(f"d{p}") for p in range(5)], *[_shifted(ty, g, p).alias(f"t{p}") for p in range(4)])
    s0, s1, s2 = (F.col(f"d{p}") - F.col(f"d{p + 2}") / h2 for p in range(3))
    e0, e1 = (F.col(f"t{p}") - F.col(f"t{p + 2}") / h2 for p in range(2))
    sq = F.col("d0") - 2 * F.col("d2") / h2 + F.col("d4") / (h2 * h2)
    d = d.select("source_key", "b", "n", s0.alias("s0"), s1.alias("s1"), s2.alias("s2"), e0.alias("e0"), e1.alias("e1"), sq.alias("sq"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    held = F.col("s0") >= 0.01
    fit = F.when(held & (det > 1e-6 * F.col("s0") * F.col("s0")), (F.col("s2") * F.col("e0") - F.col("s1") * F.col("e1")) / det).when(held, F.col("e0") / F.col("s0"))
    support = F.when(held, F.col("s0") * F.col("s0") / F.col("sq")).otherwise(0.0)
    out = d.select("source_key", F.col("b").alias("bin_no"), F.col("n").alias("n_readings"), support.alias("support"), fit.alias("fit"))
    status = F.when(F.col("n_readings") > 0, "observed").when((F.col("support") >= min_support - 1e-6) & F.col("fit").isNotNull(), "filled").otherwise("missing")
    return out.select(
        "source_key", "bin_no", "n_readings", "support",
        F.when(status != "missing", F.greatest(F.col("fit"), F.lit(0.0))).alias("value"), status.alias("status"),
    )


def event_rates(events: DataFrame, source: str, time: str, step: float, same: tuple[str, ...] = ()) -> DataFrame:
    """Point events as one reading per filled bin: events per unit of time, at the bin's centre.

    Events equal in ``source``, ``time`` and the ``same`` columns count once.
    Rows without source, or with a NULL, NaN, negative or infinite time, are no events.
    """
    ok = events.where(F.col(source).isNotNull() & usable(time) & (F.col(time) < float("inf")) & (F.col(time) < LAST_BIN * step))
    cols = [F.col(source).cast("long").alias("source_key"), F.col(time).cast("double").alias("t")]
    once = ok.select(*cols, *[F.col(c).alias(f"same{i}") for i, c in enumerate(same)]).distinct()
    b = F.floor(F.col("t") / F.lit(step)).cast("long")
    counts = once.groupBy("source_key", b.alias("b")).agg(F.count("*").alias("n"))
    return counts.select("source_key", ((F.col("b") + 0.5) * F.lit(step)).alias("time"), (F.col("n") / F.lit(float(step))).alias("value"))
