"""Grouping records into similarity clusters: grid density clustering, as SQL over counted cells.

Records are quantised onto a grid, cells are counted, dense cells are joined
to dense neighbours and the smallest label spreads until nothing changes. From
the count on, everything works on cells: their number is bounded by the grid
(``prod((hi - lo) / width)``), not by the records, so one hot cell with a third
of all records is one row after the map-side count.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.functions.keys import usable
from spikeloom.session import cut, discard


def grid_clusters(
    records: DataFrame,
    key: str,
    dims: dict[str, tuple[float, float]],
    bins: dict[str, int],
    dense_share: float = 0.0008,
    smooth: bool = True,
    min_share: float = 0.02,
    rings: int = 2,
    max_rounds: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """Clusters of records by the density of grid cells: ``members`` and ``cells``.

    ``dims`` gives each dimension's range, ``bins`` its number of cells. A
    cell's density is its share of all records, averaged with its neighbours
    (weights 1, 1/2, 1/4, ... by the number of steps) where ``smooth``. Cells of
    density ``dense_share`` or more are dense. Dense cells that touch (corners
    included) share a cluster; a sparse cell that holds records joins the
    dense neighbour of greatest density, its records are the rim of that
    cluster. So do the cells behind it, up to ``rings`` steps from a dense
    cell, each by a neighbour of the ring before it that holds records. A cluster holds at least ``min_share`` of the records; other
    records are strays.

    ``members``: ``key, cluster_key, density`` with the smallest key of the
    cluster. ``cells``: ``cell columns, n, density, label``.

    Records with a NULL key, or a dimension that is NULL, NaN or out of range,
    take no part. A key that comes more than once counts once, with the
    smallest values. Ties of density go to the smaller cell. Empty tables give
    empty results.
    """
    names = list(dims)
    ok = records.where(F.col(key).isNotNull())
    for c, (lo, hi) in dims.items():
        ok = ok.where(usable(c, lo, hi))
    points = ok.groupBy(F.col(key).alias("key")).agg(F.min(F.struct(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])).alias("v"))
    place = []
    for i, c in enumerate(names):
        lo, hi = dims[c]
        place.append(F.least(F.floor((F.col(f"v.v{i}") - lo) / (hi - lo) * bins[c]), F.lit(bins[c] - 1)).cast("int").alias(f"c{i}"))
    points = cut(points.select("key", *place), "points")

    cs = [f"c{i}" for i in range(len(names))]
    counts = points.groupBy(*cs).agg(F.count("*").alias("n"))
    offsets = list(itertools.product((-1, 0, 1), repeat=len(names)))
    step = F.explode(F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(off)], F.lit(0.5 ** sum(map(abs, off))).alias("w")) for off in offsets])).alias("o")
    moved = [(F.col(f"c{i}") + F.col(f"o.o{i}")).alias(f"c{i}") for i in range(len(names))]
    total = points.count()
    if smooth:
        spread = counts.select(*cs, "n", step).select(*moved, (F.col("n") * F.col("o.w")).alias("d"), F.when(F.col("o.w") == 1.0, F.col("n")).otherwise(0).alias("n"))
        cells = spread.groupBy(*cs).agg(F.sum("n").alias("n"), (F.sum("d") / float(2 ** len(names))).alias("d"))  # the kernel's sum
    else:
        cells = counts.withColumn("d", F.col("n").cast("double"))
    cells = cells.select(*cs, "n", (F.col("d") / float(max(total, 1))).alias("density"))
    code = F.lit(0).cast("long")
    for i, c in enumerate(names):
        code = code * (bins[c] + 2) + F.col(f"c{i}") + 1
    cells = cut(cells.where((F.col("n") > 0) | (F.col("density") >= dense_share)).withColumn("code", code), "cells")

    dense = cells.where(F.col("density") >= dense_share)
    around = [o for o in offsets if any(o)]
    hop = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in around])).alias("o")
    reach = dense.select("code", *cs, hop).select(F.col("code").alias("from"), *moved)
    links = cut(reach.join(dense.select(*cs, F.col("code").alias("to")), cs).select("from", "to"), "links")
    labels = held = cut(dense.select("code", F.col("code").alias("label")), "labels")
    for _ in range(max_rounds):
        # The smallest label of a cell and its neighbours, then the label of that label: paths halve.
        near = links.join(labels, links["to"] == labels["code"]).groupBy("from").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["code"] == near["from"], "left").select("code", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        up = new.select(F.col("code").alias("new"), F.col("new").alias("up"))
        step = cut(new.join(up, "new").select("code", F.col("label").alias("was"), F.col("up").alias("label")), "labels")
        discard(held)
        held = step
        done = step.where("label <> was").limit(1).count() == 0
        labels = step.select("code", "label")
        if done:
            break
    else:
        raise RuntimeError("labels didn't settle; raise max_rounds")

    for ring in range(rings):
        marked = cells.join(labels, "code", "left")
        edge = marked.where("label IS NULL AND n > 0").select("code", *cs, hop).select("code", *moved)
        known = marked.where("label IS NOT NULL" if ring == 0 else "label IS NOT NULL AND n > 0")
        best = edge.join(known.select(*cs, "density", "label", F.col("code").alias("at")), cs).groupBy("code").agg(F.max(F.struct("density", (-F.col("at")).alias("at"), "label")).alias("b"))
        joined = marked.where("label IS NOT NULL").select("code", "label").unionByName(best.select("code", F.col("b.label").alias("label")))
        labels = cut(joined, "labels") if ring + 1 < rings else joined
    cells = cells.join(labels, "code", "left").select("code", *cs, "n", "density", "label")
    sizes = cells.where("label IS NOT NULL").groupBy("label").agg(F.sum("n").alias("size"))
    kept = sizes.where(F.col("size") >= min_share * total)
    cells = cut(cells.join(kept.select("label", "size"), "label", "left_outer").withColumn("label", F.when(F.col("size").isNotNull(), F.col("label"))), "cells")
    inside = points.join(cells.where("label IS NOT NULL").select(*cs, "label", "density"), cs)
    first = inside.groupBy("label").agg(F.min("key").alias("cluster_key"))
    return inside.join(first, "label").select("key", "cluster_key", "density"), cells
