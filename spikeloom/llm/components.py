"""Consolidating pairwise matches into groups: union-find in edge partitions, forests merged level by level.

Every level cuts the edges into partitions of at most ``bound`` edges, runs
union-find inside each and keeps only the spanning forest as stars
``(node, root)``. Levels repeat on the forests until they fit one bounded
partition, whose union-find gives the global groups. Where forests stop
shrinking (more linked nodes than fit one partition), each level first rewires
every node to its smallest neighbour (a large-star and a small-star step, both
plain joins and aggregates), which pulls the parts of a group together, and
the levels end when all stars are whole.

Partitions take edges by a hash of both ends, so a node with a third of all
edges spreads over all partitions. No group is ever gathered as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.session import cut, discard


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges ``a-b``: every node that isn't the smallest of its tree, with the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)].tolist(), at[len(a) :].tolist()
    parent = list(range(len(nodes)))
    for x, y in zip(left, right):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:  # nodes are in order, so the smallest stays root
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.asarray(parent, dtype=np.int64)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        node, root = forest_of(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))
        for k in range(0, len(node), 65536):
            yield pa.record_batch([pa.array(node[k : k + 65536]), pa.array(root[k : k + 65536])], names=["a", "b"])


def _merged(edges: DataFrame, parts: int) -> DataFrame:
    placed = edges.select("a", "b").repartition(parts, "a", "b") if parts > 1 else edges.select("a", "b").coalesce(1)
    return placed.mapInArrow(_forests, "a long, b long")


def _rewired(stars: DataFrame) -> DataFrame:
    """A large-star step, then a small-star step: connectivity stays, parts of a group meet at small nodes."""
    both = stars.select("a", "b").unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    large = cut(large, "large-star")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.a", "e.b").where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str, bound: int = 1_000_000) -> DataFrame:
    """The group of every node with an edge: ``node, group_key``, the smallest node of its group.

    ``a`` and ``b`` are longs. Edges with a NULL end and edges of a node to
    itself link nothing; a node that has only such edges doesn't come out.
    Repeated edges and either direction mean the same. An empty table gives an
    empty result. ``bound`` is the number of edges one task may hold.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (x != y))
    # a is the larger end: the smaller one is the candidate root.
    clean = clean.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    level = cut(clean, "edges")
    n = level.count()
    parts = max(-(-n // bound), level.sparkSession.sparkContext.defaultParallelism if n > bound // 10 else 1)
    stars = cut(_merged(level, parts), "forest") if parts > 1 else level
    n = stars.count() if parts > 1 else n
    while n > bound:
        roots = stars.groupBy("a").agg(F.count_distinct("b").alias("k"))
        loose = roots.where("k > 1").limit(1).count() + stars.select(F.col("b").alias("a")).join(roots.select("a"), "a", "left_semi").limit(1).count()
        if not loose:  # every node has one root and no root has another: the stars are the groups
            whole = stars
            break
        merged = cut(_merged(_rewired(stars), -(-n // bound)), "forest")
        discard(stars)
        stars = merged
        n = stars.count()
    else:
        whole = cut(_merged(stars, 1), "forest")
        discard(stars)
    discard(level)
    grouped = whole.select(F.col("a").alias("node"), F.col("b").alias("group_key"))
    return grouped.unionAll(whole.select(F.col("b").alias("node"), F.col("b").alias("group_key")).distinct()).distinct()
