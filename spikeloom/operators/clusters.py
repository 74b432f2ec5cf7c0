"""Clustering of feature vectors: diagonal mixtures, model choice, principal components, stability.

A fit sees all rows: each step of EM is one aggregate of responsibilities and
weighted moments, whose size is components times dimensions, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.session import cut

MAX_CLUSTERS = 1000

from spikeloom.functions import arrays


@dataclass
class DiagonalMixture:
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    log_likelihood: float = float("nan")
    n: int = 0

    @property
    def parameters(self) -> int:
        k, d = self.mean.shape
        return 2 * k * d + k - 1

    def bic(self) -> float:
        return -2 * self.log_likelihood * self.n + self.parameters * math.log(max(self.n, 1))

    def aic(self) -> float:
        return -2 * self.log_likelihood * self.n + 2 * self.parameters

    def log_densities(self, dims: list[str]) -> list[Column]:
        out = []
        for k in range(len(self.weight)):
            c = F.lit(math.log(max(float(self.weight[k]), 1e-300)))
            for d, name in enumerate(dims):
                m, v = float(self.mean[k, d]), float(self.var[k, d])
                c = c - ((F.col(name) - m) * (F.col(name) - m) / v + math.log(2 * math.pi * v)) / 2
            out.append(c)
        return out


def _scored(df: DataFrame, dims: list[str], mix: DiagonalMixture) -> DataFrame:
    k = len(mix.weight)
    d = df.select("*", *[c.alias(f"_l{i}") for i, c in enumerate(mix.log_densities(dims))])
    top = F.greatest(*[F.col(f"_l{i}") for i in range(k)]) if k > 1 else F.col("_l0")
    d = d.withColumn("_top", top)
    total = sum((F.exp(F.col(f"_l{i}") - F.col("_top")) for i in range(k)), F.lit(0.0))
    d = d.withColumn("_lse", F.col("_top") + F.log(total))
    return d.withColumns({f"_r{i}": F.exp(F.col(f"_l{i}") - F.col("_lse")) for i in range(k)})


def _em_sums(x: np.ndarray, mix: DiagonalMixture) -> np.ndarray:
    """The E-step over rows: per component its weight, sums and square sums; at the end the log-likelihood."""
    logs = np.log(mix.weight + 1e-300) - 0.5 * (((x[:, None, :] - mix.mean) ** 2) / mix.var + np.log(2 * np.pi * mix.var)).sum(2)
    top = logs.max(1, keepdims=True)
    whole = top[:, 0] + np.log(np.exp(logs - top).sum(1))
    r = np.exp(logs - whole[:, None])
    return np.concatenate([r.sum(0), (r.T @ x).ravel(), (r.T @ x**2).ravel(), [whole.sum()]])


def _em_step(rows: DataFrame, dims: list[str], mix: DiagonalMixture) -> np.ndarray:
    width = len(mix.weight) * (1 + 2 * len(dims)) + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += _em_sums(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).astype(float), mix)
        yield pa.record_batch([pa.array(range(width)), pa.array(total)], names=["i", "s"])

    out = np.zeros(width)
    for r in rows.mapInArrow(scan, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # a row per sum
        out[r.i] = r.s
    return out


def fit_mixture(df: DataFrame, dims: list[str], k: int, seed: int = 42, reg: float = 1e-3, max_steps: int = 60, tol: float = 1e-4, n_init: int = 1) -> DiagonalMixture:
    """A mixture of ``k`` diagonal Gaussians over complete rows, by EM; of ``n_init`` starts the likeliest.

    Starts at ``k`` rows spread by k-means++ over a hash-ordered set of at most
    ``256 * k`` rows (a bound on the start only; every step sees all rows). The
    rows are written once; a step is one pass over them in Arrow batches.
    """
    rows = cut(df.dropna(subset=dims).select(*[F.col(c).cast("double").alias(c) for c in dims]), "mixture")
    s = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in dims], *[F.var_pop(c).alias(f"v_{c}") for c in dims]).first()
    n = s["n"]
    if n == 0:
        raise ValueError("no complete rows")
    scale = np.sqrt([max(s[f"v_{c}"], 1e-12) for c in dims])
    best = None
    for start_no in range(n_init):
        own = seed + start_no
        start = np.array([tuple(r) for r in rows.select(*dims).orderBy(F.xxhash64(*dims, F.lit(own)), *dims).limit(256 * k).collect()], dtype=float)
        rng = np.random.default_rng(own)
        centres = [start[0]]
        for _ in range(k - 1):
            gap = np.min([(((start - c) / scale) ** 2).sum(1) for c in centres], axis=0)
            centres.append(start[rng.choice(len(start), p=gap / gap.sum())] if gap.sum() > 0 else start[rng.integers(len(start))])
        mix = DiagonalMixture(np.full(k, 1 / k), np.array(centres), np.tile(scale**2 + reg, (k, 1)), n=n)
        before = -math.inf
        for _ in range(max_steps):
            got = _em_step(rows, dims, mix)
            nk, sx, sq = got[:k] + 1e-10, got[k : k + k * len(dims)].reshape(k, -1), got[k + k * len(dims) : -1].reshape(k, -1)
            mix.weight, mix.mean = nk / n, sx / nk[:, None]
            mix.var = np.maximum(sq / nk[:, None] - mix.mean**2, 0.0) + reg
            mix.log_likelihood = float(got[-1]) / n
            if mix.log_likelihood - before < tol:
                break
            before = mix.log_likelihood
        if best is None or mix.log_likelihood > best.log_likelihood:
            best = mix
    return best


def assign(df: DataFrame, dims: list[str], mix: DiagonalMixture) -> DataFrame:
    """Adds ``cluster`` (the likeliest, the first of equals) and ``posterior``; NULL where a dimension is."""
    k = len(mix.weight)
    d = _scored(df, dims, mix)
    best = F.greatest(*[F.col(f"_r{i}") for i in range(k)]) if k > 1 else F.col("_r0")
    label = F.coalesce(*[F.when(F.col(f"_r{i}") == best, F.lit(i)) for i in range(k)])
    whole = F.lit(True)
    for c in dims:
        whole = whole & F.col(c).isNotNull()
    return d.select(*df.columns, F.when(whole, label).cast("long").alias("cluster"), F.when(whole, best).alias("posterior"))


def bic_curve(df: DataFrame, dims: list[str], ks: list[int], seed: int = 42) -> list[tuple[int, float, float]]:
    """``k, bic, aic`` for each number of components."""
    fits = [(k, fit_mixture(df, dims, k, seed)) for k in ks]
    return [(k, m.bic(), m.aic()) for k, m in fits]


def choose_k(curve: list[tuple[int, float]], how: str = "bayes", least: float = 6.0, elbow: float = 0.01) -> int:
    """The number of components: by ``bayes`` factors, ``min`` or ``elbow``."""
    ks, bic = [k for k, *_ in curve], [b for _, b, *_ in curve]
    low = ks[int(np.argmin(bic))]
    if how == "min":
        return low
    if how == "elbow":
        for i in range(1, len(bic)):
            if (bic[i - 1] - bic[i]) / abs(bic[i - 1]) < elbow:
                return ks[i - 1]
        return low
    for i in range(len(bic) - 1):
        if -0.5 * (bic[i + 1] - bic[i]) < least:
            return ks[i]
    return low


def standardized(df: DataFrame, dims: list[str], by: list[str] | None = None) -> DataFrame:
    """Population z-scores, over all rows or per group; a constant dimension becomes zeros."""
    keys = by or []
    stats = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in dims], *[F.stddev_pop(c).alias(f"_s_{c}") for c in dims])
    joined = df.join(F.broadcast(stats)) if not keys else df.join(stats, keys, "left")  # without keys: one row
    return joined.withColumns({c: F.when(F.col(f"_s_{c}") > 1e-12, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.when(F.col(c).isNotNull(), 0.0)) for c in dims}).drop(*[f"_m_{c}" for c in dims], *[f"_s_{c}" for c in dims])


def moments(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """``cluster, dim, mean, sd``: mean and population deviation of each dimension of a vector, per cluster."""
    return df.select(cluster, F.posexplode(vector).alias("dim", "_v")).groupBy(cluster, "dim").agg(F.avg(F.col("_v").cast("double")).alias("mean"), F.stddev_pop(F.col("_v").cast("double")).alias("sd"))


def covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (population) of a vector column, from summed Gram matrices per task; NULL vectors are left out."""
    import pandas as pd

    def grams(batches):
        total = None
        for pdf in batches:
            x = pdf[vector].dropna()
            if not len(x):
                continue
            x = np.stack(x.to_numpy()).astype(float)
            part = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"g": [total]})

    parts = df.select(F.col(vector).cast("array<double>").alias(vector)).mapInPandas(grams, "g array<double>")
    # Position by position, the sum over tasks.
    rows = parts.select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()  # dimensions squared
    if not rows:
        raise ValueError("no vectors")
    g = np.array([r.v for r in rows])
    d = int((math.sqrt(1 + 4 * (len(g) - 1)) - 1) / 2)
    n, m = g[0], g[1 : d + 1] / g[0]
    return m, g[d + 1 :].reshape(d, d) / n - np.outer(m, m)


def principal_components(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (rows, sign fixed by the largest weight) and explained shares, from one pass."""
    m, cov = covariance(df, vector)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1][:k]
    comp = vec[:, order].T
    comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(1)])[:, None]
    return m, comp, np.maximum(val[order], 0) / max(val.sum(), 1e-300)


def hard_sparse(components: np.ndarray, k: int) -> np.ndarray:
    """Each component with only its ``k`` greatest weights, to length 1; a component of zeros stays."""
    keep = np.argsort(-np.abs(components), axis=1, kind="stable")[:, :k]
    out = np.zeros_like(components)
    np.put_along_axis(out, keep, np.take_along_axis(components, keep, 1), 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def project(vector: Column, mean: np.ndarray, components: np.ndarray) -> Column:
    """The coordinates of a vector on components, in the JVM."""
    centre = F.array(*[F.lit(float(x)) for x in mean])
    diff = F.zip_with(vector, centre, lambda a, b: a - b)
    return F.array(*[arrays.dot(diff, F.array(*[F.lit(float(x)) for x in c])) for c in components])


def kmeans(df: DataFrame, dims: list[str], k: int, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` by k-means; rows with a NULL dimension are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vec = VectorAssembler(inputCols=dims, outputCol="_vec", handleInvalid="skip").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="_vec", predictionCol="cluster").fit(vec)
    return model.transform(vec).drop("_vec")


def match_centres(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float]]:
    """Greedy one-to-one matching of centres by correlation, the highest first; NaN counts as 0."""
    x = a - a.mean(1, keepdims=True)
    y = b - b.mean(1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.nan_to_num((x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)))
    out = []
    r = r.copy()
    for _ in range(min(r.shape)):
        i, j = np.unravel_index(int(r.argmax()), r.shape)
        out.append((int(i), int(j), float(r[i, j])))
        r[i, :] = r[:, j] = -np.inf
    return out


def stability(df: DataFrame, dims: list[str], key: str, k: int, rounds: int = 20, share: float = 0.9, seed: int = 42) -> tuple[float, float]:
    """Mean and deviation of the median centre correlation between a reference fit and fits on seeded subsamples without replacement."""
    ref = fit_mixture(df, dims, k, seed).mean
    got = []
    for r in range(rounds):
        part = df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed + r)), F.lit(10_000)) < int(share * 10_000))
        got.append(float(np.median([c for _, _, c in match_centres(ref, fit_mixture(part, dims, k, seed + r).mean)])))
    return float(np.mean(got)), float(np.std(got))


def centre_silhouette(df: DataFrame, dims: list[str], cluster: str) -> DataFrame:
    """The silhouette of squared Euclidean distances, exact over all rows in two passes: ``cluster, silhouette``.

    The mean squared distance of a point to a cluster follows from the
    cluster's size, sum and sum of squares, so no pair is formed.
    """
    have = df.where(F.col(cluster).isNotNull())
    square = sum((F.col(c) * F.col(c) for c in dims), F.lit(0.0))
    per = have.groupBy(cluster).agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in dims]).alias("s"), F.sum(square).alias("q"))
    # All clusters' sums go to every row: their number is small by nature, and checked.
    if per.limit(MAX_CLUSTERS + 1).count() > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    every = per.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "n", "s", "q")).alias("all"))
    rows = have.join(F.broadcast(every)).withColumn("_x", F.array(*dims)).withColumn("_sq", square)  # one row of at most MAX_CLUSTERS sums
    inner = lambda r: F.aggregate(F.zip_with("_x", r["s"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    total = lambda r: r["n"] * F.col("_sq") + r["q"] - 2 * inner(r)
    own = F.get(F.filter("all", lambda r: r["c"] == F.col(cluster)), 0)
    near = F.array_min(F.transform(F.filter("all", lambda r: r["c"] != F.col(cluster)), lambda r: total(r) / r["n"]))
    rows = rows.select(cluster, F.when(own["n"] > 1, total(own) / (own["n"] - 1)).alias("a"), near.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return rows.groupBy(cluster).agg(F.avg(s).alias("silhouette"))
