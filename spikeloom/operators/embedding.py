"""Embeddings and soft clusters, trained where the rows are.

Models are small; rows are many. A training step sends the parameters to the
tasks, each of which sums gradients over its Arrow batches, and brings back one
sum per parameter; the driver applies them. So no row leaves its task, and any
number of rows trains in the memory of one batch.

``SegmentAutoencoder`` has an encoder and decoder of one hidden layer per
segment; the latent parts laid end to end are a row's embedding. With labels a
supervised contrastive term pulls rows of a label together, inside batches.
``soft_assignment`` is Student's t around centres, ``refine`` sharpens it
against its own target distribution and moves centres (and, if asked, the
encoder) down the divergence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.session import cut


def _summed(rows: DataFrame, columns: list[str], kernel, width: int) -> np.ndarray:
    """The sum over all rows of ``kernel(batch columns)``, a vector of ``width``; one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += kernel([b.column(i) for i in range(b.num_columns)])
        yield pa.record_batch([pa.array(range(width)), pa.array(total)], names=["i", "s"])

    out = np.zeros(width)
    for r in rows.select(*columns).mapInArrow(scan, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # a row per parameter
        out[r.i] = r.s
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
    return flat.reshape(len(column), -1)


@dataclass
class SegmentAutoencoder:
    """Per segment: input length, hidden size and latent size. Parameters are one vector per segment."""

    shapes: dict[str, tuple[int, int, int]]
    params: dict[str, list[np.ndarray]] = field(default_factory=dict)
    history: list[float] = field(default_factory=list)

    @classmethod
    def create(cls, lengths: dict[str, int], latent: dict[str, int], hidden: int = 32, seed: int = 42) -> SegmentAutoencoder:
        rng = np.random.default_rng(seed)
        out = cls({s: (n, hidden, latent[s]) for s, n in lengths.items()})
        for s, (n, h, z) in out.shapes.items():
            out.params[s] = [x for a, b in ((n, h), (h, z), (z, h), (h, n)) for x in (rng.normal(0, np.sqrt(2.0 / a), (a, b)), np.zeros(b))]
        return out

    def encode(self, x: np.ndarray, segment: str) -> np.ndarray:
        w1, b1, w2, b2, *_ = self.params[segment]
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def gradients(self, segment: str, x: np.ndarray, extra=None) -> tuple[list[np.ndarray], float, np.ndarray]:
        """Summed gradients of half the mean squared reconstruction error of each row (and of ``extra``, given the latent rows), and the loss."""
        w1, b1, w2, b2, w3, b3, w4, b4 = self.params[segment]
        h1 = np.maximum(x @ w1 + b1, 0)
        z = h1 @ w2 + b2
        h2 = np.maximum(z @ w3 + b3, 0)
        miss = h2 @ w4 + b4 - x
        n = x.shape[1]
        d4 = miss / n
        d3 = (d4 @ w4.T) * (h2 > 0)
        dz = d3 @ w3.T
        if extra is not None:
            dz = dz + extra(z)
        d1 = (dz @ w2.T) * (h1 > 0)
        return [x.T @ d1, d1.sum(0), h1.T @ dz, dz.sum(0), z.T @ d3, d3.sum(0), h2.T @ d4, d4.sum(0)], float((miss**2).sum() / n / 2), z

    def columns(self) -> list[str]:
        return list(self.shapes)

    def embed(self, df: DataFrame, keys: list[str], out: str = "embedding") -> DataFrame:
        """``keys`` and the embedding; NULL where a segment is missing or of another length."""
        model = self

        def run(*cols: pd.Series) -> pd.Series:
            good = np.ones(len(cols[0]), bool)
            for c, (n, _, _) in zip(cols, model.shapes.values()):
                good &= np.array([x is not None and len(x) == n and bool(np.isfinite(x).all()) for x in c])
            rows: list = [None] * len(good)
            if good.any():
                z = np.concatenate([model.encode(np.stack(c[good].to_list()).astype(float), s) for c, s in zip(cols, model.shapes)], axis=1)
                for i, v in zip(np.flatnonzero(good), z):
                    rows[i] = v
            return pd.Series(rows, dtype=object)

        return df.select(*keys, F.pandas_udf(run, "array<double>")(*self.columns()).alias(out))


def contrastive(z: np.ndarray, labels: np.ndarray, temperature: float = 0.1) -> tuple[float, np.ndarray]:
    """The supervised contrastive loss of a batch and its gradient by the rows: rows of a label attract, all others repel. Rows without a partner add nothing."""
    norm = np.linalg.norm(z, axis=1, keepdims=True) + 1e-12
    u = z / norm
    s = u @ u.T / temperature
    np.fill_diagonal(s, -np.inf)
    top = s.max(1, keepdims=True)
    e = np.exp(s - top)
    total = e.sum(1, keepdims=True)
    soft = e / total
    same = (labels[:, None] == labels[None, :]) & ~np.eye(len(z), dtype=bool)
    k = same.sum(1, keepdims=True)
    use = k[:, 0] > 0
    log_p = np.where(same, np.where(np.isfinite(s), s, 0) - top - np.log(total), 0.0)
    loss = -(log_p.sum(1)[use] / k[use, 0]).sum()
    ds = np.where(use[:, None], soft - same / np.maximum(k, 1), 0.0)
    np.fill_diagonal(ds, 0.0)
    du = (ds + ds.T) @ u / temperature
    return float(loss), (du - u * (du * u).sum(1, keepdims=True)) / norm


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, None, None, 0

    def step(self, g: np.ndarray) -> np.ndarray:
        self.m = np.zeros_like(g) if self.m is None else self.m
        self.v = np.zeros_like(g) if self.v is None else self.v
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _unpack(model: SegmentAutoencoder, vector: np.ndarray) -> dict[str, list[np.ndarray]]:
    out, at = {}, 0
    for s, ps in model.params.items():
        out[s] = []
        for p in ps:
            out[s].append(vector[at : at + p.size].reshape(p.shape))
            at += p.size
    return out


def train_autoencoder(df: DataFrame, lengths: dict[str, int], latent: dict[str, int], label: str | None = None, steps: int = 60, rate: float = 0.01, hidden: int = 32, weight: float = 0.1, seed: int = 42, patience: int = 15) -> SegmentAutoencoder:
    """Train on whole rows (each segment of its length, all values finite). ``label`` (a string column) adds the contrastive term with ``weight``.

    Every step sees all rows. Training ends early when the loss hasn't fallen
    for ``patience`` steps; the best parameters are kept.
    """
    model = SegmentAutoencoder.create(lengths, latent, hidden, seed)
    cols = model.columns()
    whole = df
    for s, n in lengths.items():
        whole = whole.where((F.size(s) == n) & ~F.exists(F.col(s), lambda x: x.isNull() | F.isnan(x.cast("double"))))
    label_col = [F.coalesce(F.xxhash64(label), F.lit(0)).alias("_label")] if label else []
    rows = cut(whole.select(*[F.col(s).cast("array<double>").alias(s) for s in cols], *label_col), "train")
    n = rows.count()
    if not n:
        raise ValueError("no whole rows")
    width = sum(p.size for ps in model.params.values() for p in ps) + 1
    names = [*cols, *(["_label"] if label else [])]
    adam, best, since = _Adam(rate), (np.inf, None), 0
    for _ in range(steps):

        def kernel(columns: list, model: SegmentAutoencoder = model) -> np.ndarray:
            labels = columns[-1].to_numpy() if label else None
            parts, loss = [], 0.0
            for i, s in enumerate(cols):
                extra = None
                if labels is not None:
                    extra = lambda z: weight * contrastive(z, labels)[1]
                g, own, z = model.gradients(s, _matrix(columns[i]), extra)
                loss += own + (weight * contrastive(z, labels)[0] if labels is not None else 0.0)
                parts += [x.ravel() for x in g]
            return np.concatenate([*parts, [loss]])

        got = _summed(rows, names, kernel, width) / n
        model.history.append(float(got[-1]))
        if got[-1] < best[0] - 1e-6:
            best, since = (float(got[-1]), {s: [p.copy() for p in ps] for s, ps in model.params.items()}), 0
        else:
            since += 1
            if since >= patience:
                break
        move = _unpack(model, adam.step(got[:-1]))
        model = SegmentAutoencoder(model.shapes, {s: [p - d for p, d in zip(ps, move[s])] for s, ps in model.params.items()}, model.history)
    if best[1] is not None:
        model.params = best[1]
    return model


# -- soft clusters ---------------------------------------------------------------------------------------------------


def student_t(z: np.ndarray, centres: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Soft assignments: Student's t kernel of the distance to each centre, rows summing to 1."""
    d = ((z[:, None, :] - centres[None]) ** 2).sum(2)
    q = (1 + d / alpha) ** (-(alpha + 1) / 2)
    return q / q.sum(1, keepdims=True)


def soft_assignment(vector: Column, centres: np.ndarray, alpha: float = 1.0) -> Column:
    """``array<double>``: the soft assignment of a vector, in plain expressions."""
    rows = [F.array(*[F.lit(float(x)) for x in c]) for c in centres]
    square = lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    q = F.array(*[F.pow(1 + square(c) / alpha, F.lit(-(alpha + 1) / 2)) for c in rows])
    return F.transform(F.array(q), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, b: a + b)))[0]


def cluster_mass(df: DataFrame, q: str, where: Column | None = None) -> DataFrame:
    """``cluster, mass, n``: the summed soft assignments, of all rows or of those that ``where`` holds for."""
    own = df.where(where) if where is not None else df
    return own.select(F.posexplode(q).alias("cluster", "v")).groupBy("cluster").agg(F.sum("v").alias("mass"), F.count("*").alias("n"))


def target_distribution(df: DataFrame, q: str, out: str = "p") -> DataFrame:
    """Add ``out``: ``q^2 / mass`` made to sum to 1 per row. The masses are one row of as many numbers as there are clusters."""
    masses = cluster_mass(df, q).agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "mass"))), lambda x: x["mass"]).alias("_f"))
    both = df.join(F.broadcast(masses))  # one row
    sharp = F.zip_with(q, "_f", lambda a, f: a * a / f)
    p = F.transform(F.array(sharp), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, b: a + b)))[0]
    return both.withColumn(out, p).drop("_f")


def divergence(df: DataFrame, p: str, q: str) -> DataFrame:
    """``loss, n``: the mean Kullback-Leibler divergence of ``q`` from ``p``."""
    term = F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
    return df.agg(F.avg(term).alias("loss"), F.count("*").alias("n"))


def balance_loss(df: DataFrame, q: str) -> DataFrame:
    """``loss``: one less the normalised entropy of the clusters' shares; 0 where they are equal."""
    share = cluster_mass(df, q).select((F.col("mass") / F.col("n")).alias("s"))
    return share.agg((1 + F.sum(F.col("s") * F.log(F.col("s") + 1e-10)) / F.log(F.count("*").cast("double"))).alias("loss"))


def target_clusters(df: DataFrame, q: str, labelled: Column, n: int) -> DataFrame:
    """``cluster, share, rank``: the ``n`` clusters with the greatest share of labelled soft mass; ties by number."""
    whole, own = cluster_mass(df, q).select("cluster", F.col("mass").alias("_m")), cluster_mass(df, q, labelled).select("cluster", "mass")
    share = whole.join(own, "cluster", "left").select("cluster", (F.coalesce("mass", F.lit(0.0)) / (F.col("_m") + 1e-10)).alias("share"))
    best = share.orderBy(F.desc("share"), "cluster").limit(n)
    return best.select("cluster", "share", F.row_number().over(_by_share()).cast("long").alias("rank"))


def _by_share():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("share"), "cluster")  # at most n rows


def enrichment_loss(df: DataFrame, q: str, labelled: Column, targets: list[int]) -> DataFrame:
    """``loss``: the mean of how far labelled rows are outside the target clusters, and target clusters are not of labelled rows; 0 without labelled rows."""
    mass = F.aggregate(F.array(*[F.get(q, t) for t in targets]), F.lit(0.0), lambda a, b: a + b)
    yes = F.coalesce(labelled, F.lit(False))
    sums = [F.sum(F.when(yes, F.get(q, t)).otherwise(0.0)) / (F.sum(F.get(q, t)) + 1e-10) for t in targets]
    purity = sum(sums[1:], sums[0]) / len(targets)
    got = df.agg(F.count_if(yes).alias("n"), F.avg(F.when(yes, mass)).alias("c"), purity.alias("p"))
    return got.select(F.when(F.col("n") == 0, 0.0).otherwise(0.5 * (1 - F.col("c")) + 0.5 * (1 - F.col("p"))).alias("loss"))


def refine(df: DataFrame, vector: str, centres: np.ndarray, steps: int = 100, rate: float = 0.05, alpha: float = 1.0, every: int = 10, tol: float = 1e-3, balance: float = 0.0) -> tuple[np.ndarray, list[float]]:
    """Move centres down the divergence of the soft assignments from their target distribution: the centres and the loss of each step.

    The target is renewed every ``every`` steps from all rows' masses; it ends
    when fewer than ``tol`` of the rows change their likeliest cluster between
    two renewals. ``balance`` weighs a term that keeps clusters from dying out.
    """
    rows = cut(df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("z")), "refine")
    n = rows.count()
    k, d = centres.shape
    adam, losses, old = _Adam(rate), [], None
    mass = None
    for step in range(steps):
        if step % every == 0:
            mass = _summed(rows, ["z"], lambda c, m=centres: student_t(_matrix(c[0]), m, alpha).sum(0), k)
            if old is not None:
                moved = _summed(rows, ["z"], lambda c, a=old, b=centres: np.array([(student_t(_matrix(c[0]), a, alpha).argmax(1) != student_t(_matrix(c[0]), b, alpha).argmax(1)).sum()]), 1)[0]
                if moved < tol * n:
                    break
            old = centres.copy()

        def kernel(c: list, m: np.ndarray = centres, f: np.ndarray = mass) -> np.ndarray:
            z = _matrix(c[0])
            q = student_t(z, m, alpha)
            p = q**2 / f
            p /= p.sum(1, keepdims=True)
            share = f / n
            pull = p - q - balance * (q * (np.log(share + 1e-10) + 1 - (q * (np.log(share + 1e-10) + 1)).sum(1, keepdims=True)))
            w = pull / (1 + ((z[:, None] - m[None]) ** 2).sum(2) / alpha)
            grad = -(alpha + 1) / alpha * (w[:, :, None] * (z[:, None] - m[None])).sum(0)
            return np.concatenate([grad.ravel(), [(p * np.log((p + 1e-12) / (q + 1e-12))).sum()]])

        got = _summed(rows, ["z"], kernel, k * d + 1) / n
        losses.append(float(got[-1]))
        centres = centres - adam.step(got[:-1]).reshape(k, d)
    return centres, losses


# -- sparse components -----------------------------------------------------------------------------------------------


def sparse_components(df: DataFrame, vector: str, k: int, top: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, ``k`` components of ``top`` weights each (rows of length 1), and their explained shares.

    The covariance comes from one pass (``principal_components``); each
    component is the truncated power method on it, started at its greatest
    variances, and is projected out before the next. So weights are fitted
    under their number, not cut from dense ones. Signs are fixed by the largest weight.
    """
    from spikeloom.operators.clusters import covariance

    mean, cov = covariance(df, vector)
    whole, out, shares = float(np.trace(cov)), [], []
    for _ in range(k):
        best = None
        for start in np.argsort(np.diag(cov))[::-1][:3]:  # three starts, the likeliest first
            v = cov[start].copy()
            for _ in range(rounds):
                keep = np.argsort(np.abs(v))[::-1][:top]
                w = np.zeros_like(v)
                w[keep] = v[keep]
                size = np.linalg.norm(w)
                if size == 0:
                    break
                w /= size
                new = cov @ w
                if np.linalg.norm(new - v) < 1e-12 * max(1.0, np.linalg.norm(v)):
                    break
                v = new
            if size and (best is None or w @ cov @ w > best @ cov @ best):
                best = w
        if best is None:
            out.append(np.zeros(len(cov)))
            shares.append(0.0)
            continue
        best = best * np.sign(best[np.abs(best).argmax()])
        out.append(best)
        shares.append(float(best @ cov @ best) / max(whole, 1e-300))
        away = np.eye(len(cov)) - np.outer(best, best)
        cov = away @ cov @ away
    return mean, np.array(out), np.array(shares)


def feature_matrix(df: DataFrame, keys: list[str], blocks: dict[str, tuple[str, int, int | None]], out: str = "features") -> tuple[DataFrame, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """``keys`` and the scores of all blocks as one vector, and the fitted models.

    A block is (column, number of components, weights per component or None for
    dense ones). Rows that lack a block's vector have no scores; a model can be
    applied to other rows with ``apply_models``.
    """
    from spikeloom.operators.clusters import principal_components

    models = {}
    for name, (column, k, top) in blocks.items():
        mean, comp, _ = sparse_components(df, column, k, top) if top else principal_components(df, column, k)
        models[name] = (mean, comp)
    return apply_models(df, keys, {n: c for n, (c, *_) in blocks.items()}, models, out), models


def apply_models(df: DataFrame, keys: list[str], columns: dict[str, str], models: dict[str, tuple[np.ndarray, np.ndarray]], out: str = "features") -> DataFrame:
    from spikeloom.operators.clusters import project

    parts = [F.when(F.size(columns[n]) == len(m[0]), project(F.col(columns[n]).cast("array<double>"), *m)) for n, m in models.items()]
    return df.select(*keys, F.concat(*parts).alias(out))


def two_dimensions(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """``keys, x, y``: the plane of greatest variance, for display; deterministic and in one pass, unlike neighbour embeddings."""
    from spikeloom.operators.clusters import principal_components, project

    mean, comp, _ = principal_components(df, vector, 2)
    xy = project(F.col(vector).cast("array<double>"), mean, comp)
    return df.where(F.size(vector) == len(mean)).select(*keys, F.get(xy, 0).alias("x"), F.get(xy, 1).alias("y"))
