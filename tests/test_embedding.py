import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.operators import clusters
from spikeloom.operators import embedding as E


def cells(spark, n=240, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(20)
    rows = []
    for i in range(n):
        k = i % 3
        rows.append((i, f"g{k}", (np.sin(t * (k + 1) / 4) + rng.normal(0, 0.1, 20)).tolist(), (np.full(6, float(k)) + rng.normal(0, 0.1, 6)).tolist()))
    rows += [(n, "g0", None, [1.0] * 6), (n + 1, "g0", [1.0] * 20, [float("nan")] * 6), (n + 2, "g0", [1.0], [1.0] * 6)]
    return spark.createDataFrame(rows, "id long, g string, bar array<double>, sta array<double>")


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    m = E.SegmentAutoencoder.create({"s": 7}, {"s": 3}, 5)
    x = rng.normal(size=(9, 7))
    labels = rng.integers(0, 3, 9)
    total = lambda: m.gradients("s", x)[1] + 0.5 * E.contrastive(m.encode(x, "s"), labels)[0]
    g, _, _ = m.gradients("s", x, lambda z: 0.5 * E.contrastive(z, labels)[1])
    for i, p in enumerate(m.params["s"]):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)]:
            old = p[at]
            p[at] = old + 1e-6
            up = total()
            p[at] = old - 1e-6
            down = total()
            p[at] = old
            assert g[i][at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-5)


def test_autoencoder_learns_and_separates(spark):
    df = cells(spark)
    model = E.train_autoencoder(df, {"bar": 20, "sta": 6}, {"bar": 3, "sta": 2}, label="g", steps=40, hidden=16)
    assert model.history[-1] < 0.5 * model.history[0]
    got = model.embed(df, ["id", "g"])
    rows = got.collect()
    assert sum(r.embedding is None for r in rows) == 3
    z = np.array([r.embedding for r in rows if r.embedding is not None])
    k = np.array([int(r.g[1]) for r in rows if r.embedding is not None])
    mid = np.stack([z[k == i].mean(0) for i in range(3)])
    assert (((z[:, None] - mid) ** 2).sum(2).argmin(1) == k).mean() > 0.97
    assert E.train_autoencoder(df, {"sta": 6}, {"sta": 2}, steps=3).history
    with pytest.raises(ValueError):
        E.train_autoencoder(df.limit(0), {"sta": 6}, {"sta": 2})


def test_soft_clusters_against_numpy(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(50, 3))
    c = rng.normal(size=(4, 3))
    df = spark.createDataFrame([(i, v.tolist(), bool(i % 3 == 0)) for i, v in enumerate(z)], "id long, z array<double>, y boolean")
    soft = df.withColumn("q", E.soft_assignment(F.col("z"), c))
    q = E.student_t(z, c)
    got = np.array([r.q for r in soft.orderBy("id").collect()])
    assert np.allclose(got, q)
    p = q**2 / q.sum(0)
    p /= p.sum(1, keepdims=True)
    sharp = E.target_distribution(soft, "q")
    assert np.allclose([r.p for r in sharp.orderBy("id").collect()], p)
    assert E.divergence(sharp, "p", "q").first().loss == pytest.approx((p * np.log(p / q)).sum(1).mean())
    share = q.mean(0)
    assert E.balance_loss(soft, "q").first().loss == pytest.approx(1 + (share * np.log(share + 1e-10)).sum() / np.log(4))
    y = np.arange(50) % 3 == 0
    frac = q[y].sum(0) / (q.sum(0) + 1e-10)
    top = np.argsort(-frac)[:2]
    assert [r.cluster for r in E.target_clusters(soft, "q", F.col("y"), 2).orderBy("rank").collect()] == top.tolist()
    want = 0.5 * (1 - q[y][:, top].sum(1).mean()) + 0.5 * (1 - (q[y][:, top].sum(0) / (q[:, top].sum(0) + 1e-10)).mean())
    assert E.enrichment_loss(soft, "q", F.col("y"), top.tolist()).first().loss == pytest.approx(want)
    assert E.enrichment_loss(soft, "q", F.lit(False), [0]).first().loss == 0.0


def test_refinement_finds_the_clusters(spark):
    rng = np.random.default_rng(3)
    mid = np.array([[0.0, 0], [5, 0], [0, 5]])
    z = np.concatenate([m + rng.normal(0, 0.4, (60, 2)) for m in mid])
    df = spark.createDataFrame([(v.tolist(),) for v in z], "z array<double>")
    centres, losses = E.refine(df, "z", mid + rng.normal(0, 0.8, mid.shape), steps=80, tol=0.0, balance=0.1)
    assert np.abs(centres - mid).max() < 0.6 and min(losses) < losses[0]


def test_sparse_components(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=400), rng.normal(size=400)
    x = rng.normal(0, 0.05, (400, 12))
    x[:, [1, 4, 7]] += 3 * a[:, None]
    x[:, [2, 9]] += 2 * b[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    mean, comp, share = E.sparse_components(df, "v", 2, 3)
    assert np.flatnonzero(np.abs(comp[0]) > 0.05).tolist() == [1, 4, 7] and set(np.flatnonzero(np.abs(comp[1]) > 0.3)) == {2, 9}
    assert (np.count_nonzero(comp, axis=1) == 3).all() and np.allclose(np.linalg.norm(comp, axis=1), 1) and share[0] > share[1] > 0.1
    m, cov = clusters.covariance(df, "v")
    assert np.allclose(m, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    feats, models = E.feature_matrix(df, ["id"], {"sparse": ("v", 2, 3), "dense": ("v", 2, None)})
    rows = {r.id: r.features for r in feats.collect()}
    assert len(rows[0]) == 4 and rows[999] is None and np.allclose(rows[5][:2], (x[5] - mean) @ comp.T)
    again = {r.id: r.features for r in E.apply_models(df, ["id"], {"sparse": "v", "dense": "v"}, models).collect()}
    assert again[7] == rows[7]
    assert E.two_dimensions(df, "v", ["id"]).count() == 400
