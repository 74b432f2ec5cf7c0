import numpy as np

from spikeloom.llm import linkage

COLS = "id long, file string, r int, c int, w array<float>, rate double, key string, rec string, shape string"


def wave(rng, kind, n=50, peak=20):
    t = np.arange(n) - peak
    return (-np.exp(-(t**2) / (8 + 6 * kind[0])) * kind[1] + 0.3 * kind[1] * np.exp(-((t - 8 - 4 * kind[2]) ** 2) / 20) + rng.normal(0, 0.3, n)).tolist()


def world(seed=0, recs=6, units=25):
    """Units on an array, and what a sorter writes of them: jittered places, inverted and scaled shapes, missing fields, strangers, a divided unit."""
    rng = np.random.default_rng(seed)
    left, right, truth = [], [], set()
    for r in range(recs):
        name = f"2020.01.{r + 1:02d}-10.00.00-Rec"
        for u in range(units):
            k = 1000 * r + u
            kind, row, col, rate = rng.random(3) * [3, 1, 2] + [0, 20, 0], int(rng.integers(10, 60)), int(rng.integers(10, 60)), float(np.exp(rng.normal(1.2, 1)))
            left.append((k, name, row, col, wave(rng, kind), rate, "a", "b", "c"))
            if rng.random() < 0.2:
                continue
            parts = [1.0] if rng.random() < 0.95 else [0.55, 0.45]
            for p in parts:
                w = (-16 * np.array(wave(rng, kind))[3:43]).tolist()
                j = 100_000 + len(right)
                miss = rng.random(4) < 0.05
                right.append((j, name.replace("-", ".", 1).upper() + ".H5" if u % 2 else name, None if miss[0] else row + int(rng.integers(-2, 3)), None if miss[1] else col + int(rng.integers(-2, 3)), None if miss[2] else w, float("nan") if miss[3] else rate * p * float(np.exp(rng.normal(0, 0.08))), "a", "b", "c"))
                truth.add((k, j))
        for s in range(5):
            right.append((200_000 + 10 * r + s, name, int(rng.integers(10, 60)), int(rng.integers(10, 60)), (-16 * np.array(wave(rng, rng.random(3) * [3, 1, 2] + [0, 20, 0]))[3:43]).tolist(), float(np.exp(rng.normal(1.2, 1))), "a", "b", "c"))
    return left, right, truth


def prep(spark, rows):
    return linkage.prepared(spark.createDataFrame(rows, COLS), "id", "file", "r", "c", "w", "rate")


def test_held_out_accuracy_and_transitivity(spark):
    left, right, truth = world()
    got = linkage.link(prep(spark, left + left[:10]), prep(spark, right)).toPandas()
    found = {(a, b) for a, b, p in zip(got.lkey, got.rkey, got.confidence) if p >= 0.5}
    assert len(found & truth) / len(truth) > 0.9 and len(found & truth) / len(found) > 0.95
    assert got.groupby("rkey").confidence.sum().max() <= 1 + 1e-9
    assert got.confidence.between(0, 1).all() and not got.duplicated(["lkey", "rkey"]).any()


def test_conventions_of_sources(spark):
    """Two sources, each with its own offset in a recording and its own gain; neighbours crowd, so places count."""
    left, right, truth = world(seed=9, recs=8, units=30)
    rng = np.random.default_rng(1)
    own = {(r, s): rng.integers(-3, 4, 2) for r in range(8) for s in "ab"}
    moved = []
    for key, file, row, col, w, rate, *_ in right:
        rec, source = int(file.replace(".", "-").split("-")[2]) - 1, "ab"[key % 2]
        dr, dc = own[rec, source]
        moved.append((key, file, None if row is None else int(row + dr), None if col is None else int(col + dc), w if w is None or source == "a" else (np.array(w) * 0.02).tolist(), rate, source, "", ""))
    frame = spark.createDataFrame(moved, COLS)
    ri = linkage.prepared(frame, "id", "file", "r", "c", "w", "rate", source="key")
    got = linkage.link(prep(spark, left), ri).toPandas()
    found = {(a, b) for a, b, p in zip(got.lkey, got.rkey, got.confidence) if p >= 0.5}
    assert len(found & truth) / len(truth) > 0.95 and len(found & truth) / len(found) > 0.95


def test_competing_peaks_are_aligned_at_either():
    import pandas as pd

    t = np.arange(50.0)
    w = -np.exp(-((t - 20) ** 2) / 12) + 0.99 * np.exp(-((t - 29) ** 2) / 30)
    a, b = (linkage._aligned(pd.Series([x])) for x in (w, w + 0.03 * np.exp(-((t - 29) ** 2) / 30)))
    assert abs(int(w.argmin()) - 20) < 2 and linkage._alike(a, b)[0] > 0.99
    assert linkage._alike(a, linkage._aligned(pd.Series([-5 * w])))[0] > 0.99


def test_dirt(spark):
    dirty = [(1, None, 1, 1, None, 1.0, "", "", ""), (2, "no name", 1, 1, None, 1.0, "", "", ""), (3, "2020.01.01-10.00.00-Rec", None, None, None, None, "", "", ""), (4, "2020.01.01-10.00.00-Rec", None, None, [], float("nan"), "", "", ""), (5, "2020.01.01-10.00.00-Rec", 5, 5, [0.0] * 50, -1.0, "", "", ""), (None, "2020.01.01-10.00.00-Rec", 5, 5, None, 1.0, "", "", "")]
    p = {r.key: r for r in prep(spark, dirty).collect()}
    assert set(p) == {3, 4, 5} and p[5].shape is None and p[5].lograte is None and p[4].shape is None
    got = linkage.link(prep(spark, dirty), prep(spark, dirty)).collect()
    assert {(r.lkey, r.rkey) for r in got} == {(5, 5)}


def test_empty(spark):
    assert linkage.link(prep(spark, []), prep(spark, [])).count() == 0
    assert linkage.link(prep(spark, world(recs=1)[0]), prep(spark, [])).count() == 0


def test_blocking_loses_no_pair_within_reach(spark):
    left, right, truth = world(seed=3, recs=2)
    pairs = {(r.lkey, r.rkey) for r in linkage.candidates(prep(spark, left), prep(spark, right)).collect()}
    le, ri = {x[0]: x for x in left}, {x[0]: x for x in right}
    assert {t for t in truth if ri[t[1]][2] is not None or ri[t[1]][3] is not None} <= pairs
    near = lambda a, b: a is None or b is None or abs(a - b) <= 6
    assert all(near(le[a][2], ri[b][2]) and near(le[a][3], ri[b][3]) for a, b in pairs)


def test_rows_without_a_common_coordinate_meet_all_rows_of_the_recording(spark):
    name = "2020.01.01-10.00.00-Rec"
    rng = np.random.default_rng(4)
    have = [(5, 5), (5, None), (None, 50), (None, None)]
    rows = lambda at: [(at + i, name, *have[i % 4], wave(rng, rng.random(3) * [3, 1, 2] + [0, 20, 0]) if i % 3 else None, float(np.exp(4 * i)) if i % 5 else None, "", "", "") for i in range(24)]
    left, right = rows(0), rows(100)
    want = {
        (a[0], b[0]) for a in left for b in right
        if (a[2] is None or b[2] is None) and (a[3] is None or b[3] is None) and (a[4] and b[4] or a[5] and b[5])
    }
    le, ri = prep(spark, left), prep(spark, right)
    place = {x[0]: x[2:4] for x in left + right}
    for chunk in (1000, 5):
        got = [(r.lkey, r.rkey) for r in linkage.candidates(le, ri, chunk=chunk).collect()]
        assert len(got) == len(set(got))
        assert {p for p in got if not any(x is not None and y is not None for x, y in zip(place[p[0]], place[p[1]]))} == want


def test_the_step_in_batches_equals_the_scores_in_sql(spark):
    rng = np.random.default_rng(2)
    rows = [(int(r), *[None if rng.random() < 0.1 else float(v) for v in rng.normal(0, 1, 5)]) for r in np.sort(rng.integers(0, 300, 3000))]
    pairs = spark.createDataFrame(rows, "rkey long, " + ", ".join(f"{d} double" for d in linkage.DIMS))
    mix = linkage.Mixture([0.1, 0.1, 0.4, 0.4], rng.normal(0, 1, (4, 5)).tolist(), (0.5 + rng.random((4, 5))).tolist())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = linkage._step(linkage._by_right(pairs), mix)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sql = linkage._scored(pairs, mix).selectExpr("sum(p * exp(l0 - lm))", "sum((1 - p) * exp(l3 - lu) * rate)", "sum(p * exp(l1 - lm) * shape * shape)").first()
    at = {d: i for i, d in enumerate(linkage.DIMS)}
    assert np.allclose([got[0, 0], got[3, 2 + 3 * at["rate"]], got[1, 3 + 3 * at["shape"]]], list(sql))
    assert abs(got[:, 0].sum() - 3000) < 1e-6
