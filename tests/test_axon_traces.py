import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.functions.signal import butter_lowpass
from spikeloom.operators import axon, traces

DDL = "dataset_id string, unit_id string, average array<double>, shape array<int>"


def image(soma=(20, 20), way=(0.0, 1.0), size=60, frames=34, seed=0):
    """A soma that dips, and a spot that leaves it in direction ``way`` (rows, columns) a pixel a frame."""
    rng = np.random.default_rng(seed)
    cube = rng.normal(0, 0.01, (frames, size, size))
    yy, xx = np.mgrid[:size, :size]
    cube[4] -= 30 * np.exp(-((yy - soma[0]) ** 2 + (xx - soma[1]) ** 2) / 2)
    for t in range(5, frames):
        r, c = soma[0] + way[0] * (t + 2), soma[1] + way[1] * (t + 2)
        cube[t] -= 1.2 * np.exp(-((yy - r) ** 2 + (xx - c) ** 2) / 1.5)
    return cube


def test_tracks_heads_and_places(spark):
    rows = []
    for i, (soma, way) in enumerate([((20, 20), (0.0, 1.0)), ((30, 18), (0.0, 1.0)), ((12, 25), (0.3, 0.95)), ((40, 15), (-0.2, 0.98))]):
        c = image(soma, way, seed=i)
        rows.append(("d", f"u{i}", c.ravel().tolist(), list(c.shape)))
    rows += [("d", "none", None, None), ("d", "bad", [1.0, 2.0], [3, 3, 3]), ("d", "nan", [float("nan")] * 8, [2, 2, 2]), ("e", "alone", image().ravel().tolist(), [34, 60, 60])]
    df = spark.createDataFrame(rows, DDL)
    kinds = spark.createDataFrame([("d", f"u{i}", "RGC") for i in range(4)] + [("e", "alone", "ac")], "dataset_id string, unit_id string, axon_type string")
    eye = spark.createDataFrame([("d", 1.0, 0.5)], "dataset_id string, dv double, nt double")
    found, head, places = axon.axon_tracking(df, kinds, eye)
    got = {r.unit_id: r for r in found.collect()}
    for i, soma in enumerate([(20, 20), (30, 18), (12, 25), (40, 15)]):
        r = got[f"u{i}"]
        assert r.status == "complete" and (r.soma_t, r.soma_row, r.soma_col) == (4, *soma) and r.n_centroids >= 10
    assert abs(got["u0"].slope) < 0.1 and abs((got["u0"].angle + 180) % 360 - 180) < 10 and got["u0"].r2 is not None
    assert got["alone"].status == "minimal" and got["alone"].centroids is None and got["alone"].soma_row == 20
    assert {got[k].status for k in ("none", "bad", "nan")} == {"skipped"}
    h = {r.dataset_id: r for r in head.collect()}
    assert h["d"].method == "lines" and h["d"].n_used >= 2 and h["e"].method == "center" and (h["e"].head_x, h["e"].head_y) == (33.0, 33.0)
    p = {r.unit_id: r for r in places.collect()}
    assert set(p) == {"u0", "u1", "u2", "u3", "alone"} and p["u0"].eye_angle is not None and p["alone"].eye_angle is None
    assert p["alone"].radius == pytest.approx(np.hypot(13, 13))


def test_projections_and_boundary_pull(spark):
    c = np.arange(24.0).reshape(2, 3, 4)
    df = spark.createDataFrame([("d", "u", c.ravel().tolist(), [2, 3, 4]), ("d", "v", None, None)], DDL)
    got = {(r.row, r.col): r.swing for r in axon.projections(df).collect()}
    assert got == {(i, j): 12.0 for i in range(3) for j in range(4)}
    pts = spark.createDataFrame([("d", "a", 50.0, 33.0), ("d", "a", 20.0, 33.0), ("d", "b", 44.0, 33.0), ("d", "b", 45.0, 60.0)], "dataset_id string, unit_id string, x double, y double")
    pull = {r.unit_id: (r.pull, r.strongest) for r in axon.boundary_pull(pts, ["dataset_id"], "unit_id", F.col("x"), F.col("y"), F.lit(43.0), F.lit(33.0)).collect()}
    assert pull == {"a": (7.0, True), "b": (3.0, False)}


def test_segments_by_rule(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=240)
    y = rng.normal(size=2000)
    rows = [(1, x.tolist(), y.tolist(), [x[:200].tolist(), x.tolist()]), (2, x[:200].tolist(), y.tolist(), [x.tolist()]), (3, None, y.tolist(), []), (4, [float("nan")] * 240, y.tolist(), None), (5, [1.0] * 10, [1.0] * 10, [[1.0] * 10])]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>, t array<array<double>>")
    one = {r.id: r for r in df.select("id", traces.segment(F.col("a"), "freq_section_10hz").alias("edge"), traces.segment(F.col("a"), "sta_time_course").alias("raw"), traces.segment(F.col("b"), "iprgc_test").alias("ip"), traces.segment(F.col("a"), "bar").alias("bar"), traces.mean_of_trials(F.col("t")).alias("m"), traces.last_trial(F.col("t")).alias("last")).collect()}
    assert one[1].edge == x[60:-60].tolist() and one[1].raw == x.tolist() and one[5].edge == [1.0] * 10
    want = butter_lowpass(y[None, :1800], 10.0, 60.0, 4)[0, ::6]
    assert np.allclose(one[1].ip, want) and len(one[1].bar) == 40 and one[5].bar == [1.0, 1.0]
    assert np.allclose(one[1].m, x[:200]) and one[3].m is None and one[1].last == x.tolist() and one[3].last is None
    seg = traces.segments(df.where("id < 5"), ["id"], {"bar": F.col("a"), "iprgc_test": F.col("b")}, "zscore")
    got = {r.id: r for r in seg.collect()}
    assert set(got) == {1, 2} and len(got[1].bar) == len(got[2].bar) == 34 and abs(np.mean(got[1].bar)) < 1e-9 and np.std(got[1].bar) == pytest.approx(1)
    assert [(r.segment, r.start, r.end) for r in traces.segment_map(seg, ["bar", "iprgc_test"]).collect()] == [("bar", 0, 34), ("iprgc_test", 34, 334)]
    assert len(traces.end_to_end(seg, ["id"], ["bar", "iprgc_test"]).first().trace) == 334
    modal = {r.id: r.a for r in traces.modal_length(df, "a").collect()}
    assert {len(v) for v in modal.values() if v is not None} == {240} and modal[5][10:] == [0.0] * 230


def test_normalisations_and_bar_factors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 12.0]), (2, [3.0] * 10)], "id long, x array<double>")
    for how, want in (("maxabs", lambda v: v / 12), ("minmax", lambda v: (v - 1) / 11), ("baseline", lambda v: v - 1), ("zscore", lambda v: (v - v.mean()) / v.std()), ("none", lambda v: v)):
        got = {r.id: np.array(r.y) for r in df.select("id", traces.normalized(F.col("x"), how).alias("y")).collect()}
        assert np.allclose(got[1], want(np.array(df.first().x)))
        assert np.allclose(got[2], {"zscore": 0.0, "minmax": 0.0, "maxabs": 1.0, "baseline": 0.0, "none": 3.0}[how])
    tune, t = np.array([1, 2, 5, 2, 1, 0.5, 0.2, 0.5]), np.sin(np.arange(30) / 5) + 2
    bars = spark.createDataFrame([tuple([1, *[[(k * t).tolist(), (k * t).tolist()] for k in tune]])], "id long, " + ", ".join(f"d{i} array<array<double>>" for i in range(8)))
    f = bars.select("id", traces.bar_factors([F.col(f"d{i}") for i in range(8)]).alias("f")).collect()[0].f
    assert f.share == pytest.approx(1.0) and np.allclose(np.array(f.tuning) / f.tuning[2], tune / 5) and np.allclose(np.array(f.time_course) / f.time_course[0], t / t[0])
