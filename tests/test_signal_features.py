import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.functions import arrays as A
from spikeloom.functions import geometry as G
from spikeloom.functions import names as N
from spikeloom.functions import signal as S
from spikeloom.operators import features, population, quality, sta


def test_filters_pass_and_stop():
    t = np.arange(600) / 60
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 25 * t)
    for low in (S.bessel_lowpass, S.butter_lowpass):
        out = low(np.stack([slow, fast, np.ones(600)]))
        assert np.abs(out[0] - slow)[60:-60].max() < 0.02
        assert np.abs(out[1])[60:-60].max() < 0.05
        assert np.abs(out[2] - 1).max() < 1e-9
    high = S.butter_highpass(np.stack([np.ones(4000), np.sin(2 * np.pi * 2000 * np.arange(4000) / 20000)]))
    assert np.abs(high[0]).max() < 1e-6 and np.abs(high[1])[500:-500].max() == pytest.approx(math.sin(0.4 * math.pi), abs=0.02)


def test_filter_coefficients():
    b, a = S.butterworth(2, 0.25, 1.0)  # half of the Nyquist rate: known closed form
    assert b == pytest.approx([0.2928932, 0.5857864, 0.2928932], abs=1e-6) and a == pytest.approx([1, 0, 0.1715729], abs=1e-6)
    b, a = S.bessel(5, 10, 60)
    assert b.sum() / a.sum() == pytest.approx(1)
    assert (np.abs(np.roots(a)) < 1).all()
    assert np.array_equal(S.bessel_lowpass(np.ones((1, 9)), 30, 60), np.ones((1, 9)))


def test_peaks():
    at, prom = S.find_peaks(np.array([0, 2, 0, 5, 5, 1, 3, 0.0]))
    assert at.tolist() == [1, 3, 6] and prom.tolist() == [2, 5, 2]
    assert S.find_peaks(np.array([0, 2, 0, 5, 0, 4, 0.0]), distance=3)[0].tolist() == [3]
    assert S.extreme_peak(np.array([1, 3, 1, -3, 1.0]), 1.0, 0.5) == (-4.0, 3.0)
    assert S.extreme_peak(np.array([0, 2, 0, -2, 0.0]), 0.0, 0.1)[0] == 2.0  # the rise on a tie
    v, k = S.extreme_peak(np.ones(9), 1.0, 0.1)
    assert v == 0 and math.isnan(k)


def test_onsets_known_answers():
    x = np.zeros(1000)
    x[500:] = 1e7
    assert S.onsets(x, 1e6).tolist() == [499]
    y = np.zeros(1000)
    for p in (200, 400, 600):
        y[p:] += 1e7
    assert len(S.onsets(y, 1e6)) == 3 and len(S.onsets(np.where(x > 0, 1e4, 0.0), 1e6)) == 0


def test_smoothing_and_sine():
    x = np.arange(20.0) ** 2
    assert S.savitzky_golay(x) == pytest.approx(x)
    assert S.gaussian_smooth(np.ones(30), 2.0) == pytest.approx(np.ones(30))
    assert S.kernel_smooth(np.ones(9), 3)[1:-1] == pytest.approx(np.ones(7))
    t = np.arange(240) / 60
    amp, phase, off, r2 = S.sine_fit(7 * np.sin(2 * np.pi * 2 * t + 0.4) + 3, 2.0)
    assert (amp, phase, off, r2) == pytest.approx((7, 0.4, 3, 1))
    assert S.sine_fit(np.ones(50), 1.0)[3] == 0


def test_step_colour_frequency_features(spark):
    x = np.full(1500, 5.0)
    x[70:80] = 45
    x[370:380] = 25
    x[239:299] = 15
    df = spark.createDataFrame([(1, x.tolist()), (2, None), (3, [1.0] * 10), (4, [float("nan")] * 1500), (5, [900.0] * 1500)], "id int, t array<double>")
    rows = {r.id: r.f for r in df.select("id", features.step_feature_struct(F.col("t")).alias("f")).collect()}
    assert rows[1].on_peak_extreme == pytest.approx(40) and rows[1].off_peak_extreme == pytest.approx(20) and rows[1].on_sustained == pytest.approx(10)
    assert rows[1].on_off_ratio == pytest.approx(math.tanh(2))
    for i in (2, 3, 4, 5):
        assert rows[i].base_mean is None or math.isnan(rows[i].base_mean)
    f = df.select("id", features.frequency_feature_struct(F.col("t")).alias("f"), features.colour_feature_struct(F.col("t")).alias("c")).where("id = 1").first()
    assert "freq_step_05hz_amp" in f.f.asDict() and "freq_step_10hz_std" in f.f.asDict() and len(f.c) == 12


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 10.0],), ([5.0, 5.0],), ([],), (None,)], "a array<double>")
    a = F.col("a")
    r = df.select(A.mean(a).alias("m"), A.var_pop(a).alias("v"), A.zscore(a).alias("z"), A.by_max_abs(a).alias("s"), A.median_first(a, 4).alias("md"), A.block_mean(a, 2).alias("b"), A.every_nth(a, 2).alias("e"), A.has_bad(a).alias("bad"), A.min_max(a).alias("mm"), A.minus_baseline(a, 2).alias("mb")).collect()
    assert r[0].m == 4 and r[0].v == pytest.approx(np.var([1, 2, 3, 4, 10])) and r[0].md == 2.5 and r[0].b == [1.5, 3.5] and r[0].e == [1, 3, 10]
    assert r[1].z == [0, 0] and r[1].mm == [0, 0] and r[0].mb[0] == -0.5
    assert r[2].m is None and r[3].m is None and r[3].bad and not r[0].bad
    t = spark.createDataFrame([([[1.0, 2.0, 9.0], [3.0, 4.0]],), ([],)], "t array<array<double>>")
    assert [x.m for x in t.select(A.mean_trace(F.col("t")).alias("m")).collect()] == [[2.0, 3.0], None]


def test_geometry(spark):
    r = spark.range(1).select(
        G.angle_difference(F.lit(350.0), F.lit(10.0)).alias("d"), G.corrected_angle(F.lit(350.0), F.lit(20.0)).alias("c"), G.corrected_angle(F.lit(22.5), F.lit(0.0)).alias("half"),
        G.tanh_ratio(F.lit(-2.0), F.lit(0.0)).alias("t"), G.line_distance(*[F.lit(float(v)) for v in (0, 1, -1, 0, 1, 0)]).alias("ld"),
        G.coarse_to_fine(F.lit(7.5)).alias("f"), G.coarse_to_fine(F.lit(-1.0)).alias("lo"), G.quadrant(F.lit(-1.0), F.lit(1.0)).alias("q"),
    ).first()
    assert (r.d, r.c, r.half, r.t, r.ld, r.f, r.lo, r.q) == (20.0, "000", "000", -1.0, 1.0, 150, 0, "Q2")
    flat = spark.createDataFrame([tuple([1.0] * 8), (8.0, *[0.0] * 7), tuple([0.0] * 8)], ", ".join(f"r{i} double" for i in range(8)))
    cols = [F.col(f"r{i}") for i in range(8)]
    got = flat.select(G.direction_index(cols)[0].alias("d"), G.orientation_index(cols).alias("o")).collect()
    assert [round(x.d, 9) for x in got] == [0, 1, 0] and [round(x.o, 9) for x in got] == [0, 1, 0]


def test_names(spark):
    df = spark.createDataFrame([("2024.01.02-03.04.05-Rec_unit_7", "a,2,3", "1, x,3", "['a.mov', 'b.mov']", "L/Good/r_unit12.PNG")], "i string, e string, l string, p string, f string")
    d, n = N.split_index(F.col("i"))
    u, lab = N.label_unit(F.col("f"))
    r = df.select(d.alias("d"), n.alias("n"), N.batch_of(F.col("i")).alias("b"), N.eye_position(F.col("e")).alias("e"), N.lane_list(F.col("l")).alias("l"), N.playlist_movies(F.col("p")).alias("p"), N.sheet_name(F.col("i")).alias("s"), u.alias("u"), lab.alias("lab"), N.safe_id(F.lit("x--")).alias("sid"), N.safe_id(F.lit("a/b")).alias("bad")).first()
    assert (r.d, r.n, r.b) == ("2024.01.02-03.04.05-Rec", "7", "2024.01.02-03.04.05-Rec_unit")
    assert tuple(r.e) == ("A", -2.0, 3.0) and r.l == [0, 2] and r.p == ["a", "b"] and r.s == "2024.01.02.03.04.05.Rec.cmcr"
    assert (r.u, r.lab, r.sid, r.bad) == (12, "good", "x", None)


def test_quality(spark):
    tr = [[1.0, 5.0, 1.0, 5.0], [1.0, 5.0, 1.0, 5.0]]
    long = [("a", k, i, v) for k, t in enumerate(tr) for i, v in enumerate(t)] + [("b", 0, i, float(i)) for i in range(3)] + [("c", k, i, 2.0) for k in range(2) for i in range(3)]
    df = spark.createDataFrame(long, "u string, k int, i int, v double")
    assert {r.u: r.qi for r in quality.variance_ratio_qi(df, ["u"], "k", "i", "v").collect()} == {"a": 1.0, "b": None, "c": None}
    assert {r.u: r.qi for r in quality.pearson_qi(df, ["u"], "k", "i", "v").collect()}["a"] == pytest.approx(1)
    arr = spark.createDataFrame([(tr,), ([[1.0, 2.0]],)], "t array<array<double>>")
    assert [r.q for r in arr.select(quality.variance_ratio_of(F.col("t")).alias("q")).collect()] == [1.0, None]
    reg = spark.createDataFrame([("u", i / 10) for i in range(100)] + [("u", None)], "u string, t double")
    r = quality.interval_stats(reg, ["u"], "t", 1.0).first()
    assert r.n == 100 and r.isi_mean == pytest.approx(0.1) and r.isi_cv < 0.1


def test_population_statistics(spark):
    assert population.student_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert population.binomial_p(7, 10, 0.5) == pytest.approx(0.34375)
    df = spark.createDataFrame([("x", 1, 0.01), ("x", 2, 0.04), ("x", 3, 0.03), ("x", 4, None), ("x", 5, 0.04)], "g string, i int, p double")
    got = {r.i: r.p_adjusted for r in population.fdr_adjusted(df, ["g"], "p").collect()}
    assert got == pytest.approx({1: 0.04, 3: 0.04, 2: 0.04, 5: 0.04})
    b = spark.createDataFrame([("x", k, v) for k, v in enumerate([100.0, 50.0, 45.0, 44.0])], "g string, k int, bic double")
    assert population.log_bayes_choice(b, ["g"], "k", "bic").first().k == 1
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b", 2), (2, "c", 3), (2, "c", 3)], "k int, v string, w int")
    assert sorted((r.k, r.v, r.w) for r in population.add_missing_first(old, new, ["k"]).collect()) == [(1, "a", None), (2, "c", 3)]
    w = spark.createDataFrame([("x", True, v) for v in (1.0, 2.0, 3.0)] + [("x", False, v) for v in (2.0, 4.0, 6.0)], "g string, a boolean, v double")
    r = population.welch(w, ["g"], F.col("a"), "v").first()
    assert r.t == pytest.approx(-1.549193) and r.df == pytest.approx(2.941176, abs=1e-5) and 0 < r.p < 1


def test_sta_known_answers(spark):
    frames = spark.createDataFrame([(i, float(i)) for i in range(100)], "i long, v double")
    s = spark.createDataFrame([(1, f) for f in (5, 9, 50, 60, 70)] + [(2, f) for f in (30, 40, 50, 96, 99)] + [(3, f) for f in (0, 1, 2, 55, 59)], "u int, f long")
    assert {r.u: (r.n_used, r.n_excluded) for r in sta.excluded_spikes(s.where("u = 1"), "u", "f", -10, 0, 100).collect()} == {1: (3, 2)}
    assert {r.u: (r.n_used, r.n_excluded) for r in sta.excluded_spikes(s.where("u = 2"), "u", "f", -5, 5, 100).collect()} == {2: (3, 2)}
    got = {(r.u, r.offset): r.average for r in sta.spike_triggered_average(s, frames, "u", "f", "i", None, "v", -10, 0, 100).collect()}
    assert got[1, 0] == 60 and got[1, -10] == 50
    assert sta.spike_triggered_average(s.where("u = 3"), frames, "u", "f", "i", None, "v", -60, 0, 100).count() == 0
    y, x = np.mgrid[:15, :15]
    rf = sta.gaussian_rf(np.stack([np.zeros((15, 15)), 4 * np.exp(-((x - 8) ** 2) / 8 - (y - 6) ** 2 / 4.5)]))
    assert rf["center_x"] == pytest.approx(8, abs=0.1) and rf["center_y"] == pytest.approx(6, abs=0.1) and rf["r_squared"] > 0.99
    d2 = (x - 8) ** 2 + (y - 6) ** 2
    cs = sta.center_surround(5 * np.exp(-d2 / 4.5) - 2 * np.exp(-d2 / 32.0), (7, 7))
    assert cs["r_squared"] > 0.99 and cs["center_x"] == pytest.approx(8, abs=0.05) and cs["center_y"] == pytest.approx(6, abs=0.05)
    both = sta.on_off_fields(np.exp(-d2 / 4.5), (6, 8))
    assert both["off"] is None and both["on"]["r_squared"] > 0.99
    g = np.random.default_rng(0).normal(size=4000)
    a, b = sta.poisson_exponential(g, np.random.default_rng(1).poisson(np.exp(0.3 + 0.5 * g)))
    assert (a, b) == (pytest.approx(0.3, abs=0.1), pytest.approx(0.5, abs=0.1))
    assert sta.bits_per_spike(g, np.random.default_rng(1).poisson(np.exp(0.3 + 0.5 * g)), a, b) > 0.05
