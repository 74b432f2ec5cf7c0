import json
import math

import numpy as np
import pytest

from spikeloom.operators import electrode_sta
from spikeloom.operators import extractors as X
from spikeloom.plans import pipeline as P
from spikeloom.sources import hdf5

SP = "dataset_id string, unit_id string, t_us long"


def spikes(spark, trains):
    return spark.createDataFrame([("d", u, int(t)) for u, ts in trains.items() for t in ts], SP)


def test_baseline_of_a_regular_and_a_silent_unit(spark):
    df = spikes(spark, {"a": range(0, 10_000_000, 100_000), "b": [5]})
    units = spark.createDataFrame([("d", u, None) for u in "abc"], "dataset_id string, unit_id string, waveform array<double>")
    got = {r.unit_id: r for r in X.baseline(df, units).collect()}
    a = got["a"]
    assert a.spike_count == 100 and 9 < a.mean_firing_rate < 11 and a.cv_isi < 0.1 and a.median_isi_ms == 100.0 and a.quality_index == 1.0
    t = np.arange(0, 10_000_000, 100_000)
    n = max(1, int(t[-1] / 1e6))
    assert a.std_firing_rate == pytest.approx(np.std(np.histogram(t, np.linspace(0, t[-1], n + 1))[0]))
    assert (got["c"].spike_count, got["c"].mean_firing_rate, got["c"].median_isi_ms) == (0, 0.0, None)
    assert X.baseline(df.limit(0)).count() == 0


def test_step_up_windows(spark):
    on = np.arange(5_000_000, 5_500_000, 20_000)
    df = spikes(spark, {"on": on, "off": [10_100_000, 10_200_000], "base": range(1_000_000, 5_000_000, 100_000), "none": []})
    got = {r.unit_id: r for r in X.step_up(df).collect()}
    r = got["on"]
    assert r.on_response_flag and not r.off_response_flag and r.on_peak_value == 50.0 and r.on_latency_ms == 0.0 and r.off_latency_ms is None and r.on_off_ratio == 1.0 and r.response_quality == 1.0
    assert got["off"].off_peak_value == 4.0 and got["off"].off_latency_ms == 100.0 and got["off"].on_off_ratio == -1.0
    assert got["base"].baseline_rate == 10.0 and not got["base"].on_response_flag and got["base"].response_quality == 0


def test_cell_type_and_frames(spark):
    df = spikes(spark, {"a": range(0, 600 * 1000, 1000), "b": range(10)})
    w = [0.0] * 10 + [-9.0, 2.0, 5.0] + [0.0] * 10
    units = spark.createDataFrame([("d", "a", w), ("d", "b", w), ("d", "c", None)], "dataset_id string, unit_id string, waveform array<double>")
    got = {r.unit_id: r for r in X.cell_type(df, units).collect()}
    assert (got["a"].cell_type, got["a"].rgc_probability, got["a"].has_axon, got["a"].waveform_width_ms) == ("RGC", 0.8, True, 0.1)
    assert got["b"].cell_type == got["c"].cell_type == "unknown" and got["c"].rgc_probability == 0.0
    frames = spark.createDataFrame([("d", 0), ("d", 2000), ("d", 6000)], "dataset_id string, t_us long")
    rows = sorted((r.unit_id, r.edge_start, r.n, r.rate) for r in X.frame_rates(df, frames).collect())
    assert rows == [("a", 0, 2, 1000.0), ("a", 2000, 4, 1000.0), ("b", 0, 10, 5000.0)]


def test_traced_and_fitted_features(spark):
    trace = [0.0] * 700
    cube = np.zeros((6, 9, 9))
    yy, xx = np.mgrid[:9, :9]
    cube[3] = np.exp(-((yy - 4) ** 2 + (xx - 5) ** 2) / 4)
    traces = spark.createDataFrame([("d", "a", trace, trace, trace * 3), ("d", "b", None, None, None)], "dataset_id string, unit_id string, step_up_5s_5i_b0_3x array<double>, green_blue_3s_3i_3x array<double>, freq_step_5st_3x array<double>")
    stas = spark.createDataFrame([("d", "a", cube.ravel().tolist(), [6, 9, 9]), ("d", "b", None, None)], "dataset_id string, unit_id string, cube array<double>, shape array<int>")
    totals = spark.createDataFrame([("d", "a", [[9.0] * 3] + [[1.0] * 3] * 7), ("d", "b", None)], "dataset_id string, unit_id string, totals array<array<double>>")
    s = P.Session({"traces": traces, "stas": stas, "direction_rates": totals})
    got = P.extract_features(s, ["step_trace", "green_blue_3s_3i_3x", "freq_step_5st_3x", "perfect_dense_noise_15x15_15hz_r42_3min", "moving_h_bar_s5_d8_3x", "baseline_127", "no_such"])
    assert set(got.failed) == {"baseline_127", "no_such"} and "missing spikes" in got.failed["baseline_127"]
    rf = {r.unit_id: r for r in got.tables["perfect_dense_noise_15x15_15hz_r42_3min"].collect()}
    assert (rf["a"].center_row, rf["a"].center_col) == (4.0, 5.0) and abs(rf["a"].x0 - 5) < 0.1 and (rf["b"].x0 is None or math.isnan(rf["b"].x0))
    bar = {r.unit_id: r for r in got.tables["moving_h_bar_s5_d8_3x"].collect()}
    assert bar["a"].dsi > 0.8 and bar["a"].preferred == pytest.approx(0.0, abs=1e-6) and bar["a"].os_p < 0.05
    assert {r.unit_id for r in got.rows().collect()} == {"a", "b"}


def sorter_file(path, units, rate=20000.0):
    hdf5.write(str(path), {"@SamplingRate": rate, "Spike Sorter": {f"Unit {k}": {"Peaks": np.array(t, dtype=np.int64), "Source": np.array([222])} for k, t in units.items()}})


def test_a_flow_from_files_to_features_and_stores(spark, tmp_path):
    sorter_file(tmp_path / "2020.01.01-10.00.00-Rec.cmtr", {1: range(0, 10_000_000, 50_000), 2: []})
    sorter_file(tmp_path / "2020.01.02-10.00.00-Rec-.cmtr", {1: [100, 900]}, rate=-1.0)
    paths = [str(p) for p in tmp_path.glob("*.cmtr")]
    flow = {"name": "small", "stages": {"features": {"feature_sets": ["baseline_127", "step_up_5s_5i_3x", "cell_type_classifier", "green_blue_3s_3i_3x"]}}}
    out = str(tmp_path / "out")
    got = P.run_flow(spark, flow, out, paths[:])
    assert not got.success and list(got.extraction.failed) == ["green_blue_3s_3i_3x"]
    rows = spark.read.parquet(got.path)
    n = rows.count()
    assert {r.feature for r in rows.select("feature").distinct().collect()} == {"baseline_127", "step_up_5s_5i_3x", "cell_type_classifier"}
    assert {r.dataset_id for r in rows.select("dataset_id").distinct().collect()} == {"2020.01.01-10.00.00-Rec", "2020.01.02-10.00.00-Rec"}
    P.run_flow(spark, flow, out, paths)
    assert spark.read.parquet(got.path).count() == n  # nothing twice
    P.run_flow(spark, flow, out, paths, force=True)
    assert spark.read.parquet(got.path).count() == n
    wide = P.wide_features(spark.read.parquet(got.path), [("baseline_127", "spike_count"), ("step_up_5s_5i_3x", "baseline_rate")]).collect()
    assert {(r.unit_id, r.baseline_127__spike_count) for r in wide if r.dataset_id.startswith("2020.01.01")} == {("unit_001", 200.0), ("unit_002", None)}
    s = got.session
    assert {(r.dataset_id[:10], r.rate_replaced) for r in s.tables["recordings"].collect()} == {("2020.01.01", False), ("2020.01.02", True)}
    sheet = spark.createDataFrame([("2020.01.01.10.00.00.Rec.cmcr", "wt"), ("nothing", "x")], "File_name string, Genotype string")
    P.add_sheet(s, sheet, "File_name")
    assert {r.Genotype for r in s.tables["recordings"].collect()} == {"wt", None}
    spans = spark.createDataFrame([("2020.01.01-10.00.00-Rec", "m", 0, 0, 3000), ("2020.01.01-10.00.00-Rec", "m", 1, 3000, 4001)], "dataset_id string, movie string, trial_idx int, start long, end long")
    P.section_spikes(s, spans)
    assert sorted((r.trial_idx, r.spike_times) for r in s.tables["sections"].collect()) == [(0, [0, 1000, 2000]), (1, [3000, 4000])]
    s.tables["features"] = got.extraction.rows()
    assert {r.status for r in P.save_store(s, str(tmp_path / "h5")).collect()} == {"written"}
    back = P.load_store(spark, [str(p) for p in (tmp_path / "h5").glob("*.h5")], ["baseline_127"])
    assert {r.feature for r in back.tables["features"].collect()} == {"baseline_127"} and back.tables["units"].count() == 3
    batch = {r.dataset_id: r.status for r in P.run_batch(spark, flow, out, paths).collect()}
    assert set(batch.values()) == {"skipped"} and len(batch) == 2


def test_names_files_and_flows(spark, tmp_path):
    assert P.dataset_id("/a/b/2020.01.01-10.00.00-Rec--.CMTR") == "2020.01.01-10.00.00-Rec"
    for bad in ("", "/x/.cmtr", "a b"):
        with pytest.raises(ValueError):
            P.dataset_id(bad)
    with pytest.raises(ValueError):
        P.input_files(None, None)
    with pytest.raises(ValueError):
        P.input_files("a.txt", None)
    assert P.checked_rate(float("nan"))[0] == 20_000.0 and P.checked_rate(10_000.0) == (10_000.0, None)
    (tmp_path / "f.json").write_text(json.dumps({"name": "f", "stages": {"features": {"feature_sets": ["baseline_127", "zzz"]}}}))
    assert P.available_flows(str(tmp_path)) == ["f"] and P.flow_info("f", str(tmp_path))["unknown"] == ["zzz"]
    files = spark.createDataFrame([(p,) for p in ("/a/r1.cmcr", "/a/r1.cmtr", "/a/r2_sorted.cmtr", "/a/r2.cmcr", "/a/2020.01.01x.cmtr", "/a/2020.01.01z.cmcr", "/a/2020.01.01y.cmcr", "/b/r1.cmtr")], "path string")
    got = {r.sorted_path: (r.raw_path, r.how) for r in P.partner_files(files).collect()}
    assert got == {"/a/r1.cmtr": ("/a/r1.cmcr", "same"), "/a/r2_sorted.cmtr": ("/a/r2.cmcr", "suffix"), "/a/2020.01.01x.cmtr": ("/a/2020.01.01y.cmcr", "prefix"), "/b/r1.cmtr": (None, None)}


def test_electrode_images_against_plain_averages(spark, tmp_path):
    rng = np.random.default_rng(0)
    cube = rng.integers(-50, 50, (900, 4, 5)).astype("<i2")
    hdf5.write(str(tmp_path / "r.cmcr"), {"Acquisition": {"Sensor Data": {"SensorData 1 1": cube}}})
    from spikeloom.sources.stores import register_stores

    register_stores(spark)
    read = lambda rows: spark.read.format("sensor").option("path", str(tmp_path / "r.cmcr")).option("chunkrows", rows).option("overlap", 60).load()
    times = {"a": [3, 100, 255, 256, 300, 890], "b": [400], "c": []}
    sp = spark.createDataFrame([("r.cmcr", u, t) for u, ts in times.items() for t in ts], "file string, unit_id string, sample long")
    for rows in (256, 1000):
        # Without a filter and with the whole recording in view, chunks change nothing but each chunk's own mean.
        sums = electrode_sta.added(electrode_sta.window_sums(read(rows), sp, 10, 20, block=7))
        got = {r.unit_id: (np.array(r.average).reshape(r.shape), r.n_spikes) for r in electrode_sta.averages(sums).collect()}
        for u, ts in times.items():
            good = [t for t in ts if t - 10 >= 0 and t + 20 <= 900]
            assert (u in got) == bool(good)
            if good:
                assert got[u][1] == len(good) and np.allclose(got[u][0], np.mean([cube[t - 10 : t + 20] for t in good], 0))
    core = electrode_sta.window_sums(read(256), sp, 10, 20, inside_core=True).where("unit_id = 'a' AND block = 0")
    assert sum(r.n_spikes for r in core.collect()) == 2  # 100 and 300: the others' windows cross a chunk's edge
    assert sum(r.n_spikes for r in electrode_sta.window_sums(read(256), sp, 10, 20, limit=3).where("unit_id = 'a' AND block = 0").collect()) == 2
    x = electrode_sta.filtered(read(1000), 100.0, 2000.0).first()
    from spikeloom.functions.signal import butter_highpass

    want = butter_highpass(cube.reshape(900, -1).T.astype(float), 100.0, 2000.0).T.reshape(cube.shape)
    assert np.allclose(np.frombuffer(x.frames, "<f4").reshape(x.shape), want, atol=1e-2)
    kept = electrode_sta.cached(read(256), str(tmp_path / "cache"), "r", 900, rate=2000.0)
    assert kept.count() == 4 and electrode_sta.cached(read(256), str(tmp_path / "cache"), "r", 300, rate=2000.0).count() == 2
    with pytest.raises(ValueError):
        electrode_sta.filtered(read(256), 1500.0, 2000.0)
    images = electrode_sta.electrode_images(read(1000), sp, 10, 20, None)
    assert {r.unit_id for r in images.collect()} == {"a", "b"}


def test_snapshots_of_a_session(spark, tmp_path):
    s = P.Session({"units": spark.createDataFrame([(1, "a")], "k long, v string")})
    s.step("load", lambda x: None)
    assert s.checkpoint(str(tmp_path)).endswith("/load") and P.Session.load(spark, str(tmp_path / "load")).steps == ["load"]
    path = s.ensure_saved(str(tmp_path / "whole"))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "whole").rglob("*.parquet")}
    s.ensure_saved(path)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "whole").rglob("*.parquet")} == before
    s.put("units", spark.createDataFrame([(2, "b")], "k long, v string"), ["k"])
    s.step("more", lambda x: None)
    s.tables["units"] = s.tables["units"].persist()
    s.tables["units"].count()
    s.ensure_saved(path)
    assert P.Session.load(spark, path).tables["units"].count() == 2
