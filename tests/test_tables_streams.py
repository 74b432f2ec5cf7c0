import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.operators import clusters, pathways, population, rates, timeline
from spikeloom.plans.registry import Registry, Session, config_hash
from spikeloom.session import cut
from spikeloom.sources import readers, writers
from spikeloom.streaming import streams


def test_sections_and_trials(spark):
    movies = spark.createDataFrame([("p", 0, 600), ("p", 1, 1200), ("p", 2, 900), ("p", 3, None)], "p string, i int, n int")
    got = [(r.start_frame, r.end_frame, r.offset) for r in timeline.section_frames(movies, ["p"], "i", "n").orderBy("i").collect()]
    assert got == [(120, 901, 0), (1081, 2462, 961), (2642, 3723, 2522)]
    s = spark.createDataFrame([(0,)], "start int")
    t = timeline.trials(s, "start", F.lit(3), F.lit(720), F.lit(120), F.lit(3), F.lit(180))
    assert [r.trial_start for r in t.orderBy("trial_idx").collect()] == [180, 900, 1620, 2520, 3240, 3960, 4860, 5580, 6300]


def test_frame_lookup_and_onsets(spark):
    frames = spark.createDataFrame([("r", i, 100 * i) for i in range(5)], "r string, f long, s long")
    want = spark.createDataFrame([("r", f) for f in (0, 2, 4, -1, 10)], "r string, w long")
    assert sorted((r.w, r.s) for r in timeline.frame_to_sample(want, frames, ["r"], "w", "f", "s").collect()) == [(-1, 0), (0, 0), (2, 200), (4, 400), (10, 400)]
    x = spark.createDataFrame([("r", i, 1e7 if i >= 500 else 0.0) for i in range(1000)], "r string, i long, v double")
    assert [r.i for r in timeline.onset_frames(x, ["r"], "i", "v", 1e6).collect()] == [499]
    assert spark.range(1).select(timeline.microseconds_to_samples(F.lit(125.0), F.lit(20000.0)).alias("s")).first().s == 2


def test_rates(spark):
    e = spark.createDataFrame([("r", t) for t in (0.0, 4.9, 5.0, 25.0, 26.0, -1.0)], "r string, t double")
    got = [(r.bin_no, r.n) for r in rates.fixed_bin_rates(e, spark.createDataFrame([("r", 25.0), ("q", 0.0)], "r string, n double"), ["r"], "t", "n", 5.0).orderBy("bin_no").collect()]
    assert got == [(0, 2), (1, 1), (2, 0), (3, 0), (4, 1)]
    edges = spark.createDataFrame([("r", t) for t in (0.0, 5.0, 25.0, 25.0)], "r string, t2 double")
    assert sorted((r.edge_start, r.n) for r in rates.interval_rates(e, edges, ["r"], "t", "t2", 4.0).collect()) == [(0.0, 2), (5.0, 2)]
    a = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>")
    assert a.select(rates.pad_or_trim(F.col("a"), 5).alias("x"), rates.pad_or_trim(F.col("a"), 2).alias("y")).first().asDict() == {"x": [1, 2, 3, 0, 0], "y": [1, 2]}
    t = spark.createDataFrame([("u", 1, [1.0, 2.0]), ("u", 0, [5.0, 6.0, 7.0]), ("u", 2, None)], "u string, k int, a array<double>")
    assert rates.stack_trials(t, ["u"], "k", "a").first().trials == [[5, 6], [1, 2]]


def test_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.2, (150, 2)) for m in ((0, 0), (4, 4), (0, 5))])
    df = spark.createDataFrame([(i, float(a), float(b), [float(a), float(b), float(a + b)]) for i, (a, b) in enumerate(x)] + [(999, None, 1.0, None)], "id int, a double, b double, v array<double>")
    curve = clusters.bic_curve(df, ["a", "b"], [1, 2, 3, 4])
    assert clusters.choose_k([(k, b) for k, b, _ in curve], "min") in (3, 4)
    got = clusters.assign(df, ["a", "b"], clusters.fit_mixture(df, ["a", "b"], 3)).toPandas()
    assert got.loc[got.id == 999, "cluster"].isna().all()
    assert [got.loc[(got.id >= s) & (got.id < s + 150), "cluster"].nunique() for s in (0, 150, 300)] == [1, 1, 1]
    sil = clusters.centre_silhouette(clusters.assign(df.dropna(), ["a", "b"], clusters.fit_mixture(df, ["a", "b"], 3)), ["a", "b"], "cluster").collect()
    assert all(r.silhouette > 0.9 for r in sil)
    mean, comp, share = clusters.principal_components(df, "v", 2)
    assert share.sum() == pytest.approx(1, abs=1e-6) and comp.shape == (2, 3)
    s = df.dropna().select(clusters.project(F.col("v"), mean, comp).alias("p")).toPandas()
    assert np.stack(s.p.to_numpy()).mean(0) == pytest.approx([0, 0], abs=1e-9)
    assert clusters.choose_k([(1, 100.0), (2, 50.0), (3, 45.0), (4, 44.9)]) == 2
    z = clusters.standardized(df.dropna(), ["a"]).agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s")).first()
    assert (z.m, z.s) == (pytest.approx(0, abs=1e-9), pytest.approx(1))


def test_sparse_components_and_omitted_label(spark):
    got = clusters.hard_sparse(np.array([[3.0, -4.0, 1.0], [0.0, 0.0, 0.0]]), 2)
    assert got.tolist() == [[0.6, -0.8, 0.0], [0.0, 0.0, 0.0]]
    df = spark.createDataFrame([("g", 0, True), ("g", 0, False), ("g", 0, True), ("g", 1, False), ("g", 1, None)], "g string, c int, y boolean")
    r = population.binary_purity(df, ["g"], "c", F.col("y")).first()
    assert (r.n, r.purity) == (4, 0.75)


def test_pathways(spark):
    pts = spark.createDataFrame([("g", k, float(i), (k - 1.5) * (i - 33) + 20) for k in range(4) for i in range(12)], "g string, k int, x double, y double")
    lines = pathways.fitted_lines(pts, ["g", "k"], "x", "y")
    r = pathways.common_point(lines, ["g"], "slope", "intercept", "r2").first()
    assert (r.x, r.y, r.n_lines) == (pytest.approx(33), pytest.approx(20), 4)
    assert len(pathways.pair_intersections(np.array([1.0, 1.0, 2.0]), np.array([0.0, 1.0, 0.0]))) == 2
    p = np.array([[0, 0], [1, 1], [2, 0], [90, 90], [91, 90.0]])
    assert pathways.largest_dense_group(p).tolist() == [True, True, True, False, False]
    assert pathways.union_area(np.array([[0, 0], [100, 0.0]])) == pytest.approx(2 * np.pi * 9, rel=1e-3)
    assert pathways.union_area(np.array([[0, 0], [0, 0.0]])) == pytest.approx(np.pi * 9, rel=1e-3)


def test_readers(spark, tmp_path):
    (tmp_path / "playlist.csv").write_text('playlist_name,movie_names\nt,"[\'a.mov\', \'b.mov\']"\n')
    assert [(r.position, r.movie_name) for r in readers.playlist(spark, str(tmp_path / "playlist.csv")).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y.csv").write_text("b,c\n3,4\n")
    assert sorted((r.tab, r.a, r.b, r.c) for r in readers.tabs(spark, {"x": str(tmp_path / "x.csv"), "y": str(tmp_path / "y.csv")}).collect()) == [("x", "1", "2", None), ("y", None, "3", "4")]
    d = tmp_path / "stimuli"
    d.mkdir()
    (d / "good.json").write_text(json.dumps({"name": "good", "section_kwargs": {"start_frame": 0, "trial_length_frame": 5, "repeat": 1}}, indent=1))
    (d / "bad.json").write_text(json.dumps({"section_kwargs": {"start_frame": -1, "trial_length_frame": 5, "repeat": 1}}))
    good, bad = readers.stimulus_configs(spark, str(d))
    assert [r.movie for r in good.collect()] == ["good"] and "start_frame" in bad.first().error
    want = spark.createDataFrame([("good",), ("gone",)], "movie string")
    assert [r.movie for r in readers.missing_configs(want, good).collect()] == ["gone"]
    assert readers.files(spark, str(d), ["good"], ["bad"]).count() == 1
    np.save(tmp_path / "cube.npy", np.arange(24).reshape(4, 2, 3))
    readers.register_sources(spark)
    rows = spark.read.format("npy").option("path", str(tmp_path / "cube.npy")).option("chunkrows", "2").load().orderBy("idx").collect()
    assert len(rows) == 4 and rows[1].data == [6, 7, 8, 9, 10, 11]
    assert readers.flow_config({"name": "f"})["stages"]["features"]["enabled"]
    with pytest.raises(ValueError):
        readers.flow_config({})


def test_writers(spark, tmp_path):
    p = str(tmp_path / "units")
    writers.write_units(spark.createDataFrame([("a", 1), ("b", 2)], "dataset_id string, n int"), p)
    writers.write_units(spark.createDataFrame([("b", 3)], "dataset_id string, n int"), p)
    assert sorted((r.dataset_id, r.n) for r in spark.read.parquet(p).collect()) == [("a", 1), ("b", 3)]
    q = str(tmp_path / "features")
    writers.append_new(spark.createDataFrame([(1, 1.0)], "k int, v double"), q, ["k"])
    writers.append_new(spark.createDataFrame([(1, 9.0), (2, 2.0)], "k int, v double"), q, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(q).collect()) == [(1, 1.0), (2, 2.0)]
    writers.append_new(spark.createDataFrame([(1, 9.0)], "k int, v double"), q, ["k"], force=True)
    assert sorted((r.k, r.v) for r in spark.read.parquet(q).collect()) == [(1, 9.0), (2, 2.0)]
    f = writers.flat(spark.createDataFrame([(1, [1.0, 2.0]), (2, [float(i) for i in range(12)])], "k int, a array<double>"), ["k"]).orderBy("k").collect()
    assert f[0].a_1 == 2 and f[0].a_mean is None and f[1].a_0 is None and f[1].a_max == 11
    writers.export_features(spark.createDataFrame([(1, [1.0])], "k int, a array<double>"), str(tmp_path / "flat"), ["k"])
    assert sum(readers.parquet_info(str(p))["rows"] for p in (tmp_path / "flat").glob("*.parquet")) == 1
    assert cut(spark.range(3)).count() == 3


def test_registry_and_session(spark, tmp_path):
    reg = Registry()

    @reg.register("rate", ("units.n",), "k int, r double")
    def rate(units):
        return units.select("k", (F.col("n") / 2).alias("r"))

    with pytest.raises(ValueError):
        reg.register("rate", (), "k int")
    with pytest.raises(KeyError, match="rate"):
        reg.get("rat")
    s = Session()
    s.extract(reg, ["rate"])
    assert s.warnings == ["rate: missing units.n"]
    s.put("units", spark.createDataFrame([(1, 4)], "k int, n int"))
    s.put("units", spark.createDataFrame([(1, 6), (2, 8)], "k int, n int"), ["k"])
    assert s.step("features", lambda x: x.extract(reg, ["rate"])) and not s.step("features", lambda x: None)
    s.save(str(tmp_path / "out"))
    assert sorted((r.k, r.r) for r in spark.read.parquet(str(tmp_path / "out/feature_rate")).collect()) == [(1, 3.0), (2, 4.0)]
    back = Session.load(spark, str(tmp_path / "out"))
    assert back.steps == ["features"] and back.warnings == s.warnings and set(back.tables) == {"units", "feature_rate"}
    assert set(Session.load(spark, str(tmp_path / "out"), ["units"]).tables) == {"units"}
    assert config_hash({"b": 1, "a": 2}) == config_hash({"a": 2, "b": 1}) and reg.names() == ["rate"] and "rate" in reg


def test_streams_equal_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, i % 3, start + timedelta(seconds=37 * i)) for i in range(200)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "id long, u long, ts timestamp").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    streams.run_available(streams.tumbling_rates(stream(), ["u"], "ts", "5 minutes", "10 minutes"), str(tmp_path / "t"), str(tmp_path / "tc"))
    batch = {(r.u, r.w.start): r.n for r in spark.read.parquet(src).groupBy("u", F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n")).collect()}
    got = {(r.u, r.start): r.n for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got and all(batch[k] == n for k, n in got.items()) and len(got) >= len(batch) - 12  # the last windows wait for the watermark
    streams.run_available(streams.first_seen(stream().unionByName(stream()), ["id"], "ts", "1 day"), str(tmp_path / "d"), str(tmp_path / "dc"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 200
    streams.run_available(streams.islands(stream(), "u", "ts", 30_000_000), str(tmp_path / "i"), str(tmp_path / "ic"))
    assert spark.read.parquet(str(tmp_path / "i")).count() > 0
