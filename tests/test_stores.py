import struct
import zlib

import numpy as np
import pytest

from spikeloom.sources import hdf5, stores


def test_round_trip_of_all_kinds(tmp_path):
    peaks = np.zeros(4, dtype=[("Flag", "i1"), ("Timestamp", "<i8")])
    peaks["Timestamp"] = [5, 9, 12, 40]
    tree = {
        "@rate": 20000.0, "@done": True, "@name": "ä", "@list": np.arange(3.0),
        "units": {f"unit_{i:03d}": {"@row": i, "spike_times": np.arange(3 * i, dtype=np.uint64), "w": np.sin(np.arange(50, dtype=np.float32))} for i in range(150)},
        "meta": {"names": ["a", "bcd", ""], "deep": {"m": np.arange(12).reshape(3, 4), "none": None}}, "peaks": peaks, "empty": {},
    }
    path = str(tmp_path / "a" / "t.h5")
    hdf5.write(path, tree)
    with hdf5.File(path) as f:
        assert f.attrs["rate"] == 20000.0 and f.attrs["done"] and f.attrs["name"] == "ä" and f.attrs["list"].tolist() == [0, 1, 2]
        assert len(f["units"].keys()) == 150 and f["units/unit_149"].attrs["row"] == 149
        assert f["units/unit_020/spike_times"].read(4, 7).tolist() == [4, 5, 6] and f["units/unit_000/spike_times"].read().size == 0
        assert f["meta/deep/m"].read(1, 2).tolist() == [[4, 5, 6, 7]] and f.get("meta/deep/none") is None and f.get("meta/x/y") is None
        assert f["peaks"].read()["Timestamp"].tolist() == [5, 9, 12, 40]
        assert hdf5.nested(f["meta"]) == {"names": ["a", "bcd", ""], "deep": {"m": [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]}}
        assert ("/meta/deep/m", "dataset", (3, 4), "int64") in list(hdf5.tree(f))
    with pytest.raises(KeyError), hdf5.File(path) as f:
        f["nothing"]
    (tmp_path / "b.h5").write_bytes(b"no such file" * 20)
    with pytest.raises(hdf5.Damaged):
        hdf5.File(str(tmp_path / "b.h5"))


def test_chunked_filtered_data_and_variable_strings(tmp_path):
    """Structures that the writer doesn't make, put together by hand."""
    w = hdf5.Writer()
    a = np.arange(7 * 5, dtype="<i4").reshape(7, 5)
    chunks = []
    for r in range(0, 7, 3):
        for c in range(0, 5, 4):
            block = np.zeros((3, 4), "<i4")
            part = a[r : r + 3, c : c + 4]
            block[: part.shape[0], : part.shape[1]] = part
            raw = zlib.compress(np.frombuffer(block.tobytes(), np.uint8).reshape(-1, 4).T.tobytes())
            chunks.append((len(raw), r, c, w._put(raw)))
    body = b"".join(struct.pack("<IIQQQQ", n, 0, r, c, 0, at) for n, r, c, at in chunks) + struct.pack("<IIQQQ", 0, 0, 9, 0, 0)
    tree = w._put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(chunks), hdf5.NONE, hdf5.NONE) + body)
    filters = struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", 2, 0, 0, 1, 4) + struct.pack("<HHHHI4x", 1, 0, 0, 1, 6)
    cube = w._header([(0x01, hdf5._space_of(a)), (0x03, hdf5._type_of(a)), (0x0B, filters), (0x08, struct.pack("<BBBQIII", 3, 2, 3, tree, 3, 4, 4))])
    words = [b"one", "zwölf".encode(), b""]
    held = b"".join(struct.pack("<HHIQ", i + 1, 1, 0, len(x)) + x + bytes(-len(x) % 8) for i, x in enumerate(words) if x)
    heap = w._put(b"GCOL" + struct.pack("<BxxxQ", 1, 16 + len(held) + 16) + held + bytes(16))
    refs = w._put(b"".join(struct.pack("<IQI", len(x), heap if x else 0, i + 1) for i, x in enumerate(words)))
    kind = struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + struct.pack("<BBBBI", 0x13, 0, 0, 0, 1)
    text = w._header([(0x01, struct.pack("<BBBB4xQ", 1, 1, 0, 0, 3)), (0x03, kind), (0x08, struct.pack("<BBQQ", 3, 1, refs, 48))])
    w._dataset = lambda v: {"cube": cube, "text": text}[v]
    path = tmp_path / "c.h5"
    path.write_bytes(w.build({"x": "cube", "y": "text"}))
    with hdf5.File(str(path)) as f:
        assert f["x"].read().tolist() == a.tolist() and f["x"].read(2, 5).tolist() == a[2:5].tolist()
        assert f["y"].read().tolist() == ["one", "zwölf", ""]


def units(spark):
    rows = [("2020.01.01-10.00.00-Rec", f"unit_{i:03d}", i, 2 * i, 222 * i, [0.5 * i] * 4, list(range(i))) for i in range(5)] + [("2020.01.02-10.00.00-Rec", "unit_001", None, 7, None, None, None)]
    return spark.createDataFrame(rows, "dataset_id string, unit_id string, row int, col int, global_id int, waveform array<double>, spike_times array<bigint>")


def test_tables_to_files_and_back(spark, tmp_path):
    u = units(spark)
    feats = spark.createDataFrame([("2020.01.01-10.00.00-Rec", "unit_001", "step_up", "on.peak", 1.5, None), ("2020.01.01-10.00.00-Rec", "unit_001", "sta", "map", None, [1.0, 2.0, 3.0])], "dataset_id string, unit_id string, feature string, field string, value double, data array<double>")
    meta = spark.createDataFrame([("2020.01.01-10.00.00-Rec", "rate", 20000.0, None), ("2020.01.01-10.00.00-Rec", "sheet.genotype", None, "wt")], "dataset_id string, field string, value double, text string")
    stim = spark.createDataFrame([("2020.01.01-10.00.00-Rec", "frame_time", "movie", [0.0, 333.0])], "dataset_id string, kind string, name string, data array<double>")
    sect = spark.createDataFrame([("2020.01.01-10.00.00-Rec", "unit_002", "movie", 0, [1, 5]), ("2020.01.01-10.00.00-Rec", "unit_002", "movie", 1, [5, 9])], "dataset_id string, unit_id string, movie string, trial_idx int, spike_times array<bigint>")
    n = stores._all([stores.unit_nodes(u), stores.feature_nodes(feats), stores.metadata_nodes(meta), stores.stimulus_nodes(stim), stores.section_nodes(sect), stores.header_nodes(u, "abc")])
    report = {r.file: r.status for r in stores.write_files(n, str(tmp_path / "out")).collect()}
    assert set(report.values()) == {"written"} and len(report) == 2
    assert {r.status for r in stores.write_files(n, str(tmp_path / "out")).collect()} == {"kept"}
    (tmp_path / "out" / "broken.h5").write_bytes(b"x")
    paths = sorted(str(p) for p in (tmp_path / "out").glob("*.h5"))
    back = stores.nodes(spark, paths)
    key = lambda df: sorted(map(tuple, df.select("dataset_id", "unit_id", "row", "col", "global_id", "waveform", "spike_times").collect()), key=str)
    assert key(stores.units(back)) == key(u)
    got = {(r.feature, r.field): r.value if r.value is not None else r.data for r in stores.features(back).collect()}
    assert got == {("step_up", "on_peak"): 1.5, ("sta", "map"): [1.0, 2.0, 3.0]}
    assert [r.feature for r in stores.features(back, ["sta"]).collect()] == ["sta"]
    m = {r.field: r.text or r.value for r in stores.metadata(back).where("dataset_id LIKE '2020.01.01%'").collect()}
    assert m["rate"] == 20000.0 and m["sheet.genotype"] == "wt" and m["dataset_id"].startswith("2020.01.01")
    assert [(r.kind, r.name, r.data) for r in stores.stimulus(back).collect()] == [("frame_time", "movie", [0.0, 333.0])]
    assert sorted((r.trial_idx, r.spike_times) for r in stores.sections(back).collect()) == [(0, [1, 5]), (1, [5, 9])]
    s = {r.dataset_id: r for r in stores.status(back).collect()}
    assert s["2020.01.01-10.00.00-Rec"].stage1_completed and s["2020.01.01-10.00.00-Rec"].params_hash == "abc" and s["2020.01.01-10.00.00-Rec"].n_units == 5
    assert s["2020.01.01-10.00.00-Rec"].features == ["sta", "step_up"] and "Damaged" in s["broken"].error
    # What the scan reads is what was asked for.
    some = stores.nodes(spark, paths[:1], ["units/unit_001/waveform", "units/*@row"]).collect()
    assert {r.path for r in some if r.kind != "group"} == {"units/unit_001/waveform", *[f"units/unit_{i:03d}@row" for i in range(5)]}
    assert all(r.ints is None and r.data is None for r in stores.nodes(spark, paths[:1], values=False).where("kind = 'dataset'").collect())
    small = stores.moved(stores.mini(back, ["units/unit_001"]), "units/unit_001", "units/unit_901")
    stores.write_files(small.where("file LIKE '2020.01.01%'"), str(tmp_path / "mini")).collect()
    assert [r.unit_id for r in stores.units(stores.nodes(spark, [str(p) for p in (tmp_path / "mini").glob("*.h5")])).collect()] == ["unit_901"]


def test_sorter_and_sensor_files(spark, tmp_path):
    peaks = np.zeros(3, dtype=[("IncludePeak", "i1"), ("Timestamp", "<i8")])
    peaks["Timestamp"] = [100, 250, 400]
    sorter = {"@RecordingID": "r1", "@SamplingRate": 20000.0, "Spike Sorter": {"Unit 7": {"@Quality": 0.5, "Peaks": peaks, "PeaksCutouts": np.arange(6.0).reshape(3, 2), "Source": np.array([443])}, "Unit Info": {}}}
    hdf5.write(str(tmp_path / "a.cmtr"), sorter)
    cube = np.arange(10 * 2 * 3, dtype="<i2").reshape(10, 2, 3)
    hdf5.write(str(tmp_path / "a.cmcr"), {"Acquisition": {"Sensor Data": {"SensorData 1 1": cube}}})
    stores.register_stores(spark)
    (u,) = spark.read.format("sorter").option("path", str(tmp_path / "a.cmtr")).load().collect()
    assert (u.unit_id, u.row, u.col, u.global_id, u.spike_us, u.waveform, u.acquisition_rate, u.recording, u.meta["Quality"]) == ("unit_007", 2, 3, 443, [100, 250, 400], [2.0, 3.0], 20000.0, "r1", "0.5")
    rows = spark.read.format("sensor").option("path", str(tmp_path / "a.cmcr")).option("chunkrows", 4).option("overlap", 1).load().collect()
    assert sorted((r.start, r.stop, r.first, r.shape) for r in rows) == [(0, 4, 0, [5, 2, 3]), (4, 8, 3, [6, 2, 3]), (8, 10, 7, [3, 2, 3])]
    r = next(r for r in rows if r.start == 4)
    assert np.frombuffer(r.frames, "<i2").reshape(r.shape).tolist() == cube[3:9].tolist()
    assert spark.read.format("sensor").option("path", str(tmp_path / "a.cmcr")).option("limit", 5).load().count() == 1
