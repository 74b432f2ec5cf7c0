from datetime import datetime

from spikeloom.operators import schema_drift as drift
from spikeloom.plans.training_queries import p1_wide

DDL = "snapshot_id long, rig string, movie string, exported_at timestamp_ntz, raw string, members string, _v string"


def at(i):
    return datetime(2020 + i // 12, 1 + i % 12, 1)


def docs(spark, raws, rig="r"):
    return spark.createDataFrame([(i, rig, "m", at(i), raw, "x", "y") for i, raw in enumerate(raws)], DDL)


def report(spark, raws):
    d = drift.documents_of(docs(spark, raws), "snapshot_id", ("rig", "movie"), "exported_at", "raw")
    return sorted((r.doc_key, r.field_path, r.change) for r in drift.changes(d, drift.fuse(d), 2).collect())


def test_changes(spark):
    raws = [
        '{"a": 1, "k": {"x": 1, "y": "t", "z": [1, 2]}}',
        '{"k": {"z": [1,2], "y": "t", "x": 1}, "a": 1}',  # other layout and order: none
        '{"a": 1.0, "k": {"x2": 1, "y": "t", "z": [1, 2]}}',  # retyped, renamed
        '{"a": 1.0, "k": {"y": null, "z": {"v": 1}, "n": 5, "o": 6}}',  # removed twice, retyped, added twice
        '{"a": 2.5, "k": {"z": {"v": 1}, "p": 5, "q": 5, "o": 6}}',  # two candidates for n: no renaming; a changes its value only
    ]
    assert report(spark, raws) == [
        (2, "a", "retyped"), (2, "k.x", "renamed"),
        (3, "k.n", "added"), (3, "k.o", "added"), (3, "k.x2", "removed"), (3, "k.y", "removed"), (3, "k.z", "retyped"),
        (4, "k.n", "removed"), (4, "k.p", "added"), (4, "k.q", "added"),
    ]


def test_same_names_at_two_levels_and_moves(spark):
    # A value that moves to another object is no renaming.
    assert report(spark, ['{"a.b": 1, "a": {"b": 2}}', '{"a": {"b": 2}, "c": {"b": 1}}']) == [(1, "a.b", "removed"), (1, "c.b", "added")]


def test_dirt_and_ties(spark):
    rows = [
        (5, None, "m", at(0), '{"a": 1}', "", ""), (3, None, "m", at(0), '{"a": 1}', "", ""),  # one document, named 3
        (6, None, "m", at(1), '{"a": ', "", ""), (7, None, "m", at(1), None, "", ""), (8, None, "m", at(1), "", "", ""), (9, None, "m", at(1), '{"a": 1} x', "", ""),
        (10, None, "m", at(2), '{"b": true}', "", ""), (11, None, "m", None, '{"zz": 1}', "", ""), (12, None, "m", at(3), "[1]", "", ""),
    ]
    d = drift.documents_of(spark.createDataFrame(rows, DDL), "snapshot_id", ("rig", "movie"), "exported_at", "raw")
    assert sorted(r.doc_key for r in d.collect()) == [3, 10, 11, 12]
    got = sorted((r.doc_key, r.field_path, r.change) for r in drift.changes(d, drift.fuse(d), 2).collect())
    assert got == [(10, "a", "removed"), (10, "b", "added"), (12, "b", "removed")]


def test_empty(spark):
    d = drift.documents_of(docs(spark, []), "snapshot_id", ("rig", "movie"), "exported_at", "raw")
    assert drift.changes(d, drift.fuse(d), 2).count() == 0 and drift.fuse(d).count() == 0 and drift.typed_branches(d, drift.fuse(d)).count() == 0


def test_union_schema_and_branches(spark):
    d = drift.documents_of(docs(spark, ['{"a": 1, "b": "x"}', '{"a": 1.5, "b": true}', '{"a": 12345678901234567890, "b": [1]}']), "snapshot_id", ("rig", "movie"), "exported_at", "raw")
    fused = {(r.path, r.tag): (r.n_documents, r.n_alternatives, r.canonical) for r in drift.fuse(d).collect()}
    assert fused == {("a", "integer"): (2, 2, "decimal"), ("a", "decimal"): (1, 2, "decimal"), ("b", "text"): (1, 3, "text"), ("b", "boolean"): (1, 3, "text"), ("b", "array"): (1, 3, "text")}
    rows = {(r.doc_key, r.path): r for r in drift.typed_branches(d, drift.fuse(d)).collect()}
    assert rows[0, "a"].as_integer == 1 and rows[0, "a"].as_decimal is None and float(rows[0, "a"].canonical_value) == 1.0
    assert rows[1, "a"].as_decimal == 1.5 and rows[0, "b"].as_text == "x" and rows[0, "b"].canonical_value == "x"
    assert rows[1, "b"].as_boolean is True and rows[2, "b"].as_json == "[1]"


def test_long_series_across_buckets(spark):
    raws = ['{"n": %s}' % (i if i % 2 else f"{i}.5") for i in range(40)]
    got = report(spark, raws)
    assert got == [(i, "n", "retyped") for i in range(1, 40)]  # each a bucket further on


def test_repeated_names_and_long_integers(spark):
    d = drift.documents_of(docs(spark, ['{"a": 1, "a": "x", "n": %s}' % ("7" * 42), '{"a": "y", "n": 1e40, "m": -3}', '{"n": %s.5}' % ("7" * 42)]), "snapshot_id", ("rig", "movie"), "exported_at", "raw")
    got = {(r.doc_key, m.path): m.tag for r in d.collect() for m in r.members}
    assert got == {(0, "a"): "text", (0, "n"): "integer", (1, "a"): "text", (1, "n"): "decimal", (1, "m"): "integer", (2, "n"): "decimal"}


def test_appearing_alternatives(spark):
    d = drift.documents_of(docs(spark, ['{"a": 1}', '{"a": 1.5, "b": 2}', '{"a": 2}', '{"b": "x"}']), "snapshot_id", ("rig", "movie"), "exported_at", "raw")
    got = {(r.path, r.tag): (r.doc_key, r.replaces) for r in drift.appearances(d, 2).collect()}
    assert got == {("a", "integer"): (0, False), ("a", "decimal"): (1, True), ("b", "integer"): (1, False), ("b", "text"): (3, True)}


def test_wide_table(spark):
    import pytest

    d = drift.documents_of(docs(spark, ['{"a": 1, "k": {"b": "x", "c d": [1, 2]}}', '{"a": 1.5, "k": {"b": true}}', "{}"]), "snapshot_id", ("rig", "movie"), "exported_at", "raw")
    rows = {r.doc_key: r for r in drift.wide_table(d, drift.fuse(d)).collect()}
    assert rows[0].__fields__ == ["doc_key", "a", "k.b", "k.c d"]
    assert rows[0]["a"].value == 1.0 and rows[0]["a"].as_integer == 1 and rows[0]["a"].as_decimal is None and rows[1]["a"].as_decimal == 1.5
    assert rows[0]["k.b"].value == "x" and rows[1]["k.b"].value == "true" and rows[1]["k.b"].as_boolean is True and rows[0]["k.c d"] == "[1,2]"
    assert rows[2]["a"] is None and rows[2]["k.b"] is None
    with pytest.raises(ValueError, match="more than 2"):
        drift.wide_table(d, drift.fuse(d), 2)


def test_wide_table_names(spark, tmp_path):
    raws = [
        '{"note": "x", "k": {"ab": 1}, "Snapshot_ID": 7, "a.b": 1, "a": {"b": "y"}}',  # one spelling at two levels, the key's name
        '{"NOTE": 5, "Note": "z", "k": {"AB": 2.5}, "note#2": "w"}',  # other letter case, the name of a second spelling
        '{"note": "v", "k": {"Ab": 1, "ab": true}}',
    ]
    docs(spark, raws).write.parquet(str(tmp_path / "stimulus_snapshots.parquet"))
    p1_wide(spark, str(tmp_path)).write.parquet(str(tmp_path / "wide"))  # refuses names that are the same but for letter case
    got = spark.read.parquet(str(tmp_path / "wide")).orderBy("snapshot_id")
    assert got.columns == ["snapshot_id", "NOTE#3", "Note#4", "Snapshot_ID#2", "a.b", "a.b#2", "k.AB#2", "k.Ab#3", "k.ab", "note", "note#2"]
    of = {f.name: (f.metadata["object"], f.metadata["path"]) for f in got.schema.fields[1:]}
    assert of["NOTE#3"] == (None, "NOTE") and of["note#2"] == (None, "note#2") and of["a.b"] == (None, "a.b") and of["a.b#2"] == ("a", "a.b") and of["k.Ab#3"] == ("k", "k.Ab")
    a, b, c = got.collect()
    assert (a["note"], a["NOTE#3"], a["Snapshot_ID#2"], a["k.ab"].as_integer, a["k.AB#2"]) == ("x", None, 7, 1, None)
    assert (a["a.b"].as_integer, a["a.b"].value, a["a.b#2"].as_text, a["a.b#2"].value) == (1, "1", "y", "y")
    assert (b["note"], b["NOTE#3"], b["Note#4"], b["k.AB#2"], b["k.ab"], b["note#2"], b["a.b"]) == (None, 5, "z", 2.5, None, "w", None)
    assert (c["note"], c["k.Ab#3"], c["k.ab"].as_boolean, c["k.AB#2"]) == ("v", 1, True, None)


def test_wide_table_names_with_letters_of_uneven_case(spark, tmp_path):
    names = ["ß", "ẞ", "ſ", "s", "ı", "I", "K", "k"]
    d = drift.documents_of(docs(spark, ["{%s}" % ", ".join(f'"{n}": {i}' for i, n in enumerate(names))]), "snapshot_id", ("rig", "movie"), "exported_at", "raw")
    drift.wide_table(d, drift.fuse(d)).write.parquet(str(tmp_path / "wide"))
    got = spark.read.parquet(str(tmp_path / "wide"))
    assert {f.metadata["path"]: got.first()[i + 1] for i, f in enumerate(got.schema.fields[1:])} == {n: i for i, n in enumerate(names)}


def test_wide_table_keeps_integers_of_any_length(spark):
    d = drift.documents_of(docs(spark, ['{"n": %s, "k": {"m": 1}}' % ("7" * 42), '{"n": %s, "k": {"m": %s}}' % ("7" * 38, "7" * 38)]), "snapshot_id", ("rig", "movie"), "exported_at", "raw")
    a, b = drift.wide_table(d, drift.fuse(d)).orderBy("doc_key").collect()
    assert float(a["n"]) == float("7" * 42) and b["n"] == "7" * 38 and (a["k.m"], b["k.m"]) == (1, int("7" * 38))
