"""Recording stores as tables: a generic scan of hierarchical files into nodes, tables made of nodes, and files made of them.

``nodes`` reads any number of files, a file per task, as one long table: a row
per dataset and attribute, its values in the column of their kind. Everything
else is a projection of that table (``units``, ``features``, ``metadata``,
``stimulus``, ``sections``, ``status``), so filters on paths reach the scan as
the ``under`` option, and nothing else of a file is read. ``write_files`` is
the inverse: node rows, made by the ``*_nodes`` functions, become a file per
recording.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spikeloom.sources import hdf5

NODE_SCHEMA = "file string, path string, kind string, shape array<int>, dtype string, ints array<bigint>, data array<double>, text array<string>, error string"
# How many electrodes a row of the array has; where sensor data lie in vendor files.
COLUMNS = 220
SENSOR_PATHS = ("Acquisition/Sensor Data/SensorData 1 1", "Acquisition/Sensor_Data/SensorData_1_1", "SensorData")


class _File(InputPartition):
    def __init__(self, path: str, start: int = 0, stop: int = 0):
        self.path, self.start, self.stop = path, start, stop


def _row(file: str, path: str, kind: str, value) -> tuple:
    a = np.asarray(value) if value is not None else np.zeros(0)
    flat = a.ravel()
    if a.dtype.names:
        raise hdf5.Unsupported("compound values; read them by field")
    ints = [int(x) for x in flat.tolist()] if a.dtype.kind in "iub" else None
    data = [float(x) for x in flat.tolist()] if a.dtype.kind == "f" else None
    text = [hdf5.plain(x) for x in flat.tolist()] if a.dtype.kind in "OSU" else None
    return (file, path, kind, [int(x) for x in a.shape], str(a.dtype), ints, data, text, None)


class _NodeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.under = [p for p in options.get("under", "").split(",") if p]
        self.values = options.get("values", "true").lower() == "true"
        self.largest = int(options.get("largest", 1 << 26))

    def partitions(self):
        return [_File(p) for p in self.paths]

    def _wanted(self, path: str) -> bool:
        return not self.under or any(fnmatch.fnmatch(path, u) or fnmatch.fnmatch(path, f"{u}/*") or fnmatch.fnmatch(path, f"{u}@*") for u in self.under)

    def _may_hold(self, group: str) -> bool:
        """Whether a wanted path may lie below a group: its parts match the beginning of a pattern, or a pattern covers it."""
        parts = group.split("/")
        for u in self.under:
            own = u.split("@")[0].split("/")
            if all(fnmatch.fnmatch(a, b) for a, b in zip(parts, own)):
                return True
        return not self.under

    def read(self, part):
        stem = part.path.rstrip("/").rsplit("/", 1)[-1]
        try:
            with hdf5.File(part.path) as f:
                yield from self._walk(stem, f, "")
        except (OSError, hdf5.Damaged, hdf5.Unsupported) as e:  # one bad file doesn't end the scan
            yield (stem, "", "error", [], "", None, None, None, f"{type(e).__name__}: {e}")

    def _walk(self, file: str, node: hdf5.Node, path: str) -> Iterator[tuple]:
        for k, v in node.attrs.items():
            if self._wanted(f"{path}@{k}"):
                yield _row(file, f"{path}@{k}", "attribute", v)
        for k, child in node.items():
            at = f"{path}/{k}".strip("/")
            if child.is_group:
                if self._may_hold(at):
                    if self._wanted(at):
                        yield (file, at, "group", [], "", None, None, None, None)
                    yield from self._walk(file, child, at)
            elif self._wanted(at):
                if not self.values:
                    yield (file, at, "dataset", list(child.shape), str(child.dtype), None, None, None, None)
                    continue
                if int(np.prod(child.shape, dtype=np.int64)) > self.largest:
                    raise hdf5.Unsupported(f"{at} has more than {self.largest} values; read it in chunks")
                yield _row(file, at, "dataset", child.read())
                for a, v in child.attrs.items():
                    yield _row(file, f"{at}@{a}", "attribute", v)


class NodeSource(DataSource):
    """``spark.read.format("store_nodes")``. Options: ``path`` (files, by commas), ``under`` (path patterns, by commas), ``values`` (false: a catalog only), ``largest``."""

    @classmethod
    def name(cls) -> str:
        return "store_nodes"

    def schema(self) -> str:
        return NODE_SCHEMA

    def reader(self, schema):
        return _NodeReader(self.options)


class _SorterReader(DataSourceReader):
    """Spike sorter output: the units of files, whatever of the known spellings they use."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, part):
        stem = part.path.rstrip("/").rsplit("/", 1)[-1]
        with hdf5.File(part.path) as f:
            top = {k: hdf5.plain(v) for k, v in f.attrs.items()}
            sorter = next((c for k, c in f.items() if k.replace("_", " ").lower() == "spike sorter"), None)
            rate = next((float(v) for k, v in top.items() if k.replace("_", "").lower() in ("samplingrate", "samplerate", "acquisitionrate")), None)
            recording = next((str(v) for k, v in top.items() if k in ("recording_id", "RecordingID")), None)
            for name, unit in sorter.items() if sorter is not None else ():
                head, _, number = name.replace("_", " ").partition(" ")
                if head != "Unit" or not number.isdigit() or not unit.is_group:
                    continue
                times, wave, gid = [], None, int(number)
                for k, child in unit.items():
                    key = k.lower()
                    if key.startswith("peaks") and "cutout" not in key and not child.is_group:
                        a = child.read()
                        times = a["Timestamp"].tolist() if a.dtype.names else a.ravel().tolist()
                    if "cutout" in key and not child.is_group:
                        a = np.asarray(child.read(), dtype=float)
                        wave = a.mean(0).ravel().tolist() if a.ndim > 1 and len(a) else None
                    if key == "source":
                        a = np.asarray(child.read()).ravel()
                        gid = int(a[0]) if len(a) and a[0] else gid
                meta = {k: str(hdf5.plain(v)) for k, v in unit.attrs.items()}
                yield (stem, recording, f"unit_{int(number):03d}", gid // COLUMNS, gid % COLUMNS, gid, wave, [int(t) for t in times], rate, meta)


class SorterSource(DataSource):
    """``spark.read.format("sorter")``: a row per unit of sorter files; ``path`` holds files by commas."""

    @classmethod
    def name(cls) -> str:
        return "sorter"

    def schema(self) -> str:
        return "file string, recording string, unit_id string, row int, col int, global_id int, waveform array<double>, spike_us array<bigint>, acquisition_rate double, meta map<string,string>"

    def reader(self, schema):
        return _SorterReader(self.options)


class _SensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows, self.overlap = options["path"], int(options.get("chunkrows", 4096)), int(options.get("overlap", 0))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.at = options.get("dataset")

    def _dataset(self, f: hdf5.File) -> hdf5.Node:
        for p in [self.at] if self.at else SENSOR_PATHS:
            node = f.get(p)
            if node is not None and not node.is_group:
                return node
        for path, kind, _, _ in hdf5.tree(f):
            if kind == "dataset" and path.rsplit("/", 1)[-1].startswith("SensorData"):
                return f[path]
        raise hdf5.Damaged(f"no sensor data in {self.path}")

    def partitions(self):
        with hdf5.File(self.path) as f:
            n = self._dataset(f).shape[0]
        n = n if self.limit is None else min(n, self.limit)
        return [_File(self.path, s, min(s + self.rows, n)) for s in range(0, n, self.rows)] or [_File(self.path)]

    def read(self, part):
        if part.stop <= part.start:
            return
        with hdf5.File(part.path) as f:
            node = self._dataset(f)
            lo, hi = max(0, part.start - self.overlap), min(node.shape[0], part.stop + self.overlap)
            a = np.asarray(node.read(lo, hi))
            yield (part.path.rsplit("/", 1)[-1], part.start, part.stop, lo, [int(x) for x in a.shape], a.astype("<i2" if a.dtype.kind in "iu" and a.itemsize <= 2 else "<f4").tobytes(), "i2" if a.dtype.kind in "iu" and a.itemsize <= 2 else "f4")


class SensorSource(DataSource):
    """``spark.read.format("sensor")``: a time by row by column cube in chunks, a chunk per task, with ``overlap`` samples on either side.

    Options: ``path``, ``chunkrows``, ``overlap``, ``limit`` (samples in all),
    ``dataset`` (its path, else the known ones). ``start`` and ``stop`` bound
    the chunk's own samples, ``first`` is the first sample in ``frames``.
    """

    @classmethod
    def name(cls) -> str:
        return "sensor"

    def schema(self) -> str:
        return "file string, start bigint, stop bigint, first bigint, shape array<int>, frames binary, dtype string"

    def reader(self, schema):
        return _SensorReader(self.options)


def register_stores(spark: SparkSession) -> None:
    for source in (NodeSource, SorterSource, SensorSource):
        spark.dataSource.register(source)


def nodes(spark: SparkSession, paths: list[str], under: list[str] | None = None, values: bool = True) -> DataFrame:
    """The nodes of files. ``under`` takes only paths that match a pattern, or lie below one that does."""
    register_stores(spark)
    read = spark.read.format("store_nodes").option("path", ",".join(paths)).option("values", str(values).lower())
    return (read.option("under", ",".join(under)) if under else read).load()


# -- tables of nodes -------------------------------------------------------------------------------------------------


def _id(file: Column) -> Column:
    return F.regexp_replace(file, r"\.(h5|hdf5)$", "")


def _part(i: int) -> Column:
    return F.get(F.split(F.regexp_replace("path", "@.*$", ""), "/"), i)


def _tail(i: int) -> Column:
    """The path from part ``i`` on, an attribute's name as the last part."""
    parts = F.split(F.replace(F.col("path"), F.lit("@"), F.lit("/")), "/")
    return F.array_join(F.slice(parts, i + 1, F.greatest(F.size(parts) - i, F.lit(0))), ".")


def _number() -> Column:
    """A node's only number."""
    return F.when(F.size(F.coalesce("ints", F.array().cast("array<bigint>"))) == 1, F.get("ints", 0).cast("double")).when(F.size(F.coalesce("data", F.array().cast("array<double>"))) == 1, F.get("data", 0))


def _doubles() -> Column:
    return F.coalesce("data", F.col("ints").cast("array<double>"))


def units(n: DataFrame) -> DataFrame:
    """``dataset_id, unit_id, row, col, global_id, waveform, spike_times``; a field that a unit lacks is NULL."""
    own = n.where(F.col("path").rlike(r"^units/[^/@]+(@(row|col|global_id)|/(spike_times|waveform))$"))
    last = F.regexp_extract("path", "[@/]([^@/]+)$", 1)
    pick = lambda name, value: F.max(F.when(last == name, value)).alias(name)
    return own.groupBy(_id(F.col("file")).alias("dataset_id"), _part(1).alias("unit_id")).agg(*[pick(c, _number().cast("int")) for c in ("row", "col", "global_id")], pick("waveform", _doubles()), pick("spike_times", F.col("ints")))


def features(n: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``dataset_id, unit_id, feature, field, value, data, shape, text``: a row per field; nested groups join their names with a point."""
    own = n.where(F.col("path").rlike(r"^units/[^/@]+/features/[^/@]+[/@]") & F.col("kind").isin("dataset", "attribute"))
    own = own.where(_part(3).isin(names)) if names else own
    return own.select(_id(F.col("file")).alias("dataset_id"), _part(1).alias("unit_id"), _part(3).alias("feature"), _tail(4).alias("field"), _number().alias("value"), _doubles().alias("data"), "shape", F.get("text", 0).alias("text"))


def metadata(n: DataFrame) -> DataFrame:
    """``dataset_id, field, value, text, data``: what lies in the metadata group, and the file's own attributes."""
    own = n.where(F.col("path").startswith("metadata/") | F.col("path").startswith("@")).where(F.col("kind").isin("dataset", "attribute"))
    field = F.when(F.col("path").startswith("@"), F.substring("path", 2, 1 << 20)).otherwise(_tail(1))
    return own.select(_id(F.col("file")).alias("dataset_id"), field.alias("field"), _number().alias("value"), F.get("text", 0).alias("text"), _doubles().alias("data"))


def stimulus(n: DataFrame) -> DataFrame:
    """``dataset_id, kind, name, data, shape``: light references, frame times and section times."""
    own = n.where(F.col("path").rlike("^stimulus/[^/@]+/[^/@]+$") & (F.col("kind") == "dataset"))
    return own.select(_id(F.col("file")).alias("dataset_id"), _part(1).alias("kind"), _part(2).alias("name"), _doubles().alias("data"), "shape")


def sections(n: DataFrame) -> DataFrame:
    """``dataset_id, unit_id, movie, trial_idx, spike_times``: the sectioned spikes of units."""
    own = n.where(F.col("path").rlike(r"^units/[^/@]+/spike_times_sectioned/[^/@]+/trials_spike_times/[0-9]+$"))
    return own.select(_id(F.col("file")).alias("dataset_id"), _part(1).alias("unit_id"), _part(3).alias("movie"), _part(5).cast("int").alias("trial_idx"), F.col("ints").alias("spike_times"))


def status(n: DataFrame) -> DataFrame:
    """A row per file: ``dataset_id, stage1_completed, params_hash, n_units, features, error``."""
    attr = lambda name, value: F.max(F.when(F.col("path") == f"@{name}", value))
    return n.groupBy(_id(F.col("file")).alias("dataset_id")).agg(
        (attr("stage1_completed", F.get("ints", 0)) == 1).alias("stage1_completed"), attr("stage1_params_hash", F.get("text", 0)).alias("params_hash"),
        F.count_distinct(F.when(F.col("path").rlike("^units/[^/@]+$"), F.col("path"))).alias("n_units"),
        F.sort_array(F.collect_set(F.when(F.col("path").rlike("^units/[^/@]+/features/[^/@]+$"), _part(3)))).alias("features"),  # as many as there are features
        F.max("error").alias("error"),
    )


def cataloged(n: DataFrame) -> DataFrame:
    """A tree of a file as a table: ``dataset_id, path, kind, depth, shape, dtype``."""
    return n.where("kind <> 'error'").select(_id(F.col("file")).alias("dataset_id"), "path", "kind", F.size(F.split("path", "/")).alias("depth"), "shape", "dtype")


# -- nodes of tables -------------------------------------------------------------------------------------------------


def _node(df: DataFrame, path: Column, kind: str, ints: Column | None = None, data: Column | None = None, text: Column | None = None, shape: Column | None = None) -> DataFrame:
    value = ints if ints is not None else data if data is not None else text
    shape = shape if shape is not None else F.array(F.size(value)) if kind == "dataset" else F.array().cast("array<int>")
    got = df.where(value.isNotNull()) if value is not None else df
    return got.select(
        F.concat("dataset_id", F.lit(".h5")).alias("file"), path.alias("path"), F.lit(kind).alias("kind"), shape.cast("array<int>").alias("shape"), F.lit("int64" if ints is not None else "float64" if data is not None else "text").alias("dtype"),
        (ints if ints is not None else F.lit(None)).cast("array<bigint>").alias("ints"), (data if data is not None else F.lit(None)).cast("array<double>").alias("data"), (text if text is not None else F.lit(None)).cast("array<string>").alias("text"), F.lit(None).cast("string").alias("error"),
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unit_nodes(df: DataFrame) -> DataFrame:
    """Nodes of a unit table as ``units`` returns it."""
    base = F.concat(F.lit("units/"), "unit_id")
    parts = [_node(df, F.concat(base, F.lit(f"@{c}")), "attribute", ints=F.when(F.col(c).isNotNull(), F.array(c))) for c in ("row", "col", "global_id") if c in df.columns]
    parts.append(_node(df, F.concat(base, F.lit("@spike_count")), "attribute", ints=F.array(F.size(F.coalesce("spike_times", F.array().cast("array<bigint>"))))))
    return _all([*parts, _node(df, F.concat(base, F.lit("/spike_times")), "dataset", ints=F.col("spike_times")), _node(df, F.concat(base, F.lit("/waveform")), "dataset", data=F.col("waveform"))])


def feature_nodes(df: DataFrame) -> DataFrame:
    """Nodes of a feature table: ``dataset_id, unit_id, feature, field`` with ``value``, or ``data`` and optionally its ``shape``."""
    base = F.concat(F.lit("units/"), "unit_id", F.lit("/features/"), "feature")
    parts = []
    if "value" in df.columns:
        parts.append(_node(df.where("value IS NOT NULL"), F.concat(base, F.lit("@"), F.replace("field", F.lit("."), F.lit("_"))), "attribute", data=F.array("value")))
    if "data" in df.columns:
        arrays = df.where("size(data) <> 1 OR value IS NULL") if "value" in df.columns else df
        parts.append(_node(arrays, F.concat(base, F.lit("/"), F.replace("field", F.lit("."), F.lit("/"))), "dataset", data=F.col("data"), shape=F.col("shape") if "shape" in df.columns else None))
    return _all(parts)


def metadata_nodes(df: DataFrame) -> DataFrame:
    """Nodes of ``dataset_id, field`` with ``value`` or ``text``."""
    path = F.concat(F.lit("metadata/"), F.replace("field", F.lit("."), F.lit("/")))
    one = F.array(F.lit(1))
    return _all([_node(df.where("text IS NULL"), path, "dataset", data=F.when(F.col("value").isNotNull(), F.array("value")), shape=one), _node(df, path, "dataset", text=F.when(F.col("text").isNotNull(), F.array("text")), shape=one)])


def stimulus_nodes(df: DataFrame) -> DataFrame:
    return _node(df, F.concat(F.lit("stimulus/"), "kind", F.lit("/"), "name"), "dataset", data=F.col("data"), shape=F.col("shape") if "shape" in df.columns else None)


def section_nodes(df: DataFrame) -> DataFrame:
    """Nodes of sectioned spikes: each trial's, and all of a movie's in order."""
    base = F.concat(F.lit("units/"), "unit_id", F.lit("/spike_times_sectioned/"), "movie")
    whole = df.groupBy("dataset_id", "unit_id", "movie").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spike_times")))).alias("spike_times"))  # a unit's spikes in a movie
    return _all([_node(df, F.concat(base, F.lit("/trials_spike_times/"), F.col("trial_idx").cast("string")), "dataset", ints=F.col("spike_times")), _node(whole, F.concat(base, F.lit("/full_spike_times")), "dataset", ints=F.col("spike_times"))])


def header_nodes(df: DataFrame, params_hash: str = "", completed: bool = True) -> DataFrame:
    """The attributes of the file itself for each ``dataset_id``."""
    ids = df.select("dataset_id").distinct()
    attr = lambda name, **value: _node(ids, F.lit(f"@{name}"), "attribute", **value)
    return _all([attr("dataset_id", text=F.array("dataset_id")), attr("stage1_params_hash", text=F.array(F.lit(params_hash))), attr("stage1_completed", ints=F.array(F.lit(int(completed))))])


def write_files(n: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Write node rows as a file per recording under ``folder``: ``file, n_nodes, bytes, status``.

    The result is lazy: the files are written where it is read. Files that
    exist are left (``status`` is ``kept``) unless ``overwrite``. Each file is
    put under a name of its own and moved to its place, so a task that is
    repeated or lost leaves no half a file. Of repeated paths the last counts.
    A recording's file is built by one task; its size is bounded by a recording's.
    """
    from pyarrow import fs

    def build(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import uuid

        name = keys[0]
        target = f"{folder.rstrip('/')}/{name}"
        system, at = fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (fs.LocalFileSystem(), target)
        if not overwrite and system.get_file_info(at).type != fs.FileType.NotFound:
            return pd.DataFrame([(name, len(rows), 0, "kept")], columns=["file", "n_nodes", "bytes", "status"])
        top: dict = {"units": {}, "stimulus": {}, "metadata": {}}
        for r in rows.sort_values("path", kind="stable").itertuples():
            if r.kind == "error":
                continue
            value = r.text if r.text is not None else np.asarray(r.ints, dtype=np.int64) if r.ints is not None else np.asarray(r.data, dtype=float) if r.data is not None else None
            if value is not None:
                shape = tuple(int(x) for x in r.shape) if r.shape is not None else ()
                a = np.asarray(value, dtype=object if r.text is not None else None)
                value = a.reshape(shape) if int(np.prod(shape)) == a.size else a
            path, _, attr = r.path.partition("@")
            here = top
            parts = [p for p in path.split("/") if p]
            for p in parts if attr or r.kind == "group" else parts[:-1]:
                here = here.setdefault(p, {})
                if not isinstance(here, dict):
                    break
            if not isinstance(here, dict):
                continue  # an attribute of a dataset
            if attr:
                here[f"@{attr}"] = value[()] if value is not None and value.ndim == 0 else value
            elif r.kind != "group":
                here[parts[-1]] = value
        raw = hdf5.Writer().build(top)
        parent = at.rsplit("/", 1)[0]
        system.create_dir(parent, recursive=True)
        aside = f"{parent}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as f:
            f.write(raw)
        system.move(aside, at)
        return pd.DataFrame([(name, len(rows), len(raw), "written")], columns=["file", "n_nodes", "bytes", "status"])

    return n.where("path IS NOT NULL").groupBy("file").applyInPandas(build, "file string, n_nodes long, bytes long, status string")


def mini(n: DataFrame, keep: list[str]) -> DataFrame:
    """The nodes whose paths match a pattern of ``keep`` (``*`` for any characters), for a smaller copy of files."""
    wanted = F.lit(False)
    for k in keep:
        pattern = "^" + "".join(".*" if c == "*" else "\\" + c if not c.isalnum() and c not in "_/@" else c for c in k) + "($|[/@])"
        wanted = wanted | F.col("path").rlike(pattern)
    return n.where(wanted | F.col("path").startswith("@"))


def moved(n: DataFrame, old: str, new: str) -> DataFrame:
    """The group ``old`` and all below it under the name ``new``; other nodes stay."""
    inside = (F.col("path") == old) | F.col("path").startswith(f"{old}/") | F.col("path").startswith(f"{old}@")
    return n.withColumn("path", F.when(inside, F.concat(F.lit(new), F.expr(f"substring(path, {len(old) + 1})"))).otherwise(F.col("path")))
