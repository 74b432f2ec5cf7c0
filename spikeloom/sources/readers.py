"""Readers: tables, playlists, movie lengths, stimulus configurations, file listings, footers, array files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spikeloom.functions.names import has_words, playlist_movies
from spikeloom.sources.hdf5 import open_input
from spikeloom.sources.stores import register_stores

CONFIG_SCHEMA = "name string, section_kwargs struct<start_frame: int, trial_length_frame: int, repeat: int, group_count: int, group_gap: int>"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL: the boundary rule, as Spark orders NaN above all numbers."""
    cols = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def cell_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A cell table with its required key columns; ``columns`` prunes the scan."""
    df = spark.read.parquet(path)
    lacking = {"dataset_id", "unit_id"} - set(df.columns)
    if lacking:
        raise ValueError(f"{path} lacks {sorted(lacking)}")
    return nan_to_null(df.select(*dict.fromkeys(["dataset_id", "unit_id", *columns])) if columns else df)


def playlist(spark: SparkSession, path: str) -> DataFrame:
    """``playlist_name, position, movie_name`` of a playlist CSV."""
    rows = spark.read.csv(path, header=True, schema="playlist_name string, movie_names string", quote='"', escape='"')
    return rows.select("playlist_name", F.posexplode(playlist_movies(F.col("movie_names"))).alias("position", "movie_name"))


def movie_lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="movie_name string, movie_length int")


def stimulus_configs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid configurations and the errors of the others: ``file, error``; one JSON document per file."""
    raw = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    raw = raw.withColumn("file", F.col("_metadata.file_name"))
    k = "section_kwargs"
    error = (
        F.when(F.col(k).isNull(), "section_kwargs missing").when(F.col(f"{k}.start_frame").isNull() | (F.col(f"{k}.start_frame") < 0), "start_frame must be 0 or more")
        .when(F.col(f"{k}.trial_length_frame").isNull() | (F.col(f"{k}.trial_length_frame") <= 0), "trial_length_frame must be positive")
        .when(F.col(f"{k}.repeat").isNull() | (F.col(f"{k}.repeat") < 1), "repeat must be 1 or more")
        .when(F.col(f"{k}.group_count") < 1, "group_count must be 1 or more").when(F.col(f"{k}.group_gap") < 0, "group_gap must be 0 or more")
    )
    checked = raw.withColumn("error", error)
    good = checked.where("error IS NULL").select("file", F.coalesce("name", F.regexp_replace("file", r"\.json$", "")).alias("movie"), f"{k}.*")
    return good, checked.where("error IS NOT NULL").select("file", "error")


def missing_configs(movies: DataFrame, configs: DataFrame, name: str = "movie") -> DataFrame:
    """Movies without a valid configuration."""
    return movies.select(name).distinct().join(configs.select(F.col("movie").alias(name)), name, "left_anti")


def files(spark: SparkSession, path: str, all_of: list[str] | None = None, none_of: list[str] | None = None, min_bytes: int = 0, recursive: bool = True) -> DataFrame:
    """``path, length, modificationTime`` of files by keywords in their names and by size; contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return listed.where((F.col("length") >= min_bytes) & has_words(name, all_of or [], none_of or []))


def tabs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Exported sheets (tab name to CSV path) as one table of text: columns by name, absent ones NULL, the tab in ``tab``."""
    out = None
    for name, path in paths.items():
        one = spark.read.csv(path, header=True, quote='"', escape='"').withColumn("tab", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tabs")
    return out


def parquet_info(path: str) -> dict:
    """Rows, columns and key-value metadata of a Parquet file's footer."""
    import pyarrow.parquet as pq

    with open_input(path) as f:
        meta = pq.read_metadata(f)
    return {"rows": meta.num_rows, "columns": meta.num_columns, "metadata": {k.decode(): v.decode(errors="replace") for k, v in (meta.metadata or {}).items()}}


def load_json(path: str) -> dict:
    """A configuration file on the driver, with errors that name it."""
    try:
        with open_input(path) as f:
            return json.loads(f.read().decode("utf-8"))
    except FileNotFoundError as e:
        raise FileNotFoundError(f"no configuration {path}") from e
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} isn't valid JSON: {e}") from e


def flow_config(source: str | dict) -> dict:
    """A flow: ``name``, ``version``, ``stages`` with ``load`` and ``features``, ``defaults``; the stages are filled in where left out."""
    c = source if isinstance(source, dict) else load_json(source)
    if "name" not in c:
        raise ValueError("a flow needs a name")
    stages = c.get("stages", {})
    return {
        "name": c["name"], "version": str(c.get("version", "1")), "defaults": c.get("defaults", {}),
        "stages": {"load": {"enabled": True} | stages.get("load", {}), "features": {"enabled": True, "feature_sets": []} | stages.get("features", {})},
    }


class _Chunk(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _npy_header(f) -> tuple[tuple[int, ...], object, int]:
    """Shape, type and where the data begin; files with pickled objects or in column order are refused."""
    import numpy as np

    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject or fortran or not shape:
        raise ValueError("only plain arrays in row order with one dimension or more can be read")
    return shape, dtype, f.tell()


class _ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("chunkrows", 4096))
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self):
        with open_input(self.path) as f:
            n = _npy_header(f)[0][0]
        n = n if self.limit is None else min(n, self.limit)
        return [_Chunk(self.path, s, min(s + self.rows, n)) for s in range(0, n, self.rows)] or [_Chunk(self.path, 0, 0)]

    def read(self, part):
        import numpy as np

        with open_input(part.path) as f:
            shape, dtype, at = _npy_header(f)
            width = int(np.prod(shape[1:], dtype=np.int64))
            f.seek(at + part.start * width * dtype.itemsize)
            raw = f.read((part.end - part.start) * width * dtype.itemsize)
        a = np.frombuffer(raw, dtype).reshape(part.end - part.start, width)
        for i, row in enumerate(a):
            yield (part.start + i, np.asarray(row, dtype=float).tolist())


class ArrayFile(DataSource):
    """``spark.read.format("npy").option("path", ...)``: a row per first index of an array file, chunk by chunk.

    Options: ``chunkrows`` rows per task, ``limit`` rows in all. Files with
    pickled objects are refused.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "idx bigint, data array<double>"

    def reader(self, schema):
        return _ArrayReader(self.options)


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayFile)
    register_stores(spark)
