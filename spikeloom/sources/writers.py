"""Writers: partitioned tables, replaced units, feature tables that skip what is there, flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.functions.arrays import summary_columns


def write_units(df: DataFrame, path: str) -> None:
    """Replace the partitions (``dataset_id``) that ``df`` holds; other recordings stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _swap(spark: SparkSession, side: str, path: str) -> None:
    """Put ``side`` in the place of ``path``: the old table is moved aside first and deleted last, so there is always one whole table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = f"{path}.old"
    fs.delete(at(old), True)
    if not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved; nothing was changed")
    if not fs.rename(at(side), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"{side} can't be moved to {path}; the old table is back in its place")
    fs.delete(at(old), True)


def recover(spark: SparkSession, path: str) -> None:
    """Undo a swap that a crash cut in two: the old table goes back where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at(f"{path}.old"), at(path))


def append_new(df: DataFrame, path: str, keys: list[str], force: bool = False) -> None:
    """Append rows whose keys aren't there; with ``force`` the new rows replace the old ones (written aside, then swapped)."""
    spark = df.sparkSession
    recover(spark, path)
    if not exists(spark, path):
        df.write.parquet(path)
        return
    old = spark.read.parquet(path)
    if not force:
        df.join(old.select(*keys).distinct(), keys, "left_anti").write.mode("append").parquet(path)
        return
    side = f"{path}.new"
    old.join(df.select(*keys).distinct(), keys, "left_anti").unionByName(df, allowMissingColumns=True).write.mode("overwrite").parquet(side)
    _swap(spark, side, path)


def export_features(df: DataFrame, path: str, keys: list[str], width: int = 10) -> None:
    """Flat columns: scalars as they are, arrays as ``name_0..`` up to ``width`` values, beside mean, std, min and max of longer ones."""
    flat(df, keys, width).write.mode("overwrite").option("compression", "snappy").parquet(path)


def flat(df: DataFrame, keys: list[str], width: int = 10) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if f.name in keys or not f.dataType.simpleString().startswith(("array<double", "array<float")):
            cols.append(F.col(f.name))
        else:
            cols += summary_columns(F.col(f.name), f.name, width)
    return df.select(*cols)
