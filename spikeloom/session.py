"""Session helpers: local sessions, table reading, the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CUTS: list[tuple[SparkSession, str]] = []


def local_session(cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for one machine, as tests and ``bench.py`` use it."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spikeloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may do without that setting: its executors and its
    driver are one machine. Elsewhere a missing setting is an error.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="spikeloom-")
    return f"file://{_LOCAL}"


_LOCAL: str | None = None


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Later stages start from the files, so a lost executor costs no more than
    its own tasks. The files go with ``discard``, with ``drop_cuts``, or when
    the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spikeloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._spikeloom_cut = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass


def drop_cuts(keep: int = 0) -> None:
    """Delete the tables that ``cut`` wrote, but for the first ``keep``."""
    while len(_CUTS) > keep:
        _delete(*_CUTS.pop())


def discard(df: DataFrame) -> None:
    """Delete a table that ``cut`` returned, as soon as what was made of it is written. Other frames are left alone."""
    at = getattr(df, "_spikeloom_cut", None)
    if at is None:
        return
    for i in range(len(_CUTS) - 1, -1, -1):
        if _CUTS[i][1] == at:
            _delete(*_CUTS.pop(i))


def cut_mark() -> int:
    """How many cuts there are now; ``drop_cuts(cut_mark_before)`` removes later ones."""
    return len(_CUTS)


atexit.register(drop_cuts)
