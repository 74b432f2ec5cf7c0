"""Flows over recordings: load, section, extract, save. Every step takes all recordings at once.

A ``Session`` holds lazy tables. Steps add tables and are recorded in its
ledger, so a saved session goes on where it stopped. ``run_flow`` is the whole
of a named flow: it loads what isn't loaded, extracts the feature sets of the
flow, and reports what failed, per feature, without ending the others.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.functions.keys import recording_key
from spikeloom.functions.names import playlist_movies
from spikeloom.operators import timeline
from spikeloom.operators.extractors import STANDARD, UNIT
from spikeloom.plans.registry import Registry, Session, config_hash
from spikeloom.sources import readers, stores
from spikeloom.sources.writers import append_new, exists

# How a recording's name is written; the electrode array's sampling rate where a file doesn't tell it, and the rates that are plausible.
DATASET_ID = r"^[A-Za-z0-9][A-Za-z0-9_.\-]*$"
DEFAULT_RATE, RATES = 20_000.0, (1_000.0, 100_000.0)


def dataset_id(name: str) -> str:
    """A recording's name, from a path or a name: no directory, no known ending, no hyphens at its end. Others are an error."""
    stem = re.sub(r"\.(cmcr|cmtr|h5|hdf5|parquet)$", "", name.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1], flags=re.IGNORECASE).rstrip("-")
    if not re.match(DATASET_ID, stem):
        raise ValueError(f"{name!r} doesn't name a recording")
    return stem


def checked_rate(rate: float | None) -> tuple[float, str | None]:
    """A rate that can be used, and a warning where it isn't the given one."""
    if rate is None or rate != rate or not RATES[0] <= rate <= RATES[1]:
        return DEFAULT_RATE, f"rate {rate} replaced by {DEFAULT_RATE}"
    return float(rate), None


def input_files(raw: str | None, sorted_: str | None) -> tuple[str | None, str | None]:
    """The raw and the sorted file, of which there has to be one; each with its ending."""
    if raw is None and sorted_ is None:
        raise ValueError("a raw or a sorted file is needed")
    for path, end in ((raw, ".cmcr"), (sorted_, ".cmtr")):
        if path is not None and not path.lower().endswith(end):
            raise ValueError(f"{path} doesn't end in {end}")
    return raw, sorted_


def partner_files(files: DataFrame) -> DataFrame:
    """The raw file of each sorted one: ``sorted_path, raw_path, how`` (``same``, ``suffix``, ``prefix`` or none).

    ``files`` has ``path``. Of one folder, the same stem counts first, then the
    stem without ``_sorted`` or ``_spikes``, then the first file by name that
    shares the first ten characters. Each way is an equi-join.
    """
    f = files.select("path", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("end"))
    raw = f.where("end = 'cmcr'").select("folder", F.col("stem").alias("raw_stem"), F.col("path").alias("raw_path"))
    own = f.where("end = 'cmtr'").select("folder", "stem", F.col("path").alias("sorted_path"))
    out = None
    for i, (how, left, right) in enumerate((("same", F.col("stem"), F.col("raw_stem")), ("suffix", F.regexp_replace("stem", "_(sorted|spikes)$", ""), F.col("raw_stem")), ("prefix", F.substring("stem", 1, 10), F.substring("raw_stem", 1, 10)))):
        r = raw.select("folder", right.alias("k"), "raw_path", "raw_stem").groupBy("folder", "k").agg(F.min_by("raw_path", "raw_stem").alias("raw_path"))
        got = own.withColumn("k", left).join(r, ["folder", "k"]).select("sorted_path", "raw_path", F.lit(how).alias("how"), F.lit(i).alias("i"))
        out = got if out is None else out.unionByName(got)
    best = out.groupBy("sorted_path").agg(F.min_by(F.struct("raw_path", "how"), "i").alias("b"))
    return own.select("sorted_path").join(best, "sorted_path", "left").select("sorted_path", "b.raw_path", "b.how")


# -- stage 1: loading ------------------------------------------------------------------------------------------------


def load_recordings(spark: SparkSession, sorted_paths: list[str], meta: DataFrame | None = None) -> Session:
    """A session of the units, spikes and recordings in sorter files, all files in one scan.

    ``meta`` has ``dataset_id`` and columns to add to the recordings. Rates are
    checked; a file's units without spikes stay. Spike times are in
    microseconds and, under the file's rate, in samples.
    """
    stores.register_stores(spark)
    for p in sorted_paths:
        dataset_id(p)
    raw = spark.read.format("sorter").option("path", ",".join(sorted_paths)).load()
    raw = raw.withColumn("dataset_id", F.regexp_replace(F.regexp_replace("file", r"(?i)\.(cmtr|h5|hdf5)$", ""), "-+$", ""))
    bad = F.col("acquisition_rate").isNull() | F.isnan("acquisition_rate") | ~F.col("acquisition_rate").between(*RATES)
    rate = F.when(bad, DEFAULT_RATE).otherwise(F.col("acquisition_rate"))
    units = raw.select("dataset_id", "unit_id", "row", "col", "global_id", F.col("waveform"), F.size("spike_us").cast("long").alias("spike_count"), rate.alias("acquisition_rate"), "meta")
    spikes = raw.select("dataset_id", "unit_id", F.explode("spike_us").alias("t_us"), rate.alias("_r")).select("dataset_id", "unit_id", "t_us", F.round(F.col("t_us") * F.col("_r") / 1e6).cast("long").alias("sample"))
    per = raw.groupBy("dataset_id").agg(F.max(rate).alias("acquisition_rate"), F.bool_or(bad).alias("rate_replaced"), F.count("*").alias("n_units"), F.max("recording").alias("recording"))
    if meta is not None:
        per = per.join(meta, "dataset_id", "left")
    s = Session({"units": units, "spikes": spikes, "recordings": per})
    s.steps.append("load")
    return s


def load_store(spark: SparkSession, paths: list[str], features: list[str] | None = None) -> Session:
    """A session of recording stores; ``features`` takes some features only, and nothing of the others is read."""
    under = ["units/*", "metadata", "stimulus"] if features is None else ["units/*/spike_times", "units/*/waveform", "units/*@row", "units/*@col", "units/*@global_id", "metadata", "stimulus", *[f"units/*/features/{n}" for n in features]]
    n = stores.nodes(spark, paths, [*under, "@*"] if features is not None else None)
    u = stores.units(n)
    s = Session({"units": u, "spikes": u.select("dataset_id", "unit_id", F.explode("spike_times").alias("sample")), "metadata": stores.metadata(n), "stimulus": stores.stimulus(n), "features": stores.features(n, features), "status": stores.status(n)})
    s.steps.append("load")
    return s


def save_store(session: Session, folder: str, overwrite: bool = False, params: dict | None = None) -> DataFrame:
    """A store file per recording of a session's ``units``, with its features, metadata and stimulus where there are any: the report of ``write_files``."""
    t = session.tables
    u = t["units"]
    if "spike_times" not in u.columns:
        held = t["spikes"].groupBy(*UNIT).agg(F.sort_array(F.collect_list("sample")).alias("spike_times"))  # the spikes of one unit
        u = u.join(held, UNIT, "left")
    parts = [stores.unit_nodes(u), stores.header_nodes(u, config_hash(params or {}))]
    for name, make in (("features", stores.feature_nodes), ("metadata", stores.metadata_nodes), ("stimulus", stores.stimulus_nodes), ("sections", stores.section_nodes)):
        if name in t:
            parts.append(make(t[name]))
    return stores.write_files(stores._all(parts), folder, overwrite)


# -- steps -----------------------------------------------------------------------------------------------------------


def add_sheet(session: Session, sheet: DataFrame, file_column: str) -> None:
    """Join a sheet's row to each recording by any spelling of its name; of repeated rows the first by content counts."""

    def run(s: Session) -> None:
        key = recording_key(file_column)
        cols = [c for c in sheet.columns if c != file_column and c not in s.tables["recordings"].columns]
        one = sheet.where(key.isNotNull()).groupBy(key.alias("_key")).agg(F.min(F.struct(*cols)).alias("_s"))
        r = s.tables["recordings"].withColumn("_key", recording_key("dataset_id"))
        s.tables["recordings"] = r.join(one, "_key", "left").select(*s.tables["recordings"].columns, *[F.col(f"_s.{c}").alias(c) for c in cols])

    session.step("sheet", run)


def add_sections(session: Session, playlists: DataFrame, movies: DataFrame, playlist_name: str) -> None:
    """Frames of each movie of a playlist in every recording: the table ``sections``."""

    def run(s: Session) -> None:
        of = playlists.where(F.col("playlist_name") == playlist_name)
        if "movie_name" not in of.columns:
            of = of.select("playlist_name", F.posexplode(playlist_movies(F.col("movie_names"))).alias("position", "movie_name"))
        rows = of.join(movies, "movie_name")
        framed = timeline.section_frames(rows.select("playlist_name", "position", "movie_name", F.col("movie_length").alias("length")), ["playlist_name"], "position", "length")
        s.tables["sections_frames"] = framed

    session.step("section_time", run)


def section_spikes(session: Session, spans: DataFrame, pre: float = 0.0, post: float = 0.0, width: float = 600.0) -> None:
    """Spikes of each trial: the table ``sections`` with ``dataset_id, unit_id, movie, trial_idx, spike_times``; ``spans`` has ``dataset_id, movie, trial_idx, start, end`` in samples."""

    def run(s: Session) -> None:
        got = timeline.section_events(s.tables["spikes"], spans, ["dataset_id"], "sample", "start", "end", pre, post, width * DEFAULT_RATE / 60)
        s.tables["sections"] = got.groupBy("dataset_id", "unit_id", "movie", "trial_idx").agg(F.sort_array(F.collect_list("sample")).alias("spike_times"))  # the spikes of one trial

    session.step("section_spikes", run)


# -- stage 2: features -----------------------------------------------------------------------------------------------


def long_features(name: str, table: DataFrame) -> DataFrame:
    """A feature table as rows: ``dataset_id, unit_id, feature, field, value, text``; flags as 0 and 1."""
    fields = [f for f in table.schema.fields if f.name not in UNIT]
    rows = []
    for f in fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        number = c.cast("double") if kind in ("double", "float", "bigint", "int", "boolean", "smallint") else F.lit(None).cast("double")
        text = c if kind == "string" else F.lit(None).cast("string")
        if kind.startswith("array"):
            continue
        rows.append(F.struct(F.lit(f.name).alias("field"), number.alias("value"), text.alias("text")))
    return table.select(*UNIT, F.lit(name).alias("feature"), F.explode(F.array(*rows)).alias("r")).select(*UNIT, "feature", "r.field", "r.value", "r.text")


@dataclass
class Extraction:
    """What became of each feature set: the tables, and why others have none."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    kept: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.failed

    def rows(self) -> DataFrame | None:
        """All features in long form."""
        parts = [long_features(n, t) for n, t in self.tables.items()]
        return reduce(DataFrame.unionByName, parts) if parts else None


def extract_features(session: Session, names: list[str], registry: Registry = STANDARD, done: DataFrame | None = None, force: bool = False) -> Extraction:
    """Run extractors over a session's tables. An unknown one or one without its inputs fails by itself.

    ``done`` holds rows of earlier runs (``dataset_id, feature``): recordings
    that have a feature are left out of its run, unless ``force``.
    """
    out = Extraction()
    for name in names:
        try:
            e = registry.get(name)
        except KeyError as err:
            out.failed[name] = str(err)
            continue
        lacking = e.missing(session.tables)
        if lacking:
            out.failed[name] = f"missing {', '.join(lacking)}"
            continue
        needed = {i.partition(".")[0] for i in e.inputs}
        tables = {n: session.tables[n] for n in needed}
        if done is not None and not force:
            have = done.where(F.col("feature") == name).select("dataset_id").distinct()
            tables = {n: t.join(have, "dataset_id", "left_anti") for n, t in tables.items()}
            out.kept.append(name)
        got = e.run(**tables)
        out.tables[name] = got.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in e.schema.fields])
        session.put(f"feature_{name}", out.tables[name])
    return out


# -- flows -----------------------------------------------------------------------------------------------------------


def available_flows(folder: str) -> list[str]:
    """The flows of a configuration folder, by name."""
    return sorted(f[:-5] for f in os.listdir(folder) if f.endswith(".json")) if os.path.isdir(folder) else []


def flow_info(name: str, folder: str) -> dict:
    """A flow's name, version, stages and feature sets, and which of these no extractor has."""
    flow = readers.flow_config(name if name.endswith(".json") else f"{folder.rstrip('/')}/{name}.json")
    sets = flow["stages"]["features"]["feature_sets"]
    return flow | {"feature_sets": sets, "unknown": [s for s in sets if s not in STANDARD]}


@dataclass
class FlowResult:
    session: Session
    extraction: Extraction | None
    path: str

    @property
    def success(self) -> bool:
        return self.extraction is None or self.extraction.ok


def run_flow(spark: SparkSession, flow: str | dict, output: str, sorted_paths: list[str] | None = None, session: Session | None = None, force: bool = False) -> FlowResult:
    """Load and extract as a flow says; the features land in ``output/features``, one row per unit, feature and field.

    With the load stage off, or a ``session`` given, nothing is loaded. Rows of
    recordings and features that are in ``output`` already are kept and not
    computed again, unless ``force`` or the flow's ``force_recompute``.
    """
    config = readers.flow_config(flow)
    stages = config["stages"]
    if session is None:
        if stages["load"]["enabled"]:
            if not sorted_paths:
                raise ValueError("the flow loads recordings, but there are no files")
            session = load_recordings(spark, sorted_paths)
        else:
            session = Session.load(spark, f"{output}/session")
    path = f"{output.rstrip('/')}/features"
    names = stages["features"]["feature_sets"] if stages["features"]["enabled"] else []
    extraction = None
    if names:
        force = force or bool(config["defaults"].get("force_recompute"))
        done = spark.read.parquet(path).select("dataset_id", "feature") if exists(spark, path) and not force else None
        extraction = extract_features(session, names, done=done, force=force)
        rows = extraction.rows()
        if rows is not None:
            append_new(rows.withColumn("params_hash", F.lit(config_hash(config))), path, ["dataset_id", "unit_id", "feature", "field"], force)
    session.steps.append(f"flow:{config['name']}")
    return FlowResult(session, extraction, path)


def run_batch(spark: SparkSession, flow: str | dict, output: str, sorted_paths: list[str], start: int = 0, end: int | None = None, overwrite: bool = False) -> DataFrame:
    """A flow over a range of files, in one plan: ``dataset_id, status`` (``done``, ``skipped``).

    Files whose recording has features in ``output`` are skipped, unless ``overwrite``.
    """
    chosen = sorted(sorted_paths, key=lambda p: p.rsplit("/", 1)[-1])[start:end]
    path = f"{output.rstrip('/')}/features"
    have = {r.dataset_id for r in spark.read.parquet(path).select("dataset_id").distinct().where(F.col("dataset_id").isin([dataset_id(p) for p in chosen])).collect()} if exists(spark, path) and not overwrite else set()  # at most the files given
    todo = [p for p in chosen if dataset_id(p) not in have]
    if todo:
        run_flow(spark, flow, output, todo, force=overwrite)
    return spark.createDataFrame([(dataset_id(p), "done" if p in todo else "skipped") for p in chosen], "dataset_id string, status string")


def wide_features(rows: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """A row per unit and a column ``feature__field`` for each of ``fields``: the table that analysis starts from."""

    def pick(f: str, g: str) -> Column:
        return F.max(F.when((F.col("feature") == f) & (F.col("field") == g), F.col("value"))).alias(f"{f}__{g}")

    return rows.groupBy(*UNIT).agg(*[pick(f, g) for f, g in fields])
