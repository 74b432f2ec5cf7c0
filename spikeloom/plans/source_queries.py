"""Queries of sources, sinks and sessions: tables go through files and come back, and SQL tells what must come back."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.functions import arrays as A
from spikeloom.operators import directions, electrode_sta, rates, timeline
from spikeloom.plans import core_queries as C
from spikeloom.plans.core_queries import _CELL, _LEN, _SP, _TC, _UNIT, R, query_of
from spikeloom.plans.registry import Session
from spikeloom.session import cut, shared_dir, table
from spikeloom.sources import readers, stores
from spikeloom.sources.writers import export_features

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_of(QUERIES, SQL)


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spikeloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# -- playlists, configurations, sheets --------------------------------------------------------------------------------


@query(f"""WITH {_LEN}, r AS (SELECT DISTINCT recording_no, chip, CAST(round_even(dur * 60, 0) AS BIGINT) AS length FROM (SELECT DISTINCT recording_no, chip FROM recordings WHERE chip IS NOT NULL) JOIN len USING (recording_no)),
o AS (SELECT *, row_number() OVER w - 1 AS position, CAST(coalesce(sum(length + 361) OVER (PARTITION BY chip ORDER BY recording_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r WINDOW w AS (PARTITION BY chip ORDER BY recording_no))
SELECT chip AS playlist_name, CAST(position AS INTEGER) AS position, 'm' || recording_no AS movie_name, "offset" + 120 AS start_frame, "offset" + 301 + length AS end_frame FROM o""")
def playlist_sections(spark, d):
    """A playlist file and a file of movie lengths, read and laid out in frames."""
    r = table(spark, d, "recordings").select("recording_no", "chip").where("chip IS NOT NULL").distinct().join(C.lengths(spark, d), "recording_no")
    r = r.select("chip", "recording_no", F.concat(F.lit("m"), "recording_no").alias("movie_name"), F.bround(F.col("dur") * 60).cast("int").alias("movie_length"))
    at = folder(spark, "playlists")
    names = F.transform(F.array_sort(F.collect_list(F.struct("recording_no", "movie_name"))), lambda x: F.concat(F.lit("'"), x["movie_name"], F.lit(".mov'")))  # the movies of one playlist
    lists = r.groupBy(F.col("chip").alias("playlist_name")).agg(F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]")).alias("movie_names"))
    lists.write.option("header", True).option("quoteAll", True).csv(f"{at}/lists")
    r.select("movie_name", "movie_length").distinct().write.option("header", True).csv(f"{at}/lengths")
    rows = readers.playlist(spark, f"{at}/lists").join(readers.movie_lengths(spark, f"{at}/lengths"), "movie_name")
    got = timeline.section_frames(rows.withColumnRenamed("movie_length", "length"), ["playlist_name"], "position", "length")
    return got.select("playlist_name", "position", "movie_name", "start_frame", "end_frame")


@query(f"""WITH {_LEN}, c AS (SELECT recording_no % 7 AS k, recording_no FROM len) SELECT CASE WHEN k = 0 THEN 'section_kwargs missing' WHEN k = 1 THEN 'start_frame must be 0 or more' WHEN k = 2 THEN 'trial_length_frame must be positive' WHEN k = 3 THEN 'repeat must be 1 or more' WHEN k = 4 THEN 'group_count must be 1 or more' ELSE 'valid' END AS outcome,
count(*) AS n, CAST(sum(CASE WHEN k >= 5 THEN recording_no END) AS BIGINT) AS starts FROM c GROUP BY 1""")
def stimulus_configurations(spark, d):
    """A configuration file per recording, some of them broken: what is valid, and why the others aren't."""
    c = C.lengths(spark, d).select("recording_no", (F.col("recording_no") % 7).alias("k"))
    kw = F.struct(F.when(F.col("k") == 1, -1).otherwise(F.col("recording_no")).alias("start_frame"), F.when(F.col("k") == 2, 0).otherwise(600).alias("trial_length_frame"), F.when(F.col("k") == 3, 0).otherwise(3).alias("repeat"), F.when(F.col("k") == 4, 0).otherwise(1).alias("group_count"))
    docs = c.select(F.concat(F.lit("m"), "recording_no").alias("movie"), F.to_json(F.struct(F.concat(F.lit("m"), "recording_no").alias("name"), F.when(F.col("k") > 0, kw).alias("section_kwargs"))).alias("value"))
    at = folder(spark, "configs")
    docs.repartition("movie").write.partitionBy("movie").text(at)  # a folder per movie
    good, bad = readers.stimulus_configs(spark, at)
    rows = good.select(F.lit("valid").alias("outcome"), F.col("start_frame").cast("long").alias("s")).unionByName(bad.select(F.col("error").alias("outcome"), F.lit(None).cast("long").alias("s")))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("s").alias("starts"))


@query(f"""WITH r AS (SELECT DISTINCT recording_no, chip, genotype FROM recordings) SELECT tab, count(*) AS n, count(chip) AS with_chip, count(genotype) AS with_genotype FROM (SELECT 'odd' AS tab, chip, NULL AS genotype FROM r WHERE recording_no % 2 = 1 UNION ALL SELECT 'even', NULL, genotype FROM r WHERE recording_no % 2 = 0) GROUP BY 1""")
def sheet_tabs(spark, d):
    """Two tabs with different columns as one table."""
    r = table(spark, d, "recordings").select("recording_no", "chip", "genotype").distinct()
    at = folder(spark, "sheet")
    r.where("recording_no % 2 = 1").select("recording_no", "chip").write.option("header", True).csv(f"{at}/odd")
    r.where("recording_no % 2 = 0").select("recording_no", "genotype").write.option("header", True).csv(f"{at}/even")
    got = readers.tabs(spark, {"odd": f"{at}/odd", "even": f"{at}/even"})
    return got.groupBy("tab").agg(F.count("*").alias("n"), F.count("chip").alias("with_chip"), F.count("genotype").alias("with_genotype"))


# -- stores and sessions ----------------------------------------------------------------------------------------------


@query(f"""WITH {_UNIT}, o AS (SELECT DISTINCT dataset_id, unit_id FROM un WHERE dataset_id IS NOT NULL AND unit_id IS NOT NULL) SELECT dataset_id, true AS stage1_completed, 'abc' AS params_hash, count(*) AS n_units, 2 * count(*) + count(*) FILTER (unit_id = 'unit_001') + 1 AS n_groups FROM o GROUP BY 1""")
def store_status(spark, d):
    """Stores of all units with a feature: completion, hash and sizes, and the groups that a catalog lists."""
    u = C.one_unit_each(spark, d).where("dataset_id IS NOT NULL AND unit_id IS NOT NULL").select("dataset_id", "unit_id").distinct()
    rows = u.withColumns({"row": F.lit(1), "col": F.lit(2), "global_id": F.lit(3), "waveform": F.array(F.lit(1.0)), "spike_times": F.array().cast("array<bigint>")})
    feats = u.select("dataset_id", "unit_id", F.lit("f").alias("feature"), F.lit("x").alias("field"), F.lit(0.5).alias("value"))
    extra = feats.where("unit_id = 'unit_001'").withColumn("feature", F.lit("g"))
    at = folder(spark, "status")
    n = stores._all([stores.unit_nodes(rows), stores.feature_nodes(feats.unionByName(extra)), stores.header_nodes(rows, "abc")])
    names = [r.file for r in cut(stores.write_files(n, at), "written").select("file").collect()]  # a name per recording
    back = stores.nodes(spark, [f"{at}/{x}" for x in names])
    groups = stores.cataloged(back).where("kind = 'group' AND (path = 'units' OR path LIKE 'units/%/features/%' OR depth = 2 AND path LIKE 'units/%')").groupBy("dataset_id").agg(F.count("*").alias("n_groups"))
    return stores.status(back).join(groups, "dataset_id").select("dataset_id", "stage1_completed", "params_hash", "n_units", "n_groups")


@query(f"WITH {_CELL} SELECT 'cells' AS name, count(*) AS n, count(*) FILTER (dsi = 9.0) AS replaced FROM ce UNION ALL SELECT 'steps', 2, 0")
def session_round_trip(spark, d):
    """A session with a replaced part, saved and loaded again; its steps are kept and not run twice."""
    c = C.one_cell_each(spark, d).select("unit_key", "dsi")
    s = Session({"cells": c})
    s.step("load", lambda x: None)
    s.step("load", lambda x: None)
    s.step("more", lambda x: None)
    back = Session.load(spark, s.ensure_saved(folder(spark, "session")))
    cells = back.tables["cells"].agg(F.lit("cells").alias("name"), F.count("*").alias("n"), F.count_if(F.col("dsi") == 9.0).alias("replaced"))
    return cells.unionByName(spark.createDataFrame([("steps", len(back.steps), 0)], "name string, n long, replaced long"))


@query(f"""WITH {_UNIT}, w AS (SELECT unit_key, [CAST(row AS DOUBLE), CAST(col AS DOUBLE)] AS place, list_transform(waveform, lambda x: CAST(x AS DOUBLE)) AS w FROM un WHERE len(waveform) > 0)
SELECT count(*) AS n, count(place[1]) AS with_row, round(avg(list_avg(w)), 5) + 0.0 AS mean, CAST(29 AS BIGINT) AS n_columns FROM w""")
def exported_features(spark, d):
    """The flat export, read back: its rows, its columns and a column of statistics."""
    u = C.one_unit_each(spark, d).where("size(waveform) > 0").select("unit_key", F.array(F.col("row").cast("double"), F.col("col").cast("double")).alias("place"), F.col("waveform").cast("array<double>").alias("w"))
    at = folder(spark, "export")
    export_features(u, at, ["unit_key"])
    got = spark.read.parquet(at)
    return got.agg(F.count("*").alias("n"), F.count("place_0").alias("with_row"), (R(F.avg("w_mean"), 5) + F.lit(0.0)).alias("mean"), F.lit(len(got.columns)).cast("long").alias("n_columns"))


# -- electrode images, trials, directions ------------------------------------------------------------------------------


def sensor_chunks(spark: SparkSession, d: str, rows: int = 100, overlap: int = 10) -> DataFrame:
    """The embeddings in order of their ids as an array of eight by eight electrodes over time, in chunks."""
    e = table(spark, d, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").alias("t"), "embedding")
    own = F.floor(F.col("t") / rows)
    homes = F.array_distinct(F.array(F.floor((F.col("t") - overlap) / rows), own, F.floor((F.col("t") + overlap) / rows)))

    def pack(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        k, t = int(keys[0]), part["t"].to_numpy()
        if k < 0 or not ((t >= k * rows) & (t < (k + 1) * rows)).any():
            return pd.DataFrame([], columns=["file", "start", "stop", "first", "shape", "frames", "dtype"])
        x = np.stack(part["embedding"].to_list()).astype("<f4")
        stop = int(t[t < (k + 1) * rows].max()) + 1
        return pd.DataFrame([("e", k * rows, stop, int(t[0]), [len(x), 8, 8], x.tobytes(), "f4")], columns=["file", "start", "stop", "first", "shape", "frames", "dtype"])

    return e.select("t", "embedding", F.explode(homes).alias("chunk")).groupBy("chunk").applyInPandas(pack, electrode_sta.CHUNK)


@query("""WITH e AS (SELECT vec_id AS t, label, embedding AS v FROM embeddings WHERE len(embedding) = 64), z AS (SELECT max(t) AS z FROM e), s AS (SELECT t, label FROM e, z WHERE t - 2 >= 0 AND t + 3 <= z + 1),
w AS (SELECT CAST(s.label AS VARCHAR) AS unit_id, o, i, CAST(e.v[i + 1] AS DOUBLE) AS x FROM s CROSS JOIN (SELECT unnest(range(-2, 3)) AS o) JOIN e ON e.t = s.t + o CROSS JOIN (SELECT unnest(range(64)) AS i))
SELECT unit_id, o + 2 AS step, i AS electrode, round(avg(x) + 1e-9, 5) + 0.0 AS average, count(*) AS n_spikes FROM w GROUP BY ALL""")
def electrode_windows(spark, d):
    """Windows of two samples before and three from each event, averaged by its label, over chunks."""
    spikes = table(spark, d, "embeddings").where(F.size("embedding") == 64).select(F.lit("e").alias("file"), F.col("label").cast("string").alias("unit_id"), F.col("vec_id").alias("sample"))
    got = electrode_sta.averages(electrode_sta.window_sums(cut(sensor_chunks(spark, d), "chunks"), spikes, 2, 3, block=17))
    i = F.col("pos")
    return got.select("unit_id", "n_spikes", F.posexplode("average").alias("pos", "x")).select("unit_id", F.floor(i / 64).cast("long").alias("step"), (i % 64).cast("long").alias("electrode"), (R(F.col("x") + 1e-9, 5) + F.lit(0.0)).alias("average"), "n_spikes")


@query(f"""WITH {_TC}, l AS (SELECT unit_key, trial, list(n ORDER BY bin) AS x FROM tc GROUP BY ALL), k AS (SELECT unit_key, count(*) AS k FROM l GROUP BY 1), m AS (SELECT unit_key, bin, avg(n) AS m FROM tc GROUP BY ALL)
SELECT unit_key, any_value(k) AS n_trials, list(round(m, 6) ORDER BY bin) || [0.0, 0.0] AS mean FROM m JOIN k USING (unit_key) GROUP BY unit_key""")
def stacked_trials(spark, d):
    """A unit's trials as an array of traces, their mean, padded to fourteen samples."""
    per = C.trial_counts(spark, d).groupBy("unit_key", "trial").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("x"))  # twelve bins
    got = rates.stack_trials(per, ["unit_key"], "trial", "x")
    mean = rates.pad_or_trim(A.mean_trace(F.col("trials")), 14)
    return got.select("unit_key", F.size("trials").cast("long").alias("n_trials"), F.transform(mean, lambda x: R(x)).alias("mean"))


_DS = f"""{_SP}, c AS (SELECT unit_key, CAST(floor(t / 10) AS BIGINT) % 8 AS dir, CAST(floor(t / 80) AS BIGINT) AS rep, count(*) AS n FROM sp WHERE unit_key IS NOT NULL AND t < 240 GROUP BY ALL),
g AS (SELECT unit_key, dir, sum(coalesce(n, 0)) / 3.0 AS m FROM (SELECT DISTINCT unit_key FROM c) CROSS JOIN (SELECT unnest(range(8)) AS dir) LEFT JOIN c USING (unit_key, dir) GROUP BY ALL),
v AS (SELECT unit_key, sum(m * cos(2 * pi() * dir / 8)) AS x, sum(m * sin(2 * pi() * dir / 8)) AS y, sum(m * cos(4 * pi() * dir / 8)) AS x2, sum(m * sin(4 * pi() * dir / 8)) AS y2, max(m) AS top, sum(m) AS total FROM g GROUP BY 1)"""


@query(f"WITH {_DS} SELECT unit_key, round(CASE WHEN top > 0 THEN sqrt(x * x + y * y) / top ELSE 0 END + 1e-9, 6) AS dsi, round(CASE WHEN total > 0 THEN sqrt(x2 * x2 + y2 * y2) / total ELSE 0 END + 1e-9, 6) AS osi, true AS p_in_range FROM v")
def selectivity_indices(spark, d):
    """Indices of eight directions by three repetitions, with permutation tests whose values lie in 0..1."""
    s = C.spikes(spark, d).where("unit_key IS NOT NULL AND t < 240")
    cell = (F.floor(F.col("t") / 80) * 8 + F.floor(F.col("t") / 10) % 8).cast("int")
    per = s.groupBy("unit_key").agg(*[F.count_if(cell == i).cast("double").alias(f"c{i}") for i in range(24)])
    totals = F.array(*[F.array(*[F.col(f"c{8 * r + k}") for r in range(3)]) for k in range(8)])
    got = per.select("unit_key", directions.selectivity_struct(totals, F.col("unit_key"), 200).alias("f"))
    p = lambda c: (F.col(f"f.{c}") >= 0) & (F.col(f"f.{c}") <= 1)
    return got.select("unit_key", R(F.col("f.dsi") + 1e-9).alias("dsi"), R(F.col("f.osi") + 1e-9).alias("osi"), (p("ds_p") & p("os_p")).alias("p_in_range"))


@query(f"""WITH {_SP}, f AS (SELECT recording_no, row_number() OVER (PARTITION BY recording_no ORDER BY t) - 1 AS i, t FROM (SELECT DISTINCT recording_no, t FROM sp WHERE recording_no IS NOT NULL)), e AS (SELECT recording_no, max(i) AS z FROM f GROUP BY 1),
w AS (SELECT recording_no, k, greatest(0, least(z, k * 100 - 50)) AS i FROM e CROSS JOIN (SELECT unnest(range(5)) AS k)) SELECT w.recording_no, k, t AS sample FROM w JOIN f USING (recording_no, i)""")
def clipped_frames(spark, d):
    """Samples of frames by number, clipped to the frames there are."""
    from pyspark.sql import Window

    t = C.spikes(spark, d).where("recording_no IS NOT NULL").select("recording_no", "t").distinct()
    f = t.select("recording_no", (F.row_number().over(Window.partitionBy("recording_no").orderBy("t")) - 1).cast("long").alias("i"), F.col("t").alias("sample"))
    want = f.select("recording_no").distinct().select("recording_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("k")).withColumn("w", F.col("k") * 100 - 50)
    return timeline.frame_to_sample(want, f, ["recording_no"], "w", "i", "sample").select("recording_no", "k", "sample")


