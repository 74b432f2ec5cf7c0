"""Queries of feature extractors, stores, kernels and embeddings over whole tables, each with SQL that checks it."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spikeloom.functions import arrays as A
from spikeloom.functions import geometry as G
from spikeloom.functions import names as N
from spikeloom.functions.keys import recording_key
from spikeloom.operators import axon, clusters, directions, embedding, extractors, population, sta, timeline, traces
from spikeloom.plans import core_queries as C
from spikeloom.plans import pipeline
from spikeloom.plans.core_queries import _CELL, _LEN, _RD, _RECKEY, _SP, _UNIT, _W, R, query_of
from spikeloom.plans.registry import Session
from spikeloom.session import cut, shared_dir, table
from spikeloom.sources import stores
from spikeloom.sources.writers import append_new

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_of(QUERIES, SQL)

# -- extractors ------------------------------------------------------------------------------------------------------


def spike_trains(spark: SparkSession, d: str) -> DataFrame:
    """The spikes as ``dataset_id, unit_id, t_us``."""
    s = C.spikes(spark, d).where("unit_key IS NOT NULL AND recording_no IS NOT NULL")
    return s.select(F.col("recording_no").cast("string").alias("dataset_id"), F.col("unit_key").cast("string").alias("unit_id"), F.round(F.col("t") * 1e6).cast("long").alias("t_us"))


_TR_US = f"{_SP}, us AS (SELECT CAST(recording_no AS VARCHAR) AS dataset_id, CAST(unit_key AS VARCHAR) AS unit_id, CAST(round(t * 1e6) AS BIGINT) AS t_us FROM sp WHERE unit_key IS NOT NULL AND recording_no IS NOT NULL)"
_BASE = f"""{_TR_US}, n AS (SELECT dataset_id, unit_id, count(*) AS k, CAST(max(t_us) AS DOUBLE) AS z FROM us GROUP BY ALL HAVING max(t_us) > 0),
nb AS (SELECT *, z / 1e6 AS dur, CAST(greatest(1, floor(z / 1e6)) AS BIGINT) AS bins FROM n),
pb AS (SELECT dataset_id, unit_id, b, count(*) AS c FROM (SELECT us.dataset_id, us.unit_id, least(CAST(floor(t_us / (z / bins)) AS BIGINT), bins - 1) AS b FROM us JOIN nb USING (dataset_id, unit_id)) GROUP BY ALL),
sd AS (SELECT dataset_id, unit_id, sum(c) AS s, sum(c * c) AS q FROM pb GROUP BY ALL),
g AS (SELECT dataset_id, unit_id, (t_us - lag(t_us) OVER (PARTITION BY dataset_id, unit_id ORDER BY t_us)) / 1000.0 AS g FROM us),
isi AS (SELECT dataset_id, unit_id, CASE WHEN avg(g) > 0 THEN stddev_pop(g) / avg(g) ELSE 0 END AS cv, median(g) AS med FROM g WHERE g IS NOT NULL GROUP BY ALL),
bl AS (SELECT dataset_id, unit_id, k / dur AS rate, CASE WHEN k > 1 THEN sqrt(greatest(q / bins - (s / bins) * (s / bins), 0)) ELSE 0 END AS sd, coalesce(cv, 0) AS cv, med, k FROM nb JOIN sd USING (dataset_id, unit_id) LEFT JOIN isi USING (dataset_id, unit_id))"""
_QUALITY = "CASE WHEN k < 10 THEN 0 ELSE ((CASE WHEN rate BETWEEN 0.5 AND 50 THEN 1 WHEN rate < 0.5 THEN rate / 0.5 ELSE greatest(0, 1 - (rate - 50) / 50) END) + (CASE WHEN cv < 1 THEN 1 WHEN cv < 2 THEN 2 - cv ELSE 0 END) + least(1, k / 100.0)) / 3 END"


@query(f"WITH {_BASE} SELECT dataset_id, unit_id, round(rate, 6) AS mean_firing_rate, round(sd, 6) AS std_firing_rate, round(cv, 6) AS cv_isi, round(med + 1e-7, 5) AS median_isi_ms, k AS spike_count, round({_QUALITY}, 6) AS quality_index FROM bl")
def baseline_features(spark, d):
    got = extractors.baseline(spike_trains(spark, d))
    return got.select("dataset_id", "unit_id", R("mean_firing_rate").alias("mean_firing_rate"), R("std_firing_rate").alias("std_firing_rate"), R(F.coalesce("cv_isi", F.lit(0.0))).alias("cv_isi"), R(F.col("median_isi_ms") + 1e-7, 5).alias("median_isi_ms"), "spike_count", R("quality_index").alias("quality_index"))


_STEP = f"""{_TR_US}, w AS (SELECT dataset_id, unit_id, count(*) FILTER (t_us >= 1000000 AND t_us < 5000000) / 4.0 AS base, count(*) FILTER (t_us >= 5000000 AND t_us < 5500000) / 0.5 AS a,
count(*) FILTER (t_us >= 5500000 AND t_us < 10000000) / 4.5 AS s1, count(*) FILTER (t_us >= 10000000 AND t_us < 10500000) / 0.5 AS b, count(*) FILTER (t_us >= 10500000 AND t_us < 14500000) / 4.0 AS s2,
(min(t_us) FILTER (t_us >= 5000000 AND t_us < 5500000) - 5000000) / 1000.0 AS l1, (min(t_us) FILTER (t_us >= 10000000 AND t_us < 10500000) - 10000000) / 1000.0 AS l2 FROM us GROUP BY ALL),
st AS (SELECT dataset_id, unit_id, a > 2 * base AS on_response_flag, b > 2 * base AS off_response_flag, a AS on_peak_value, b AS off_peak_value, s1 AS on_sustained_response, s2 AS off_sustained_response,
CASE WHEN greatest(a, b) > 0 THEN least(1, (greatest(a, b) - base) / (base + 1) / 10) ELSE 0 END AS response_quality, l1 AS on_latency_ms, l2 AS off_latency_ms, CASE WHEN a + b > 0 THEN (a - b) / (a + b) ELSE 0 END AS on_off_ratio, base AS baseline_rate FROM w)"""
_STEP_COLS = ("on_peak_value", "off_peak_value", "on_sustained_response", "off_sustained_response", "response_quality", "on_latency_ms", "off_latency_ms", "on_off_ratio", "baseline_rate")


@query(f"WITH {_STEP} SELECT dataset_id, unit_id, on_response_flag, off_response_flag, {', '.join(f'round({c}, 5) AS {c}' for c in _STEP_COLS)} FROM st")
def step_up_features(spark, d):
    got = extractors.step_up(spike_trains(spark, d))
    return got.select("dataset_id", "unit_id", "on_response_flag", "off_response_flag", *[R(c, 5).alias(c) for c in _STEP_COLS])


def unit_waves(spark, d):
    rec = table(spark, d, "spikes").where("unit_key IS NOT NULL AND recording_no IS NOT NULL").select(F.col("recording_no").cast("string").alias("dataset_id"), "unit_key").distinct()
    return rec.join(C.one_unit_each(spark, d).select("unit_key", F.col("waveform").cast("array<double>").alias("waveform")), "unit_key").select("dataset_id", F.col("unit_key").cast("string").alias("unit_id"), "waveform")


_KIND = f"""{_TR_US}, {_UNIT}, k AS (SELECT dataset_id, unit_id, count(*) AS k FROM us GROUP BY ALL), ru AS (SELECT DISTINCT CAST(recording_no AS VARCHAR) AS dataset_id, unit_key FROM spikes WHERE unit_key IS NOT NULL AND recording_no IS NOT NULL),
wv AS (SELECT ru.dataset_id, CAST(ru.unit_key AS VARCHAR) AS unit_id, CASE WHEN len(waveform) > 10 THEN waveform END AS w FROM ru JOIN un USING (unit_key)),
wi AS (SELECT dataset_id, unit_id, CASE WHEN w IS NOT NULL THEN (list_position(w[list_position(w, list_min(w)):], list_max(w[list_position(w, list_min(w)):])) - 1) / 20.0 END AS width FROM wv),
ct AS (SELECT dataset_id, unit_id, coalesce(k, 0) >= 50 AS enough, coalesce(k, 0) >= 50 AND coalesce(width < 0.4, false) AS axon, coalesce(k, 0) AS k, width FROM wi LEFT JOIN k USING (dataset_id, unit_id)),
ce2 AS (SELECT *, CASE WHEN NOT enough THEN 0.0 WHEN axon AND k > 100 THEN 0.8 WHEN k > 500 THEN 0.6 ELSE 0.3 END AS p FROM ct)"""


@query(f"WITH {_KIND} SELECT dataset_id, unit_id, CASE WHEN p > 0.5 THEN 'RGC' ELSE 'unknown' END AS cell_type, CAST(p AS DOUBLE) AS rgc_probability, axon AS has_axon, round(CASE WHEN enough THEN width END, 6) AS waveform_width_ms FROM ce2")
def cell_type_features(spark, d):
    got = extractors.cell_type(spike_trains(spark, d), unit_waves(spark, d))
    return got.select("dataset_id", "unit_id", "cell_type", "rgc_probability", "has_axon", R("waveform_width_ms").alias("waveform_width_ms"))


@query(f"""WITH {_TR_US}, fr AS (SELECT DISTINCT dataset_id, t_us // 1000000 * 1000000 AS a FROM us), fb AS (SELECT dataset_id, a, lead(a) OVER (PARTITION BY dataset_id ORDER BY a) AS b FROM fr)
SELECT us.dataset_id, us.unit_id, a AS edge_start, b AS edge_end, count(*) AS n, round(count(*) * 1e6 / (b - a), 6) AS rate FROM us JOIN fb ON fb.dataset_id = us.dataset_id AND t_us >= a AND t_us < b GROUP BY us.dataset_id, us.unit_id, a, b""")
def frame_interval_rates(spark, d):
    s = spike_trains(spark, d)
    frames = s.select("dataset_id", (F.floor(F.col("t_us") / 1_000_000) * 1_000_000).alias("t_us")).distinct()
    got = extractors.frame_rates(s, frames)
    return got.select("dataset_id", "unit_id", "edge_start", "edge_end", "n", R("rate").alias("rate"))


@query(f"""WITH {_BASE}, {_STEP[len(_TR_US) + 2 :]} SELECT 'baseline_127' AS feature, 'spike_count' AS field, count(*) AS n, round(sum(k), 3) AS total FROM bl
UNION ALL SELECT 'step_up_5s_5i_3x', 'on_response_flag', count(*), round(sum(CASE WHEN on_response_flag THEN 1 ELSE 0 END), 3) FROM st
UNION ALL SELECT 'step_up_5s_5i_3x', 'on_peak_value', count(*), round(sum(on_peak_value), 3) FROM st""")
def flow_features(spark, d):
    """A whole flow: a session of tables, extractors by name, features in the store of rows; their totals by field."""
    s = Session({"spikes": spike_trains(spark, d)})
    out = f"{shared_dir(spark)}/spikeloom/{spark.sparkContext.applicationId}/flow-{uuid.uuid4().hex}"
    got = pipeline.run_flow(spark, {"name": "check", "stages": {"features": {"feature_sets": ["baseline_127", "step_up_5s_5i_3x"]}}}, out, session=s)
    rows = spark.read.parquet(got.path).where("(feature = 'baseline_127' AND field = 'spike_count') OR (feature = 'step_up_5s_5i_3x' AND field IN ('on_response_flag', 'on_peak_value'))")
    return rows.groupBy("feature", "field").agg(F.count("*").alias("n"), R(F.sum("value"), 3).alias("total"))


@query(f"WITH {_UNIT}, o AS (SELECT dataset_id, unit_id, arg_min(unit_key, unit_key) AS k FROM un WHERE dataset_id IS NOT NULL AND unit_id IS NOT NULL GROUP BY ALL) SELECT o.dataset_id, o.unit_id, un.row, un.col, CAST(coalesce(len(waveform), 0) AS BIGINT) AS n_samples, round(list_sum(list_transform(waveform, lambda x: CAST(x AS DOUBLE))), 4) + 0.0 AS total FROM o JOIN un ON un.unit_key = o.k")
def load_units(spark, d):
    """Units to a store file per recording and back: what is read equals what was written."""
    u = C.one_unit_each(spark, d).where("dataset_id IS NOT NULL AND unit_id IS NOT NULL")
    one = u.groupBy("dataset_id", "unit_id").agg(F.min_by(F.struct("row", "col", "waveform"), "unit_key").alias("u"))
    rows = one.select("dataset_id", "unit_id", "u.row", "u.col", F.lit(None).cast("int").alias("global_id"), F.col("u.waveform").cast("array<double>").alias("waveform"), F.array().cast("array<bigint>").alias("spike_times"))
    folder = f"{shared_dir(spark)}/spikeloom/{spark.sparkContext.applicationId}/stores-{uuid.uuid4().hex}"
    report = cut(stores.write_files(stores.unit_nodes(rows), folder), "written")
    paths = [f"{folder}/{r.file}" for r in report.select("file").collect()]  # a name per recording
    back = stores.units(stores.nodes(spark, paths, ["units/*@row", "units/*@col", "units/*/waveform", "units/*@spike_count"])) if paths else rows
    w = F.col("waveform")
    back = back.select("dataset_id", "unit_id", "row", "col", F.coalesce(F.size(w), F.lit(0)).cast("long").alias("n"), w.alias("waveform"))
    return back.select("dataset_id", "unit_id", "row", "col", F.greatest("n", F.lit(0)).cast("long").alias("n_samples"), (R(F.when(F.size("waveform") > 0, A.total(F.col("waveform"))), 4) + F.lit(0.0)).alias("total"))


@query(f"""WITH o AS (SELECT DISTINCT dataset_id FROM recordings WHERE dataset_id IS NOT NULL), h AS (SELECT DISTINCT dataset_id, chip FROM recordings WHERE dataset_id IS NOT NULL AND stage1_completed)
SELECT dataset_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT dataset_id, chip FROM h UNION SELECT dataset_id, chip FROM recordings WHERE dataset_id IS NOT NULL AND dataset_id NOT IN (SELECT dataset_id FROM h)) GROUP BY 1""")
def append_features(spark, d):
    """Incremental append: finished recordings first, then all of them; keys that are there are left alone."""
    r = table(spark, d, "recordings").where("dataset_id IS NOT NULL")
    path = f"{shared_dir(spark)}/spikeloom/{spark.sparkContext.applicationId}/append-{uuid.uuid4().hex}"
    append_new(r.where("stage1_completed").select("dataset_id", "chip").distinct(), path, ["dataset_id"])
    append_new(r.select("dataset_id", "chip").distinct(), path, ["dataset_id"])
    return spark.read.parquet(path).groupBy("dataset_id").agg(F.count("*").alias("n"))


@query(f"""WITH f AS (SELECT DISTINCT '/data/' || {_RECKEY("dataset_id")} AS stem FROM recordings WHERE dataset_id IS NOT NULL AND {_RECKEY("dataset_id")} <> '--Rec'),
n AS (SELECT stem, row_number() OVER (ORDER BY stem) AS i FROM f) SELECT stem || CASE WHEN i % 2 = 0 THEN '_sorted' ELSE '' END || '.cmtr' AS sorted_path, stem || '.cmcr' AS raw_path, CASE WHEN i % 2 = 0 THEN 'suffix' ELSE 'same' END AS how FROM n""")
def partner_files(spark, d):
    """Raw files of sorted ones, by name alone."""
    rec = table(spark, d, "recordings").select(F.concat(F.lit("/data/"), recording_key("dataset_id")).alias("stem")).dropna().distinct()
    n = rec.select("stem", F.row_number().over(Window.orderBy("stem")).alias("i"))  # a row per recording
    files = n.select(F.concat("stem", F.when(F.col("i") % 2 == 0, "_sorted").otherwise(""), F.lit(".cmtr")).alias("path")).unionByName(n.select(F.concat("stem", F.lit(".cmcr")).alias("path")))
    return pipeline.partner_files(files)


# -- column functions ------------------------------------------------------------------------------------------------

_T = lambda a, b: f"CASE WHEN {b} = 0 THEN sign({a}) ELSE (1 - exp(-2 * ({a}) / {b})) / (1 + exp(-2 * ({a}) / {b})) END"


@query(f"WITH {_CELL} SELECT unit_key, round({_T('dsi - 1', 'osi')}, 5) AS on_off, round({_T('osi', 'step_up_QI')}, 5) AS on_trans_sus, round({_T('dsi', 'step_up_QI')}, 5) AS off_trans_sus FROM ce WHERE dsi IS NOT NULL AND osi > 0.05 AND step_up_QI > 0.05")
def tanh_ratios(spark, d):
    c = C.one_cell_each(spark, d).where("dsi IS NOT NULL AND osi > 0.05 AND step_up_QI > 0.05")
    t = lambda a, b: R(G.tanh_ratio(a, b), 5)
    return c.select("unit_key", t(F.col("dsi") - 1, F.col("osi")).alias("on_off"), t(F.col("osi"), F.col("step_up_QI")).alias("on_trans_sus"), t(F.col("dsi"), F.col("step_up_QI")).alias("off_trans_sus"))


@query(f"""WITH {_UNIT} SELECT unit_key, cos(radians(row * 7.5)) * (110 - col) + sin(radians(row * 7.5)) * (110 - row) >= 0 AS toward, least(greatest(CAST(trunc((row / 20.0 - 3) * 20 + 0.5) AS BIGINT), 0), 299) AS fine,
round(pi() * (row + 1) / 15.0 * (col + 1) / 15.0, 6) AS area FROM un WHERE row IS NOT NULL AND col IS NOT NULL AND abs(cos(radians(row * 7.5)) * (110 - col) + sin(radians(row * 7.5)) * (110 - row)) > 1e-6""")
def place_functions(spark, d):
    u = C.one_unit_each(spark, d).where("row IS NOT NULL AND col IS NOT NULL")
    x, y, a = F.col("col").cast("double"), F.col("row").cast("double"), F.col("row") * 7.5
    way = F.cos(F.radians(a)) * (110 - x) + F.sin(F.radians(a)) * (110 - y)
    return u.where(F.abs(way) > 1e-6).select("unit_key", G.points_toward(x, y, a, F.lit(110.0), F.lit(110.0)).alias("toward"), G.coarse_to_fine(y / 20.0 - 3, 20, 0.5).alias("fine"), R(G.ellipse_area(y + 1, x + 1)).alias("area"))


@query(f"""WITH {_UNIT}, s AS (SELECT unit_key, row || ', ' || col || ',x, 7' AS lanes, 'l, ' || (row / 10.0) || ', ' || (CASE WHEN col % 3 = 0 THEN 'none' ELSE CAST(col AS VARCHAR) END) AS eye, dataset_id || '--' AS id, '/p/RGC/' || dataset_id || '_unit' || col || '.png' AS label FROM un WHERE row IS NOT NULL AND col IS NOT NULL AND dataset_id IS NOT NULL)
SELECT unit_key, list_sort(list_filter(list_transform(string_split(lanes, ','), lambda x: TRY_CAST(trim(x) AS INTEGER) - 1), lambda x: x IS NOT NULL)) AS lanes,
CASE WHEN TRY_CAST(trim(string_split(eye, ',')[3]) AS DOUBLE) IS NOT NULL THEN round(-CAST(trim(string_split(eye, ',')[2]) AS DOUBLE), 6) + 0.0 END AS dv, TRY_CAST(trim(string_split(eye, ',')[3]) AS DOUBLE) AS nt,
rtrim(id, '-') AS safe_id, CAST(regexp_extract(label, '_unit(\\d+)\\.png$', 1) AS BIGINT) AS label_unit, lower(string_split(label, '/')[3]) AS label FROM s""")
def name_functions(spark, d):
    u = C.one_unit_each(spark, d).where("row IS NOT NULL AND col IS NOT NULL AND dataset_id IS NOT NULL")
    s = u.select(
        "unit_key", F.concat("row", F.lit(", "), "col", F.lit(",x, 7")).alias("lanes"), F.concat(F.lit("l, "), (F.col("row") / 10.0).cast("string"), F.lit(", "), F.when(F.col("col") % 3 == 0, "none").otherwise(F.col("col").cast("string"))).alias("eye"),
        F.concat("dataset_id", F.lit("--")).alias("id"), F.concat(F.lit("/p/RGC/"), "dataset_id", F.lit("_unit"), "col", F.lit(".png")).alias("label"),
    )
    eye, (no, kind) = N.eye_position(F.col("eye")), N.label_unit(F.col("label"))
    return s.select("unit_key", N.lane_list(F.col("lanes")).alias("lanes"), (R(eye["dv"]) + F.lit(0.0)).alias("dv"), eye["nt"].alias("nt"), N.safe_id(F.col("id")).alias("safe_id"), no.alias("label_unit"), kind.alias("label"))


@query(f"""WITH {_W}, m AS (SELECT unit_key, w, list_min(w) AS lo, list_max(w) AS hi, list_median(w[1:5]) AS b FROM wv)
SELECT unit_key, list_transform(list_filter(range(len(w)), lambda i: i % 6 = 0), lambda i: round(w[i + 1], 4) + 0.0) AS thin, list_transform(w, lambda x: round((x - lo) / CASE WHEN hi - lo < 1e-10 THEN 1 ELSE hi - lo END + 1e-9, 5)) AS scaled,
list_transform(w, lambda x: round(x - b + 1e-9, 4) + 0.0) AS lifted, round(sqrt(list_sum(list_transform(w[1:25], lambda x, i: (x - w[25 + i]) * (x - w[25 + i])))), 4) AS apart,
list_transform(range(25), lambda i: round((w[i + 1] + w[i + 26]) / 2 + 1e-9, 4) + 0.0) AS mean_of_halves FROM m WHERE len(w) = 50""")
def trace_functions(spark, d):
    w = F.col("w")
    x = C.waves(spark, d).where(F.size("w") == 50)
    halves = F.array(F.slice(w, 1, 25), F.slice(w, 26, 25))
    z = lambda a, n, e=0.0: F.transform(a, lambda v: R(v + e, n) + F.lit(0.0))
    return x.select("unit_key", z(traces.thinned(w, 60.0, 10.0), 4).alias("thin"), F.transform(traces.normalized(w, "minmax"), lambda v: R(v + 1e-9, 5)).alias("scaled"), z(A.minus_baseline(w, 5), 4, 1e-9).alias("lifted"), R(A.distance(halves[0], halves[1]), 4).alias("apart"), z(traces.mean_of_trials(halves), 4, 1e-9).alias("mean_of_halves"))


@query(f"""WITH {_W}, t AS (SELECT unit_key, CASE WHEN unit_key % 3 = 0 THEN w[1:40] ELSE w END AS w FROM wv WHERE len(w) = 50), n AS (SELECT min(len(w)) AS n FROM t), c AS (SELECT unit_key, w[1:n] AS w FROM t, n),
s AS (SELECT unit_key, w, list_avg(w) AS m, list_stddev_pop(w) AS s FROM c) SELECT unit_key, list_transform(w, lambda x: round((x - m) / CASE WHEN s > 1e-10 THEN s ELSE 1 END + 1e-9, 4) + 0.0) AS trace FROM s""")
def segment_traces(spark, d):
    """Segments cut to the shortest over all rows, z-scored."""
    w = C.waves(spark, d).where(F.size("w") == 50).select("unit_key", F.when(F.col("unit_key") % 3 == 0, F.slice("w", 1, 40)).otherwise(F.col("w")).alias("w"))
    got = traces.segments(w, ["unit_key"], {"sta_time_course": F.col("w")}, "zscore")
    return got.select("unit_key", F.transform("sta_time_course", lambda v: R(v + 1e-9, 4) + F.lit(0.0)).alias("trace"))


@query(f"WITH {_SP}, {_LEN} SELECT unit_key, t, CAST(round_even(t * 1e6 * 20000 / 1e6, 0) AS BIGINT) AS sample FROM (SELECT DISTINCT unit_key, t FROM sp WHERE unit_key IS NOT NULL)")
def sample_times(spark, d):
    s = C.spikes(spark, d).where("unit_key IS NOT NULL").select("unit_key", "t").distinct()
    return s.select("unit_key", "t", timeline.microseconds_to_samples(F.col("t") * 1e6, F.lit(20000.0)).alias("sample"))


@query(f"""WITH {_SP}, c AS (SELECT recording_no, CAST(floor(t / 10) AS BIGINT) AS b, CAST(count(*) AS DOUBLE) AS v FROM sp GROUP BY ALL), d AS (SELECT *, lead(v) OVER w - v AS d FROM c WINDOW w AS (PARTITION BY recording_no ORDER BY b)),
e AS (SELECT *, lag(d) OVER w AS a, lead(d) OVER w AS z FROM d WINDOW w AS (PARTITION BY recording_no ORDER BY b)) SELECT recording_no, b, d AS rise FROM e WHERE d >= 5 AND (a IS NULL OR a < d) AND (z IS NULL OR z <= d)""")
def onset_steps(spark, d):
    c = C.spikes(spark, d).groupBy("recording_no", F.floor(F.col("t") / 10).cast("long").alias("b")).agg(F.count("*").cast("double").alias("v"))
    return timeline.onset_frames(c, ["recording_no"], "b", "v", 5.0).select("recording_no", "b", "rise")


@query(f"""WITH {_RD}, b AS (SELECT course_key, CAST(floor(t / 5) AS BIGINT) AS k, avg(r) * 100 + 50 AS bic FROM rd GROUP BY ALL), p AS (SELECT *, lag(bic) OVER w AS pb, lag(k) OVER w AS pk FROM b WINDOW w AS (PARTITION BY course_key ORDER BY k))
SELECT course_key, arg_min(k, (bic, k)) AS k_min, coalesce(arg_min(pk, k) FILTER ((pb - bic) / abs(pb) < 0.01), arg_min(k, (bic, k))) AS k_elbow FROM p GROUP BY 1""")
def bic_choices(spark, d):
    b = C.readings(spark, d).groupBy("course_key", F.floor(F.col("t") / 5).cast("long").alias("k")).agg((F.avg("r") * 100 + 50).alias("bic"))
    return population.bic_choice(b, ["course_key"], "k", "bic")


@query("""WITH v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64), p AS (SELECT vec_id, i % 16 AS pix, i // 16 AS t, CAST(e[i + 1] AS DOUBLE) AS v FROM v, (SELECT unnest(range(64)) AS i))
SELECT vec_id, CAST(pix // 4 AS INTEGER) AS row, CAST(pix % 4 AS INTEGER) AS col, round(max(v) - min(v), 6) AS swing FROM p GROUP BY vec_id, pix""")
def cube_projections(spark, d):
    """Embeddings as cubes of four frames of four by four pixels: per pixel the swing in time."""
    e = table(spark, d, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").cast("string").alias("dataset_id"), F.lit("u").alias("unit_id"), F.col("embedding").cast("array<double>").alias("average"), F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"))
    return axon.projections(e).select(F.col("dataset_id").cast("long").alias("vec_id"), "row", "col", R("swing").alias("swing"))


@query("""WITH v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64), p AS (SELECT vec_id, i % 16 AS pix, CAST(e[i + 1] AS DOUBLE) AS v FROM v, (SELECT unnest(range(64)) AS i)), s AS (SELECT vec_id, pix, max(v) - min(v) AS w, stddev_pop(v) AS sd FROM p GROUP BY ALL),
a AS (SELECT vec_id, stddev_pop(v) AS sd FROM p GROUP BY 1) SELECT s.vec_id, CAST(arg_max(pix // 4, (w, -pix)) AS DOUBLE) AS center_row, CAST(arg_max(pix % 4, (w, -pix)) AS DOUBLE) AS center_col, CAST(count(*) FILTER (s.sd > a.sd) AS DOUBLE) AS n_responsive FROM s JOIN a USING (vec_id) GROUP BY s.vec_id""")
def cube_centers(spark, d):
    from spikeloom.operators import imaging

    def kernel(cube):
        r, c = imaging.swing_center(cube)
        return {"center_row": float(r), "center_col": float(c), "n_responsive": float(len(imaging.responsive(cube, 1.0)))}

    names = ["center_row", "center_col", "n_responsive"]
    e = table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"))
    return e.select("vec_id", imaging.cube_udf(kernel, names)(F.col("x"), F.col("shape")).alias("f")).select("vec_id", "f.*")


# -- directions, averages --------------------------------------------------------------------------------------------


@query(f"""WITH {_SP}, ft AS (SELECT DISTINCT unit_key, CAST(floor(t * 60) AS BIGINT) AS f FROM sp WHERE unit_key IS NOT NULL), tr AS (SELECT unit_key, i % 8 AS direction, i // 8 AS rep, 600 + i * 300 - 10 AS a, 600 + i * 300 + 120 + 10 AS b FROM (SELECT DISTINCT unit_key FROM ft), (SELECT unnest(range(24)) AS i))
SELECT ft.unit_key, CAST(direction AS INTEGER) AS direction, CAST(rep AS BIGINT) AS rep, count(*) AS n, min(f - 600) AS first_frame FROM ft JOIN tr ON tr.unit_key = ft.unit_key AND f >= a AND f <= b GROUP BY ALL""")
def direction_sections(spark, d):
    """Frames with spikes inside three rounds of eight directions; both bounds count."""
    f = C.spikes(spark, d).where("unit_key IS NOT NULL").select("unit_key", F.floor(F.col("t") * 60).cast("long").alias("f")).distinct()
    units = f.select("unit_key").distinct().withColumns({"row": F.lit(0), "col": F.lit(0), "start": F.lit(600)})
    timing = spark.createDataFrame([(0, 0, [300 * i for i in range(24)], [300 * i + 120 for i in range(24)])], "row int, col int, on array<int>, off array<int>")
    spans = directions.direction_spans(units, timing, "start")
    got = directions.section_by_direction(f, spans, ["unit_key"], "f", "start")
    return got.groupBy("unit_key", "direction", F.col("rep").cast("long").alias("rep")).agg(F.count("*").alias("n"), F.min("movie_frame").alias("first_frame"))


@query(f"""WITH {_SP}, f AS (SELECT unit_key, CAST(floor(t * 60) AS BIGINT) AS f FROM sp WHERE unit_key IS NOT NULL) SELECT unit_key, count(*) FILTER (f - 60 >= 0 AND f < 30000) AS n_used, count(*) FILTER (NOT (f - 60 >= 0 AND f < 30000)) AS n_excluded FROM f GROUP BY 1""")
def sta_exclusions(spark, d):
    f = C.spikes(spark, d).where("unit_key IS NOT NULL").select("unit_key", F.floor(F.col("t") * 60).cast("long").alias("f"))
    return sta.excluded_spikes(f, "unit_key", "f", -60, 0, 30000)


@query(f"""WITH {_RD}, p AS (SELECT course_key, CAST(floor(t / 3) AS BIGINT) AS b, r FROM rd) SELECT course_key, b, round(sum(r), 5) AS total, count(*) AS n, round(avg(r) + 1e-9, 6) AS average FROM p GROUP BY ALL""")
def partial_sums(spark, d):
    """Sums of chunks of a minute that add up to those of three."""
    r = C.readings(spark, d)
    chunks = r.groupBy("course_key", F.floor(F.col("t") / 3).cast("long").alias("b"), F.floor("t").alias("chunk")).agg(F.sum("r").alias("total"), F.count("*").alias("n"))
    got = sta.add_partials(chunks, ["course_key", "b"])
    return got.select("course_key", "b", R("total", 5).alias("total"), "n", R(F.col("average") + 1e-9).alias("average"))


# -- clusters and embeddings -----------------------------------------------------------------------------------------

#: Centres of the soft assignments that the checks use.
_CENTRES = np.array([[0.1, 0.2, 0.2], [0.8, 0.5, 0.3], [0.3, 0.6, 0.8]])
_Q = f"""{_CELL}, sp3 AS (SELECT unit_key, iprgc_20hz_QI > 0.5 AS y, [dsi, osi, iprgc_2hz_QI] AS z FROM ce WHERE dsi IS NOT NULL AND osi IS NOT NULL AND iprgc_2hz_QI IS NOT NULL),
kq AS (SELECT unit_key, y, {', '.join(f'1 / (1 + (z[1] - {a}) ** 2 + (z[2] - {b}) ** 2 + (z[3] - {c}) ** 2) AS k{i}' for i, (a, b, c) in enumerate(_CENTRES.tolist()))} FROM sp3),
q AS (SELECT unit_key, y, k0 / (k0 + k1 + k2) AS q0, k1 / (k0 + k1 + k2) AS q1, k2 / (k0 + k1 + k2) AS q2 FROM kq), f AS (SELECT sum(q0) AS f0, sum(q1) AS f1, sum(q2) AS f2, count(*) AS n FROM q),
s AS (SELECT unit_key, q0, q1, q2, q0 * q0 / f0 AS s0, q1 * q1 / f1 AS s1, q2 * q2 / f2 AS s2 FROM q, f), p AS (SELECT unit_key, q0, q1, q2, s0 / (s0 + s1 + s2) AS p0, s1 / (s0 + s1 + s2) AS p1, s2 / (s0 + s1 + s2) AS p2 FROM s)"""


def soft_cells(spark, d):
    dims = ["dsi", "osi", "iprgc_2hz_QI"]
    c = C.one_cell_each(spark, d).dropna(subset=dims)
    return c.select("unit_key", (F.col("iprgc_20hz_QI") > 0.5).alias("y"), embedding.soft_assignment(F.array(*dims), _CENTRES).alias("q"))


@query(f"WITH {_Q} SELECT unit_key, [round(q0, 6), round(q1, 6), round(q2, 6)] AS q, [round(p0, 6), round(p1, 6), round(p2, 6)] AS p FROM p")
def soft_assignments(spark, d):
    got = embedding.target_distribution(soft_cells(spark, d), "q")
    six = lambda c: F.transform(c, lambda x: R(x)).alias(c)
    return got.select("unit_key", six("q"), six("p"))


@query(f"""WITH {_Q} SELECT round(avg(p0 * ln(p0 / q0) + p1 * ln(p1 / q1) + p2 * ln(p2 / q2)), 6) AS divergence,
(SELECT round(1 + (f0 / n * ln(f0 / n + 1e-10) + f1 / n * ln(f1 / n + 1e-10) + f2 / n * ln(f2 / n + 1e-10)) / ln(3), 6) FROM f) AS balance FROM p""")
def soft_losses(spark, d):
    q = soft_cells(spark, d)
    kl = embedding.divergence(embedding.target_distribution(q, "q"), "p", "q").select(R("loss").alias("divergence"))
    return kl.join(F.broadcast(embedding.balance_loss(q, "q").select(R("loss").alias("balance"))))  # one row each


@query(f"""WITH {_Q}, g AS (SELECT 0 AS cluster, sum(CASE WHEN y THEN q0 ELSE 0 END) / (sum(q0) + 1e-10) AS share FROM q UNION ALL SELECT 1, sum(CASE WHEN y THEN q1 ELSE 0 END) / (sum(q1) + 1e-10) FROM q UNION ALL SELECT 2, sum(CASE WHEN y THEN q2 ELSE 0 END) / (sum(q2) + 1e-10) FROM q)
SELECT CAST(cluster AS INTEGER) AS cluster, round(share, 6) AS share, row_number() OVER (ORDER BY share DESC, cluster) AS rank FROM g QUALIFY rank <= 2""")
def soft_targets(spark, d):
    got = embedding.target_clusters(soft_cells(spark, d), "q", F.coalesce("y", F.lit(False)), 2)
    return got.select("cluster", R("share").alias("share"), "rank")


@query("""WITH e AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings) SELECT label, i AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(v AS DOUBLE)), 6) AS sd FROM e GROUP BY ALL""")
def cluster_moments(spark, d):
    got = clusters.moments(table(spark, d, "embeddings"), "label", "embedding")
    return got.select("label", F.col("dim").cast("long").alias("dim"), R("mean").alias("mean"), R("sd").alias("sd"))


@query(f"WITH {_CELL}, s AS (SELECT axon_type, avg(dsi) AS m, stddev_pop(dsi) AS s FROM ce GROUP BY 1) SELECT unit_key, round(CASE WHEN s > 0 THEN (dsi - m) / s ELSE 0 END + 1e-9, 6) AS z FROM ce JOIN s ON ce.axon_type IS NOT DISTINCT FROM s.axon_type WHERE dsi IS NOT NULL")
def standardized_by_group(spark, d):
    got = clusters.standardized(C.one_cell_each(spark, d), ["dsi"], ["axon_type"])
    return got.where("dsi IS NOT NULL").select("unit_key", R(F.col("dsi") + 1e-9).alias("z"))


@query(f"""WITH {_CELL}, g AS (SELECT unit_key, CASE WHEN iprgc_2hz_QI > 0.8 THEN 'ipRGC' WHEN ds_p_value < 0.05 THEN 'DS' WHEN osi > 0.5 THEN 'OS' ELSE 'Other' END AS kind FROM ce), o AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS code FROM (SELECT DISTINCT kind FROM g))
SELECT unit_key, kind, code FROM g JOIN o USING (kind)""")
def encoded_groups(spark, d):
    kind = population.priority_group([("ipRGC", F.col("iprgc_2hz_QI") > 0.8), ("DS", F.col("ds_p_value") < 0.05), ("OS", F.col("osi") > 0.5)])
    return population.encoded(C.one_cell_each(spark, d).select("unit_key", kind.alias("kind")), "kind", "code")


@query(f"WITH {_CELL} SELECT unit_key, dsi, osi FROM ce WHERE dsi IS NOT NULL AND osi IS NOT NULL AND step_up_QI IS NOT NULL")
def dropped_nulls(spark, d):
    return C.one_cell_each(spark, d).dropna(subset=["dsi", "osi", "step_up_QI"]).select("unit_key", "dsi", "osi")


@query(f"WITH {_W} SELECT unit_key, list_sort(list_transform(list_sort(list_transform(range(len(w)), lambda i: {{'v': w[i + 1], 'i': i}}))[len(w) - 3 :], lambda s: s.i)) AS at FROM wv WHERE len(w) > 4")
def last_of_sorted(spark, d):
    """The places of the four greatest values of each trace."""
    w = F.col("w")
    pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("v"), i.cast("long").alias("i"))))
    return C.waves(spark, d).where(F.size("w") > 4).select("unit_key", F.sort_array(F.transform(F.slice(pairs, F.size(w) - 3, 4), lambda s: s["i"])).alias("at"))


@query(f"WITH {_CELL}, {_UNIT} SELECT ce.unit_key, ce.dsi, un.row, un.rate FROM ce LEFT JOIN un USING (unit_key)")
def columns_side_by_side(spark, d):
    """Two tables of one row per unit, side by side by their key."""
    return C.one_cell_each(spark, d).select("unit_key", "dsi").join(C.one_unit_each(spark, d).select("unit_key", "row", "rate"), "unit_key", "left")


@query(f"""WITH {_CELL}, c AS (SELECT dataset_id, count(*) FILTER (dsi > 0.5) AS r0, count(*) FILTER (osi > 0.5) AS r1, count(*) FILTER (step_up_QI > 0.5) AS r2 FROM ce GROUP BY 1) SELECT dataset_id, 'r0' AS name, r0 AS value FROM c UNION ALL SELECT dataset_id, 'r1', r1 FROM c UNION ALL SELECT dataset_id, 'r2', r2 FROM c""")
def long_from_wide(spark, d):
    """Columns to rows: the long form of counted features."""
    c = C.one_cell_each(spark, d).groupBy("dataset_id").agg(F.count_if(F.col("dsi") > 0.5).alias("r0"), F.count_if(F.col("osi") > 0.5).alias("r1"), F.count_if(F.col("step_up_QI") > 0.5).alias("r2"))
    return c.unpivot(["dataset_id"], ["r0", "r1", "r2"], "name", "value")


@query("SELECT e.vec_id, label, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 5) + 0.0 AS e_{i}" for i in range(3)) + ", CAST(len(embedding) AS INTEGER) AS n FROM embeddings e")
def saved_embeddings(spark, d):
    """Embeddings as columns, the way they are saved."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[(R(F.get("embedding", i).cast("double"), 5) + F.lit(0.0)).alias(f"e_{i}") for i in range(3)], F.size("embedding").alias("n"))


@query()
def sparse_scores(spark, d):
    """Scores on four sparse components of the embeddings, ten weights each."""
    got, _ = embedding.feature_matrix(table(spark, d, "embeddings"), ["vec_id"], {"e": ("embedding", 4, 10)})
    return got.select("vec_id", F.transform("features", lambda x: R(x, 4)).alias("scores"))


@query()
def refined_clusters(spark, d):
    """The soft clusters' centres after refinement on all cells."""
    dims = ["dsi", "osi", "iprgc_2hz_QI"]
    c = C.one_cell_each(spark, d).dropna(subset=dims).select("unit_key", F.array(*dims).alias("z"))
    centres, _ = embedding.refine(c, "z", _CENTRES, steps=20)
    return c.select("unit_key", A.argmax(embedding.soft_assignment(F.col("z"), centres)).alias("cluster"))


@query()
def axon_tracks(spark, d):
    """Somata and initial segments of cubes made of the embeddings."""
    e = table(spark, d, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").cast("string").alias("dataset_id"), F.lit("u").alias("unit_id"), F.col("embedding").cast("array<double>").alias("average"), F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"))
    return axon.tracks(e, None).select(F.col("dataset_id").cast("long").alias("vec_id"), "status", "soma_t", "soma_row", "soma_col")

