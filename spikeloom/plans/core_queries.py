"""Queries of the core operators over whole tables, each with independent SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spikeloom.functions import arrays as A
from spikeloom.functions import geometry as G
from spikeloom.functions import names as N
from spikeloom.functions.keys import recording_key, unit_number, usable
from spikeloom.functions.signal import lowpass, peak_positions
from spikeloom.operators import clusters, features, joins, ordered, pathways, population, quality, rates, sta, timeline
from spikeloom.session import cut, table
from spikeloom.sources.writers import flat

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query_of(queries: dict, sqls: dict[str, str]):
    """A decorator that registers a query under its function's name, with its SQL."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                sqls[f.__name__] = sql
            return f

        return add

    return query


query = query_of(QUERIES, SQL)


def R(c, digits: int = 6):
    return F.round(c, digits)


# -- base views ------------------------------------------------------------------------------------------------------


def spikes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "spikes").where(usable("spike_times_sec"))
    return s.select("recording_no", "unit_key", F.col("spike_times_sec").alias("t"))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    """One row per recording: its duration."""
    r = table(spark, d, "recordings").where(usable("duration_sec") & (F.col("duration_sec") > 0))
    return r.groupBy("recording_no").agg(F.max("duration_sec").alias("dur"))


def one_unit_each(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "units")
    return u.groupBy("unit_key").agg(F.max("dataset_id").alias("dataset_id"), F.max("unit_id").alias("unit_id"), F.max("row").alias("row"), F.max("col").alias("col"), F.max("waveform").alias("waveform"), F.max(F.when(usable("mean_firing_rate"), F.col("mean_firing_rate"))).alias("rate"))


def one_cell_each(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cells")
    top = {"dsi": 2.5, "osi": 1.0, "step_up_QI": 1.0, "iprgc_2hz_QI": 1.0, "iprgc_20hz_QI": 1.0, "ds_p_value": 1.0, "preferred_direction": 360.0}
    return c.groupBy("unit_key").agg(F.max("dataset_id").alias("dataset_id"), F.max(F.lower("axon_type")).alias("axon_type"), *[F.max(F.when(usable(n, 0.0, t), F.col(n))).alias(n) for n, t in top.items()])


def readings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "time_course").where(usable("time_bins_min") & usable("firing_rates") & F.col("course_key").isNotNull())
    return t.select("course_key", "chip", "reading_id", F.col("time_bins_min").alias("t"), F.col("firing_rates").alias("r"))


_SP = "sp AS (SELECT recording_no, unit_key, spike_times_sec AS t FROM spikes WHERE spike_times_sec >= 0 AND CAST(spike_times_sec AS VARCHAR) <> 'nan')"
_LEN = "len AS (SELECT recording_no, max(duration_sec) AS dur FROM recordings WHERE duration_sec > 0 AND CAST(duration_sec AS VARCHAR) <> 'nan' GROUP BY ALL)"
_UNIT = "un AS (SELECT unit_key, max(dataset_id) AS dataset_id, max(unit_id) AS unit_id, max(row) AS row, max(col) AS col, max(waveform) AS waveform, max(CASE WHEN mean_firing_rate >= 0 AND CAST(mean_firing_rate AS VARCHAR) <> 'nan' THEN mean_firing_rate END) AS rate FROM units GROUP BY unit_key)"
_ok = lambda c, t: f"max(CASE WHEN {c} BETWEEN 0 AND {t} AND CAST({c} AS VARCHAR) <> 'nan' THEN {c} END) AS {c}"
_CELL = "ce AS (SELECT unit_key, max(dataset_id) AS dataset_id, max(lower(axon_type)) AS axon_type, " + ", ".join([_ok("dsi", 2.5), _ok("osi", 1), _ok("step_up_QI", 1), _ok("iprgc_2hz_QI", 1), _ok("iprgc_20hz_QI", 1), _ok("ds_p_value", 1), _ok("preferred_direction", 360)]) + " FROM cells GROUP BY unit_key)"
_RD = "rd AS (SELECT course_key, chip, reading_id, time_bins_min AS t, firing_rates AS r FROM time_course WHERE course_key IS NOT NULL AND time_bins_min >= 0 AND CAST(time_bins_min AS VARCHAR) <> 'nan' AND firing_rates >= 0 AND CAST(firing_rates AS VARCHAR) <> 'nan')"
_TR = "tr AS (SELECT recording_no, i AS trial_idx, i * 60.0 AS s, i * 60.0 + 60 AS e FROM (SELECT recording_no, unnest(range(CAST(floor(dur / 60) AS BIGINT))) AS i FROM len))"


def trial_spans(spark: SparkSession, d: str) -> DataFrame:
    """Trials of a minute over each recording."""
    n = F.floor(F.col("dur") / 60.0).cast("long")
    return lengths(spark, d).where(n > 0).select("recording_no", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("trial_idx")).select("recording_no", "trial_idx", (F.col("trial_idx") * 60.0).alias("s"), (F.col("trial_idx") * 60.0 + 60.0).alias("e"))


# -- joins -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_SP}, {_LEN}, {_TR} SELECT sp.recording_no, trial_idx, count(*) AS n_spikes, round(min(t), 6) AS first_spike
FROM sp JOIN tr ON sp.recording_no = tr.recording_no AND t >= greatest(0, s - 1) AND t < e + 2 GROUP BY ALL""")
def section_range_join(spark, d):
    got = timeline.section_events(spikes(spark, d), trial_spans(spark, d), ["recording_no"], "t", "s", "e", 1.0, 2.0, 30.0)
    return got.groupBy("recording_no", "trial_idx").agg(F.count("*").alias("n_spikes"), R(F.min("t")).alias("first_spike"))


@query(f"""WITH {_SP}, {_LEN}, {_TR} SELECT unit_key, count(DISTINCT t) AS n_distinct, count(*) AS n_joined
FROM sp JOIN tr ON sp.recording_no = tr.recording_no AND t >= greatest(0, s - 1) AND t < e + 2 GROUP BY ALL""")
def section_distinct_union(spark, d):
    got = timeline.section_events(spikes(spark, d), trial_spans(spark, d), ["recording_no"], "t", "s", "e", 1.0, 2.0, 30.0)
    per_time = got.groupBy("unit_key", "t").agg(F.count("*").alias("k"))
    return per_time.groupBy("unit_key").agg(F.count("*").alias("n_distinct"), F.sum("k").alias("n_joined"))


def event_sides(spark, d, left: str, right: str):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    a = e.where(F.col("event_type") == left).select("user_id", "event_id", "us")
    b = e.where(F.col("event_type") == right).select("user_id", F.col("event_id").alias("hit_id"), F.col("us").alias("hit_us"))
    return a, b


_EV = "ev AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events)"
_SIDES = "a AS (SELECT * FROM ev WHERE event_type = 'purchase'), b AS (SELECT user_id, us AS hit_us, max(event_id) AS hit_id FROM ev WHERE event_type = 'view' GROUP BY ALL)"


@query(f"WITH {_EV}, {_SIDES} SELECT a.event_id, hit_us, hit_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.us >= b.hit_us")
def asof_backward(spark, d):
    a, b = event_sides(spark, d, "purchase", "view")
    return joins.asof_join(a, b, ["user_id"], "us", "hit_us", ["hit_us", "hit_id"]).select("event_id", "hit_us", "hit_id")


@query(f"WITH {_EV}, {_SIDES} SELECT a.event_id, hit_us, hit_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.us <= b.hit_us")
def asof_forward(spark, d):
    a, b = event_sides(spark, d, "purchase", "view")
    return joins.asof_join(a, b, ["user_id"], "us", "hit_us", ["hit_us", "hit_id"], "forward").select("event_id", "hit_us", "hit_id")


@query(f"""WITH {_EV}, {_SIDES}, p AS (SELECT a.event_id, a.us, hit_us, hit_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.us >= b.hit_us),
n AS (SELECT a.event_id, hit_us, hit_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.us <= b.hit_us)
SELECT event_id, CASE WHEN n.hit_us IS NULL OR p.us - p.hit_us <= n.hit_us - p.us THEN p.hit_us ELSE n.hit_us END AS hit_us,
CASE WHEN n.hit_us IS NULL OR p.us - p.hit_us <= n.hit_us - p.us THEN p.hit_id ELSE n.hit_id END AS hit_id FROM p JOIN n USING (event_id)""")
def asof_nearest(spark, d):
    a, b = event_sides(spark, d, "purchase", "view")
    return joins.asof_join(a, b, ["user_id"], "us", "hit_us", ["hit_us", "hit_id"], "nearest").select("event_id", "hit_us", "hit_id")


@query(f"""WITH {_EV}, a AS (SELECT * FROM ev WHERE event_type = 'signup'), b AS (SELECT user_id, us AS hit_us FROM ev WHERE event_type = 'purchase')
SELECT a.event_id, min(hit_us) AS hit_us FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.hit_us > a.us GROUP BY a.event_id""")
def pair_before_after(spark, d):
    a, b = event_sides(spark, d, "signup", "purchase")
    return joins.asof_join(a, b, ["user_id"], "us", "hit_us", ["hit_us"], "forward", strict=True).select("event_id", "hit_us")


def next_recording(spark, d):
    """Each recording with the next one of its chip."""
    r = table(spark, d, "recordings").where(F.col("chip").isNotNull()).select(recording_key("dataset_id").alias("rec"), "chip").dropna().distinct()
    w = Window.partitionBy("chip").orderBy("rec")
    return r.select("rec", F.lead("rec").over(w).alias("next")).where("next IS NOT NULL")


def unit_candidates(spark, d):
    """Units of consecutive recordings within two electrodes of each other, met in cells of the array."""
    u = one_unit_each(spark, d).select(recording_key("dataset_id").alias("rec"), "unit_key", "row", "col", "rate").where("row IS NOT NULL AND col IS NOT NULL AND rate IS NOT NULL")
    cell = lambda c: F.floor(F.col(c) / 3).cast("int")
    near = F.array(*[F.struct((cell("row") + i).alias("x"), (cell("col") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = u.join(next_recording(spark, d), "rec").select(F.col("next").alias("rec"), F.col("unit_key").alias("a"), F.col("row").alias("ra"), F.col("col").alias("ca"), F.col("rate").alias("fa"), F.explode(near).alias("c")).select("*", "c.x", "c.y").drop("c")
    b = u.select("rec", F.col("unit_key").alias("b"), F.col("row").alias("rb"), F.col("col").alias("cb"), F.col("rate").alias("fb"), cell("row").alias("x"), cell("col").alias("y"))
    d2 = (F.col("ra") - F.col("rb")) * (F.col("ra") - F.col("rb")) + (F.col("ca") - F.col("cb")) * (F.col("ca") - F.col("cb"))
    return a.join(b, ["rec", "x", "y"]).select("a", "b", d2.cast("long").alias("d2"), F.abs(F.col("fa") - F.col("fb")).alias("gap")).where("d2 <= 4")


_PASS = lambda k, lim, free: f"p{k} AS MATERIALIZED (SELECT a, b, d2, {k} AS pass_no FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, gap, a, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d2, gap, a, b) AS rb FROM cand c WHERE d2 <= {lim} {free}) WHERE ra = 1 AND rb = 1)"
_RECKEY = lambda c: f"regexp_extract({c}, '(\\d{{4}}\\.\\d{{2}}\\.\\d{{2}})[-.](\\d{{2}}\\.\\d{{2}}\\.\\d{{2}})', 1) || '-' || regexp_extract({c}, '(\\d{{4}}\\.\\d{{2}}\\.\\d{{2}})[-.](\\d{{2}}\\.\\d{{2}}\\.\\d{{2}})', 2) || '-Rec'"
_CAND = f"""{_UNIT}, rc AS (SELECT DISTINCT {_RECKEY("dataset_id")} AS rec, chip FROM recordings WHERE chip IS NOT NULL AND dataset_id IS NOT NULL),
nx AS (SELECT rec, lead(rec) OVER (PARTITION BY chip ORDER BY rec) AS nxt FROM rc), u2 AS (SELECT *, {_RECKEY("dataset_id")} AS rec FROM un WHERE rate IS NOT NULL),
cand AS MATERIALIZED (SELECT x.unit_key AS a, y.unit_key AS b, (x.row - y.row) * (x.row - y.row) + (x.col - y.col) * (x.col - y.col) AS d2, abs(x.rate - y.rate) AS gap
FROM u2 x JOIN nx ON nx.rec = x.rec JOIN u2 y ON y.rec = nx.nxt WHERE (x.row - y.row) * (x.row - y.row) + (x.col - y.col) * (x.col - y.col) <= 4)"""
_FREE = lambda k: f"AND NOT EXISTS (SELECT 1 FROM p{k} p WHERE p.a = c.a) AND NOT EXISTS (SELECT 1 FROM p{k} p WHERE p.b = c.b)"
_MATCH = f"{_CAND}, {_PASS(0, 0, '')}, {_PASS(1, 1, _FREE(0))}, {_PASS(2, 4, _FREE(0) + ' ' + _FREE(1))}, mt AS MATERIALIZED (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)"


def matched_units(spark, d):
    order = [F.col("d2"), F.col("gap"), F.col("a"), F.col("b")]
    return cut(joins.progressive_match(cut(unit_candidates(spark, d), "pairs"), "a", "b", "d2", [0, 1, 4], order), "matches")


@query(f"WITH {_MATCH} SELECT a, b, CAST(d2 AS BIGINT) AS d2, CAST(pass_no AS BIGINT) AS pass_no FROM mt")
def progressive_match(spark, d):
    return matched_units(spark, d).select("a", "b", "d2", "pass_no")


@query(f"WITH {_MATCH} SELECT m0.a AS n0, m0.b AS n1, m1.b AS n2, m2.b AS n3 FROM mt m0 LEFT JOIN mt m1 ON m1.a = m0.b LEFT JOIN mt m2 ON m2.a = m1.b WHERE NOT EXISTS (SELECT 1 FROM mt m3 WHERE m3.b = m0.a)")
def alignment_chain(spark, d):
    m = matched_units(spark, d).select("a", "b")
    heads = m.join(m.select(F.col("b").alias("a")), "a", "left_anti")
    return joins.left_chain(heads, [heads, m, m], "a")


@query(f"WITH {_MATCH} SELECT m0.a AS n0, m0.b AS n1, m1.b AS n2 FROM mt m0 JOIN mt m1 ON m1.a = m0.b")
def alignment_inner_chain(spark, d):
    m = matched_units(spark, d).select("a", "b")
    return joins.left_chain(m, [m, m], "a").where("n2 IS NOT NULL")


@query(f"WITH {_CELL}, big AS (SELECT dataset_id FROM ce GROUP BY 1 HAVING count(*) >= 25) SELECT unit_key, dataset_id FROM ce WHERE dataset_id IN (SELECT dataset_id FROM big)")
def semi_group_size(spark, d):
    return population.in_groups_of(one_cell_each(spark, d), ["dataset_id"], 25).select("unit_key", "dataset_id")


@query("SELECT DISTINCT u.unit_key FROM units u WHERE NOT EXISTS (SELECT 1 FROM spikes s WHERE s.unit_key = u.unit_key)")
def anti_units_without_spikes(spark, d):
    return table(spark, d, "units").select("unit_key").distinct().join(table(spark, d, "spikes").select("unit_key"), "unit_key", "left_anti")


@query(f"""WITH {_SP}, c AS (SELECT unit_key, count(*) AS n FROM sp GROUP BY 1), u AS (SELECT unit_key, max(spike_count) AS n FROM units GROUP BY 1)
SELECT unit_key, CASE WHEN c.unit_key IS NULL THEN 'only_a' WHEN u.unit_key IS NULL THEN 'only_b' WHEN u.n IS NOT DISTINCT FROM c.n THEN 'equal'
WHEN abs(u.n - c.n) <= 1e-8 + 0.1 * c.n THEN 'close' ELSE 'differs' END AS status FROM u FULL JOIN c USING (unit_key)""")
def compare_tables(spark, d):
    a = table(spark, d, "units").groupBy("unit_key").agg(F.max("spike_count").alias("n"))
    b = spikes(spark, d).groupBy("unit_key").agg(F.count("*").alias("n"))
    return joins.compare_tables(a, b, ["unit_key"], "n", rtol=0.1)


@query(f"""WITH u AS (SELECT {_RECKEY("dataset_id")} AS rec, unit_id, min(unit_key) AS unit_key FROM units GROUP BY ALL)
SELECT link_id, u.unit_key FROM chain_links l LEFT JOIN u ON u.rec = {_RECKEY("l.matched_file")} AND u.unit_id = l.matched_unit""")
def lookup_join(spark, d):
    u = table(spark, d, "units").groupBy(recording_key("dataset_id").alias("rec"), unit_number("unit_id").alias("no")).agg(F.min("unit_key").alias("unit_key"))
    li = table(spark, d, "chain_links").select("link_id", recording_key("matched_file").alias("rec"), unit_number("matched_unit").alias("no"))
    return li.join(u, ["rec", "no"], "left").select("link_id", "unit_key")


# -- rates -----------------------------------------------------------------------------------------------------------


_BINS = "b AS (SELECT recording_no, unnest(range(CAST(ceil(dur / 10) AS BIGINT))) AS bin_no FROM len WHERE recording_no IN (SELECT recording_no FROM sp))"


@query(f"""WITH {_SP}, {_LEN}, {_BINS}, lastb AS (SELECT recording_no, dur, CAST(ceil(dur / 10) AS BIGINT) - 1 AS z FROM len),
c AS (SELECT sp.recording_no, CASE WHEN t = dur AND CAST(floor(t / 10) AS BIGINT) = z + 1 THEN z ELSE CAST(floor(t / 10) AS BIGINT) END AS bin_no, count(*) AS n FROM sp JOIN lastb USING (recording_no) GROUP BY ALL)
SELECT recording_no, bin_no, coalesce(n, 0) AS n, coalesce(n, 0) / 10.0 AS rate FROM b LEFT JOIN c USING (recording_no, bin_no)""")
def rate_fixed_bins(spark, d):
    s = spikes(spark, d)
    spans = lengths(spark, d).join(s.select("recording_no").distinct(), "recording_no", "left_semi")
    return rates.fixed_bin_rates(s, spans, ["recording_no"], "t", "dur", 10.0)


@query(f"""WITH {_EV}, e AS (SELECT DISTINCT user_id, us FROM ev WHERE event_type = 'view'), b AS (SELECT user_id, us AS edge_start, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS edge_end FROM e),
m AS (SELECT user_id, max(edge_end) AS z FROM b GROUP BY 1)
SELECT *, round(n * 1e6 / (edge_end - edge_start), 6) AS rate FROM (SELECT b.user_id, edge_start, edge_end, count(p.us) AS n FROM b JOIN m ON m.user_id = b.user_id LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') p
ON p.user_id = b.user_id AND p.us >= edge_start AND (p.us < edge_end OR (p.us = edge_end AND edge_end = z)) WHERE edge_end IS NOT NULL GROUP BY ALL)""")
def rate_frame_aligned(spark, d):
    a, b = event_sides(spark, d, "purchase", "view")
    got = rates.interval_rates(a, b.withColumnRenamed("hit_us", "us2"), ["user_id"], "us", "us2", 86_400e6)
    return got.select("user_id", "edge_start", "edge_end", "n", R(F.col("n") * 1e6 / (F.col("edge_end") - F.col("edge_start"))).alias("rate"))


@query(f"""WITH {_LEN}, r AS (SELECT DISTINCT recording_no, condition_name FROM recordings WHERE condition_name IS NOT NULL),
n AS (SELECT condition_name, CAST(ceil(dur * 60) AS BIGINT) AS n FROM r JOIN len USING (recording_no))
SELECT condition_name, min(n) AS target, max(n) AS longest, count(*) AS n_recordings FROM n GROUP BY 1""")
def target_lengths(spark, d):
    r = table(spark, d, "recordings").select("recording_no", "condition_name").where("condition_name IS NOT NULL").distinct()
    n = F.ceil(F.col("dur") * 60).cast("long")
    return r.join(lengths(spark, d), "recording_no").groupBy("condition_name").agg(F.min(n).alias("target"), F.max(n).alias("longest"), F.count("*").alias("n_recordings"))


@query(f"""WITH {_RD}, k AS (SELECT chip, course_key, count(DISTINCT CAST(floor(t / 5) AS BIGINT)) AS k FROM rd GROUP BY ALL), f AS (SELECT chip, k, count(*) AS n FROM k WHERE chip IS NOT NULL GROUP BY ALL),
m AS (SELECT chip, arg_max(k, (n, -k)) AS mode FROM f GROUP BY 1) SELECT k.chip, course_key, k AS n_bins, mode, abs(k - mode) > 1 AS rejected FROM k JOIN m USING (chip)""")
def mode_reject(spark, d):
    k = readings(spark, d).groupBy("chip", "course_key", F.floor(F.col("t") / 5).alias("b")).agg(F.lit(1)).groupBy("chip", "course_key").agg(F.count("*").alias("n_bins"))
    m = rates.mode_value(k.where("chip IS NOT NULL"), ["chip"], "n_bins")
    return k.join(m, "chip").select("chip", "course_key", "n_bins", "mode", (F.abs(F.col("n_bins") - F.col("mode")) > 1).alias("rejected"))


@query(f"""WITH {_SP}, {_LEN}, r AS (SELECT DISTINCT recording_no, chip FROM recordings WHERE chip IS NOT NULL),
o AS (SELECT recording_no, chip, coalesce(sum(dur) OVER (PARTITION BY chip ORDER BY recording_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r JOIN len USING (recording_no) WHERE recording_no IN (SELECT recording_no FROM sp))
SELECT chip, CAST(floor((t + off) / 60) AS BIGINT) AS bin_no, count(*) AS n, round(count(*) / 60.0, 6) AS rate FROM sp JOIN o USING (recording_no) GROUP BY ALL""")
def time_course_concat(spark, d):
    r = table(spark, d, "recordings").select("recording_no", "chip").where("chip IS NOT NULL").distinct().join(lengths(spark, d), "recording_no")
    got = rates.time_course(spikes(spark, d).join(r, "recording_no"), ["chip"], "recording_no", "t", "dur", 60.0)
    return got.select("chip", "bin_no", "n", R("rate").alias("rate"))


# -- quality ---------------------------------------------------------------------------------------------------------


def trial_counts(spark, d):
    """Dense counts: every unit, the whole minutes of its recording as trials, twelve bins of five seconds."""
    n_trials = F.floor(F.col("dur") / 60).cast("long")
    s = spikes(spark, d).where("unit_key IS NOT NULL").join(lengths(spark, d), "recording_no").where(F.floor(F.col("t") / 60) < n_trials)
    n = s.groupBy("unit_key", F.floor(F.col("t") / 60).cast("long").alias("trial"), F.floor(F.pmod(F.col("t"), F.lit(60.0)) / 5).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    grid = s.groupBy("unit_key").agg(F.max(n_trials).alias("k")).select("unit_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("trial")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("bin"))
    return grid.join(n, ["unit_key", "trial", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))


_TC = f"""{_SP}, {_LEN}, s6 AS (SELECT sp.*, CAST(floor(dur / 60) AS BIGINT) AS k FROM sp JOIN len USING (recording_no) WHERE unit_key IS NOT NULL AND floor(t / 60) < floor(dur / 60)),
c6 AS (SELECT unit_key, CAST(floor(t / 60) AS BIGINT) AS trial, CAST(floor((t % 60) / 5) AS BIGINT) AS bin, count(*) AS n FROM s6 GROUP BY ALL),
tc AS (SELECT unit_key, trial, bin, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM (SELECT * FROM (SELECT unit_key, unnest(range(max(k))) AS trial FROM s6 GROUP BY unit_key) CROSS JOIN (SELECT unnest(range(12)) AS bin)) LEFT JOIN c6 USING (unit_key, trial, bin))"""


@query(f"""WITH {_TC}, v AS (SELECT unit_key, avg(v) AS noise FROM (SELECT unit_key, trial, var_pop(n) AS v FROM tc GROUP BY ALL) GROUP BY 1),
m AS (SELECT unit_key, var_pop(m) AS sig FROM (SELECT unit_key, bin, avg(n) AS m FROM tc GROUP BY ALL) GROUP BY 1) SELECT unit_key, round(CASE WHEN noise > 0 THEN sig / noise END, 6) AS qi FROM v JOIN m USING (unit_key)""")
def qi_variance_ratio(spark, d):
    return quality.variance_ratio_qi(trial_counts(spark, d), ["unit_key"], "trial", "bin", "n").select("unit_key", R("qi").alias("qi"))


@query(f"""WITH {_TC}, m AS (SELECT unit_key, bin, avg(n) AS m FROM tc GROUP BY ALL), c AS (SELECT unit_key, trial, corr(n, m) AS r, var_pop(n) AS v, var_pop(m) AS w FROM tc JOIN m USING (unit_key, bin) GROUP BY ALL)
SELECT unit_key, round(avg(CASE WHEN v > 0 AND w > 0 AND CAST(r AS VARCHAR) <> 'nan' THEN r END), 6) AS qi FROM c GROUP BY 1""")
def qi_pearson(spark, d):
    return quality.pearson_qi(trial_counts(spark, d), ["unit_key"], "trial", "bin", "n").select("unit_key", R("qi").alias("qi"))


@query(f"""WITH {_SP}, x AS (SELECT unit_key, t - lag(t) OVER (PARTITION BY unit_key ORDER BY t) AS g FROM sp WHERE unit_key IS NOT NULL)
SELECT unit_key, count(*) AS n, round(avg(g) + 1e-8, 6) AS isi_mean, round(CASE WHEN avg(g) > 0 THEN stddev_pop(g) / avg(g) END, 6) AS isi_cv, round(median(g) + 1e-8, 6) AS isi_median FROM x GROUP BY 1""")
def isi_stats(spark, d):
    got = quality.interval_stats(spikes(spark, d).where("unit_key IS NOT NULL"), ["unit_key"], "t", 60.0)
    # A mean of decimals may lie on the middle between two roundings, where engines differ; the shift takes it off.
    return got.select("unit_key", "n", R(F.col("isi_mean") + 1e-8).alias("isi_mean"), R("isi_cv").alias("isi_cv"), R(F.col("isi_median") + 1e-8).alias("isi_median"))


@query(f"""WITH {_CELL} SELECT unit_key, dataset_id, count(CASE WHEN step_up_QI > 0.5 THEN 1 END) OVER w AS good_count, count(CASE WHEN step_up_QI > 0.5 AND axon_type = 'rgc' THEN 1 END) OVER w AS good_rgc_count
FROM ce WINDOW w AS (PARTITION BY dataset_id)""")
def good_counts(spark, d):
    c = one_cell_each(spark, d)
    good = F.coalesce(F.col("step_up_QI") > 0.5, F.lit(False))
    return quality.conditional_counts(c, ["dataset_id"], {"good_count": good, "good_rgc_count": good & (F.col("axon_type") == "rgc")}).select("unit_key", "dataset_id", "good_count", "good_rgc_count")


@query(f"""WITH {_SP}, w AS (SELECT unit_key, count(*) FILTER (t >= 50 AND t < 60) / 10.0 AS base, count(*) FILTER (t >= 60 AND t < 90) / 30.0 AS on_r, count(*) FILTER (t >= 90 AND t < 120) / 30.0 AS late,
count(*) FILTER (t >= 120 AND t < 150) / 30.0 AS off_r, min(t) FILTER (t >= 60 AND t < 120) - 60 AS lat FROM sp WHERE unit_key IS NOT NULL GROUP BY 1)
SELECT unit_key, round(base, 6) AS base_rate, round(on_r, 6) AS on_rate, round(late, 6) AS on_late_rate, round(off_r, 6) AS off_rate, round(lat, 6) AS on_latency, on_r > 2 * base AS is_on, off_r > 2 * base AS is_off,
round(CASE WHEN on_r + off_r = 0 THEN 0 ELSE (on_r - off_r) / (on_r + off_r) END, 6) AS on_off_index FROM w""")
def step_windows(spark, d):
    got = features.step_response_counts(spikes(spark, d).where("unit_key IS NOT NULL"), ["unit_key"], "t", 60.0, 120.0, 10.0)
    return got.select("unit_key", *[R(c).alias(c) for c in ("base_rate", "on_rate", "on_late_rate", "off_rate", "on_latency")], "is_on", "is_off", R("on_off_index").alias("on_off_index"))


# -- ordered sequences -----------------------------------------------------------------------------------------------


@query(f"""WITH {_SP}, c AS (SELECT recording_no, CAST(floor(t / 10) AS BIGINT) AS bin_no, count(*) AS n FROM sp GROUP BY ALL),
x AS (SELECT *, lag(n) OVER (PARTITION BY recording_no ORDER BY bin_no) AS a, lead(n) OVER (PARTITION BY recording_no ORDER BY bin_no) AS b FROM c) SELECT recording_no, bin_no, n FROM x WHERE n >= 20 AND n > a AND n >= b""")
def peak_detect(spark, d):
    c = spikes(spark, d).groupBy("recording_no", F.floor(F.col("t") / 10).cast("long").alias("bin_no")).agg(F.count("*").alias("n"))
    return ordered.local_peaks(c, ["recording_no"], "bin_no", "n", 20, 30.0).select("recording_no", "bin_no", "n")


@query(f"""WITH {_LEN}, r AS (SELECT DISTINCT recording_no, chip, CAST(round_even(dur * 60, 0) AS BIGINT) AS length FROM (SELECT DISTINCT recording_no, chip FROM recordings WHERE chip IS NOT NULL) JOIN len USING (recording_no)),
o AS (SELECT *, CAST(coalesce(sum(length + 361) OVER (PARTITION BY chip ORDER BY recording_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT chip, recording_no, "offset", "offset" + 120 AS start_frame, "offset" + 301 + length AS end_frame FROM o""")
def section_running_offset(spark, d):
    r = table(spark, d, "recordings").select("recording_no", "chip").where("chip IS NOT NULL").distinct().join(lengths(spark, d), "recording_no").withColumn("length", F.bround(F.col("dur") * 60).cast("long"))
    return timeline.section_frames(r, ["chip"], "recording_no", "length").select("chip", "recording_no", "offset", "start_frame", "end_frame")


@query(f"""WITH {_LEN} SELECT recording_no, i AS trial_idx, 60 + 240 + i * 600 + CAST(floor(i / 3) AS BIGINT) * 180 AS trial_start FROM (SELECT recording_no, unnest(range(9)) AS i FROM len)""")
def trial_boundaries(spark, d):
    s = lengths(spark, d).withColumn("start_frame", F.lit(0))
    t = timeline.trials(s, "start_frame", F.lit(3), F.lit(600), F.lit(240), F.lit(3), F.lit(180))
    return t.select("recording_no", F.col("trial_idx").cast("long").alias("trial_idx"), F.col("trial_start").cast("long").alias("trial_start"))


@query(f"""WITH {_SP}, x AS (SELECT unit_key, t, CASE WHEN t - lag(t) OVER (PARTITION BY unit_key ORDER BY t) > 5 THEN 1 ELSE 0 END AS nw FROM sp WHERE unit_key IS NOT NULL),
y AS (SELECT unit_key, t, sum(nw) OVER (PARTITION BY unit_key ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM x), z AS (SELECT unit_key, g, min(t) AS a, max(t) AS b, count(*) AS n FROM y GROUP BY ALL)
SELECT unit_key, round(arg_max(a, (n, -a)), 6) AS run_start, round(arg_max(b, (n, -a)), 6) AS run_end, max(n) AS n_rows FROM z GROUP BY 1""")
def gaps_islands_longest(spark, d):
    got = ordered.longest_run(spikes(spark, d).where("unit_key IS NOT NULL"), ["unit_key"], "t", 5.0, 60.0)
    return got.select("unit_key", R("run_start").alias("run_start"), R("run_end").alias("run_end"), "n_rows")


@query(f"""WITH {_RD}, b AS (SELECT course_key, CAST(floor(t / 5) AS BIGINT) AS k, avg(r) * 100 AS bic FROM rd GROUP BY ALL), l AS (SELECT *, -0.5 * (lead(bic) OVER (PARTITION BY course_key ORDER BY k) - bic) AS lbf FROM b)
SELECT course_key, coalesce(min(k) FILTER (lbf < 6), arg_min(k, (bic, k))) AS k FROM l GROUP BY 1""")
def bayes_factor_first_k(spark, d):
    b = readings(spark, d).groupBy("course_key", F.floor(F.col("t") / 5).cast("long").alias("k")).agg((F.avg("r") * 100).alias("bic"))
    return population.log_bayes_choice(b, ["course_key"], "k", "bic")


@query(f"""WITH {_RD}, o AS (SELECT reading_id, course_key, t, sum(r) OVER (PARTITION BY course_key ORDER BY t, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s,
lag(r) OVER (PARTITION BY course_key ORDER BY t, reading_id) AS p FROM rd) SELECT reading_id, round(coalesce(s, 0), 4) AS running, p AS previous FROM o""")
def running_previous(spark, d):
    r = readings(spark, d)
    b = F.floor(F.col("t") / 10)
    with_sum = ordered.running_sum(r, ["course_key"], ["t", "reading_id"], b, F.col("r"), "running")
    return ordered.with_previous(with_sum, ["course_key"], ["t", "reading_id"], b, F.col("r"), "previous").select("reading_id", R("running", 4).alias("running"), "previous")


# -- population ------------------------------------------------------------------------------------------------------


@query(f"""WITH {_CELL}, x AS (SELECT unit_key, dataset_id, ds_p_value AS p, count(*) OVER (PARTITION BY dataset_id) AS n, count(*) OVER (PARTITION BY dataset_id ORDER BY ds_p_value RANGE UNBOUNDED PRECEDING) AS k FROM ce WHERE ds_p_value IS NOT NULL)
SELECT unit_key, round(least(1, min(p * n / k) OVER (PARTITION BY dataset_id ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 10) AS p_adjusted FROM x""")
def bh_fdr(spark, d):
    return population.fdr_adjusted(one_cell_each(spark, d), ["dataset_id"], "ds_p_value").select("unit_key", R("p_adjusted", 10).alias("p_adjusted"))


@query(f"""WITH {_CELL}, g AS (SELECT dataset_id, count(*) AS n, count(*) FILTER (iprgc_2hz_QI > 0.8) AS k FROM ce GROUP BY 1), f AS (SELECT *, k / n AS fr, (k / n) / ((SELECT sum(k) FROM g) / (SELECT sum(n) FROM g)) AS en FROM g)
SELECT dataset_id, n, k AS n_positive, round(fr, 6) AS fraction, round(en, 6) AS enrichment, round(greatest(fr, 1 - fr), 6) AS purity, row_number() OVER (ORDER BY en DESC, dataset_id) AS rank FROM f QUALIFY rank <= 3""")
def topk_enrichment(spark, d):
    got = population.enrichment(one_cell_each(spark, d), "dataset_id", F.coalesce(F.col("iprgc_2hz_QI") > 0.8, F.lit(False)))
    return got.select("dataset_id", "n", "n_positive", R("fraction").alias("fraction"), R("enrichment").alias("enrichment"), R("purity").alias("purity"), "rank")


@query(f"""WITH {_CELL}, c AS (SELECT dataset_id, axon_type, count(*) AS k FROM ce WHERE axon_type IS NOT NULL GROUP BY ALL), t AS (SELECT dataset_id, CAST(sum(k) AS BIGINT) AS n, arg_max(axon_type, k) AS x, max(k) AS top FROM c GROUP BY 1)
SELECT t.dataset_id, n, min(c.axon_type) AS top_label, round(any_value(top) / any_value(n), 6) AS purity FROM t JOIN c ON c.dataset_id = t.dataset_id AND c.k = t.top GROUP BY ALL""")
def cluster_purity(spark, d):
    got = population.purity(one_cell_each(spark, d).where("axon_type IS NOT NULL"), "dataset_id", "axon_type")
    return got.select("dataset_id", "n", "top_label", R("purity").alias("purity"))


@query(f"""WITH {_CELL} SELECT axon_type, count(dsi) AS n, round(median(dsi), 6) AS median_area, round(median(dsi) * count(dsi) / 300, 4) AS coverage, median(dsi) * count(dsi) / 300 > 0.8 AS covered FROM ce GROUP BY 1""")
def subtype_coverage(spark, d):
    got = population.coverage(one_cell_each(spark, d), ["axon_type"], "dsi", 300.0)
    return got.select("axon_type", "n", R("median_area").alias("median_area"), R("coverage", 4).alias("coverage"), "covered")


@query(f"""WITH {_RD}, e AS (SELECT chip, course_key, CAST(floor(t / 3) AS BIGINT) AS bin_no, avg(r) AS m FROM rd GROUP BY ALL)
SELECT chip, bin_no, count(m) AS n_units, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS sem FROM e GROUP BY ALL""")
def binned_mean_sem(spark, d):
    got = population.binned_course(readings(spark, d), ["chip"], "course_key", "t", "r", 3.0)
    return got.select("chip", "bin_no", "n_units", R("mean").alias("mean"), R("sem").alias("sem"))


@query(f"""WITH {_RD}, f AS (SELECT course_key, avg(r) AS m FROM (SELECT *, row_number() OVER (PARTITION BY course_key ORDER BY t, reading_id) AS i FROM rd) WHERE i <= 5 GROUP BY 1)
SELECT reading_id, round(CASE WHEN m <> 0 THEN r / m END, 6) AS normalized FROM rd JOIN f USING (course_key)""")
def normalize_first_n(spark, d):
    return population.normalized_to_first(readings(spark, d), ["course_key"], ["t", "reading_id"], "r", 5).select("reading_id", R("normalized").alias("normalized"))


@query(f"""WITH {_RD}, e AS (SELECT chip, course_key, avg(r) FILTER (t >= 20 AND t < 30) AS a, avg(r) FILTER (t >= 30 AND t < 40) AS b FROM rd GROUP BY ALL)
SELECT chip, count(*) AS n_units, round(avg(100.0 * (b - a) / a), 5) AS mean_effect, round(stddev_samp(100.0 * (b - a) / a), 5) AS sd_effect FROM e WHERE a > 0 AND b IS NOT NULL GROUP BY 1""")
def treatment_effect(spark, d):
    got = population.treatment_effect(readings(spark, d), ["chip"], "course_key", "t", "r", 30.0, 10.0)
    return got.select("chip", "n_units", R("mean_effect", 5).alias("mean_effect"), R("sd_effect", 5).alias("sd_effect"))


@query(f"""WITH {_CELL}, g AS (SELECT *, CASE WHEN iprgc_2hz_QI > 0.8 THEN 'ipRGC' WHEN ds_p_value < 0.05 THEN 'DS' WHEN osi > 0.5 THEN 'OS' ELSE 'Other' END AS kind FROM ce)
SELECT kind, count(*) AS n, round(avg(dsi), 6) AS mean_dsi FROM g GROUP BY 1""")
def group_case_priority(spark, d):
    kind = population.priority_group([("ipRGC", F.col("iprgc_2hz_QI") > 0.8), ("DS", F.col("ds_p_value") < 0.05), ("OS", F.col("osi") > 0.5)])
    return one_cell_each(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), R(F.avg("dsi")).alias("mean_dsi"))


@query(f"""WITH {_CELL} SELECT coalesce(CASE WHEN NOT coalesce(axon_type = 'rgc', false) THEN 'axon' WHEN NOT coalesce(ds_p_value IS NOT NULL, false) THEN 'p' WHEN NOT coalesce(step_up_QI >= 0.5, false) THEN 'quality' END, 'kept') AS reason, count(*) AS n FROM ce GROUP BY 1""")
def filter_funnel(spark, d):
    c = one_cell_each(spark, d)
    _, reason = population.funnel(c, [("axon", F.col("axon_type") == "rgc"), ("p", F.col("ds_p_value").isNotNull()), ("quality", F.col("step_up_QI") >= 0.5)])
    return c.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {_CELL} SELECT dataset_id, count(*) FILTER (axon_type = 'rgc') AS n_rgc, count(*) FILTER (axon_type = 'ac') AS n_ac, round(100.0 * count(*) FILTER (axon_type = 'rgc') / nullif(count(*) FILTER (axon_type IN ('rgc', 'ac')), 0), 6) AS pct_rgc,
round(100.0 * count(*) FILTER (axon_type = 'ac') / nullif(count(*) FILTER (axon_type IN ('rgc', 'ac')), 0), 6) AS pct_ac FROM ce GROUP BY 1""")
def crosstab_pct(spark, d):
    got = population.crosstab(one_cell_each(spark, d), "dataset_id", "axon_type", ["rgc", "ac"])
    return got.select("dataset_id", "n_rgc", "n_ac", R("pct_rgc").alias("pct_rgc"), R("pct_ac").alias("pct_ac"))


@query(f"""WITH {_CELL} SELECT coalesce(iprgc_2hz_QI > 0.8, false) AS iprgc, coalesce(ds_p_value < 0.05, false) AS ds, coalesce(osi > 0.5, false) AS os, count(*) AS n FROM ce GROUP BY ALL""")
def membership_combinations(spark, d):
    flags = {"iprgc": F.col("iprgc_2hz_QI") > 0.8, "ds": F.col("ds_p_value") < 0.05, "os": F.col("osi") > 0.5}
    return population.memberships(one_cell_each(spark, d), [], flags)


@query(f"""WITH {_CELL}, x AS (SELECT *, try_strptime(substr(dataset_id, 1, 10), '%Y.%m.%d') AS day FROM ce), m AS (SELECT day, avg(step_up_QI) AS m, count(*) AS k FROM x WHERE day IS NOT NULL GROUP BY 1)
SELECT strftime(day, '%Y-%m') AS month, round(avg(m), 6) AS mean, CAST(sum(k) AS BIGINT) AS n FROM m GROUP BY 1""")
def rollup_day_month(spark, d):
    day = F.try_to_timestamp(F.substring("dataset_id", 1, 10), F.lit("yyyy.MM.dd"))
    c = one_cell_each(spark, d).withColumn("day", day).where("day IS NOT NULL").withColumn("month", F.date_format("day", "yyyy-MM"))
    return population.two_level(c, ["month"], ["day"], "step_up_QI").select("month", R("mean").alias("mean"), "n")


@query(f"""WITH {_CELL}, a AS (SELECT dataset_id, count(dsi) FILTER (axon_type = 'rgc') AS na, count(dsi) FILTER (axon_type <> 'rgc') AS nb, avg(dsi) FILTER (axon_type = 'rgc') AS ma, avg(dsi) FILTER (axon_type <> 'rgc') AS mb,
var_samp(dsi) FILTER (axon_type = 'rgc') AS va, var_samp(dsi) FILTER (axon_type <> 'rgc') AS vb FROM ce WHERE axon_type IS NOT NULL GROUP BY 1)
SELECT dataset_id, na AS n_a, nb AS n_b, round(CASE WHEN na > 1 AND nb > 1 AND va / na + vb / nb > 0 THEN (ma - mb) / sqrt(va / na + vb / nb) END, 5) AS t,
round(CASE WHEN na > 1 AND nb > 1 AND va / na + vb / nb > 0 THEN (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) END, 5) AS df,
round(CASE WHEN na > 1 AND nb > 1 AND va / na + vb / nb > 0 THEN (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) END, 5) AS cohen_d FROM a""")
def welch_effect(spark, d):
    got = population.welch(one_cell_each(spark, d), ["dataset_id"], F.col("axon_type") == "rgc", "dsi")
    return got.select("dataset_id", "n_a", "n_b", R("t", 5).alias("t"), R("df", 5).alias("df"), R("cohen_d", 5).alias("cohen_d"))


@query(f"""WITH {_CELL} SELECT axon_type, count(*) FILTER (step_up_QI > 0 AND step_up_QI <= 0.25) AS n_0, count(*) FILTER (step_up_QI > 0.25 AND step_up_QI <= 0.5) AS n_1,
count(*) FILTER (step_up_QI > 0.5 AND step_up_QI <= 0.75) AS n_2, count(*) FILTER (step_up_QI > 0.75 AND step_up_QI <= 1) AS n_3 FROM ce GROUP BY 1""")
def bucket_counts(spark, d):
    return population.bucketed_counts(one_cell_each(spark, d), "step_up_QI", [0.0, 0.25, 0.5, 0.75, 1.0], ["axon_type"])


@query(f"""WITH {_CELL} SELECT unit_key, dsi FROM ce WHERE dsi IS NOT NULL AND dsi >= (SELECT quantile_cont(dsi, 0.4) FROM ce) ORDER BY dsi DESC, unit_key LIMIT 50""")
def quantile_top(spark, d):
    c = one_cell_each(spark, d).where("dsi IS NOT NULL").select("unit_key", "dsi")
    least = c.agg(F.percentile("dsi", 0.4).alias("q"))
    return c.join(F.broadcast(least), F.col("dsi") >= F.col("q")).orderBy(F.desc("dsi"), "unit_key").limit(50).select("unit_key", "dsi")  # one row


@query("""WITH d AS (SELECT dataset_id, date_trunc('day', min(loaded_at)) AS x, count(*) AS n FROM recordings WHERE dataset_id IS NOT NULL GROUP BY 1), o AS (SELECT * FROM recordings WHERE stage1_completed),
f AS (SELECT dataset_id, arg_min(params_hash, loaded_at) AS h FROM o GROUP BY 1) SELECT coalesce(f.dataset_id, d.dataset_id) AS dataset_id, f.dataset_id IS NULL AS is_new FROM f FULL JOIN d ON f.dataset_id = d.dataset_id""")
def union_incremental_dedup(spark, d):
    r = table(spark, d, "recordings").where("dataset_id IS NOT NULL")
    old = r.where("stage1_completed").select("dataset_id").distinct().withColumn("is_new", F.lit(False))
    return population.add_missing_first(old, r.select("dataset_id").withColumn("is_new", F.lit(True)), ["dataset_id"]).select("dataset_id", "is_new")


# -- names -----------------------------------------------------------------------------------------------------------


@query(f"""SELECT link_id, {_RECKEY("ref_file")} AS rec, replace({_RECKEY("ref_file")}, '-', '.') || '.cmcr' AS sheet, strftime(strptime(substr({_RECKEY("ref_file")}, 1, 19), '%Y.%m.%d-%H.%M.%S'), '%Y-%m-%d %H:%M:%S') AS started,
CAST(regexp_extract(ref_unit, '(\\d+)', 1) AS BIGINT) AS unit_no FROM chain_links WHERE ref_file IS NOT NULL""")
def parse_keys(spark, d):
    f = F.col("ref_file")
    li = table(spark, d, "chain_links").where("ref_file IS NOT NULL")
    return li.select("link_id", recording_key(f).alias("rec"), N.sheet_name(f).alias("sheet"), F.date_format(N.started_at(f), "yyyy-MM-dd HH:mm:ss").alias("started"), unit_number("ref_unit").alias("unit_no"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query(f"""WITH {_UNIT} SELECT dataset_id || '_' || unit_id AS idx, substr(sha256(dataset_id || '_' || unit_id), 1, 16) AS h, dataset_id AS dataset, CAST(regexp_extract(unit_id, '(\\d+)', 1) AS VARCHAR) AS unit_part, dataset_id || '_unit' AS batch FROM un""")
def index_parts(spark, d):
    u = one_unit_each(spark, d).select(F.concat_ws("_", "dataset_id", "unit_id").alias("idx"))
    ds, n = N.split_index(F.col("idx"))
    return u.select("idx", N.short_hash(F.col("idx")).alias("h"), ds.alias("dataset"), n.alias("unit_part"), N.batch_of(F.col("idx")).alias("batch"))


# -- arrays ----------------------------------------------------------------------------------------------------------


_W = f"{_UNIT}, wv AS (SELECT unit_key, list_transform(waveform, lambda x: CAST(x AS DOUBLE)) AS w FROM un WHERE waveform IS NOT NULL AND len(waveform) > 0)"


def waves(spark, d):
    return one_unit_each(spark, d).where("waveform IS NOT NULL AND size(waveform) > 0").select("unit_key", F.col("waveform").cast("array<double>").alias("w"))


@query(f"WITH {_UNIT} SELECT unit_key, waveform IS NULL OR coalesce(len(list_filter(waveform, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0, true) AS bad FROM un")
def nan_trace_filter(spark, d):
    return one_unit_each(spark, d).select("unit_key", A.has_bad(F.col("waveform")).alias("bad"))


@query(f"WITH {_W} SELECT unit_key, list_transform(w, lambda x: round((x - list_avg(w)) / list_stddev_pop(w), 5) + 0.0) AS z FROM wv")
def trace_zscore(spark, d):
    return waves(spark, d).select("unit_key", F.transform(A.zscore(F.col("w")), lambda x: R(x, 5) + F.lit(0.0)).alias("z"))


@query(f"WITH {_W}, m AS (SELECT unit_key, w, list_max(list_transform(w, lambda x: abs(x))) AS m FROM wv) SELECT unit_key, round(m, 6) AS top, list_transform(w, lambda x: round(x / (m + 1e-8), 5)) AS scaled FROM m")
def trace_maxabs(spark, d):
    return waves(spark, d).select("unit_key", R(A.max_abs(F.col("w"))).alias("top"), F.transform(A.by_max_abs(F.col("w")), lambda x: R(x, 5)).alias("scaled"))


@query(f"WITH {_W} SELECT unit_key, list_transform(range(CAST(floor(len(w) / 8) AS BIGINT)), lambda i: round(list_sum(w[i * 8 + 1 : i * 8 + 8]) / 8 + 1e-9, 5) + 0.0) AS blocks FROM wv")
def trace_block_mean(spark, d):
    return waves(spark, d).select("unit_key", F.transform(A.block_mean(F.col("w"), 8), lambda x: R(x + 1e-9, 5) + F.lit(0.0)).alias("blocks"))


@query(f"""WITH {_W} SELECT unit_key, round(list_avg(w[1:10]), 6) + 0.0 AS base, round(CASE WHEN abs(list_min(w[11:30])) > abs(list_max(w[11:30])) THEN list_min(w[11:30]) ELSE list_max(w[11:30]) END, 6) + 0.0 AS extreme,
CAST(list_position(w, list_min(w)) - 1 AS BIGINT) AS trough, round(list_median(w[1:10]), 6) + 0.0 AS base_median FROM wv""")
def trace_slice_features(spark, d):
    w = F.col("w")
    return waves(spark, d).select("unit_key", (R(A.mean(A.window(w, 0, 10))) + F.lit(0.0)).alias("base"), (R(A.extreme(A.window(w, 10, 30))) + F.lit(0.0)).alias("extreme"), A.argmin(w).alias("trough"), (R(A.median_first(w, 10)) + F.lit(0.0)).alias("base_median"))


@query(f"""WITH {_W}, a AS (SELECT unit_key, w, list_position(w, list_min(w)) AS lo FROM wv), b AS (SELECT *, lo + list_position(w[lo:], list_max(w[lo:])) - 1 AS hi FROM a)
SELECT unit_key, CAST(lo - 1 AS BIGINT) AS trough, CAST(hi - 1 AS BIGINT) AS peak, round((hi - lo) * 1000.0 / 20000.0, 6) AS width_ms, round(w[hi] - w[lo], 6) AS amplitude FROM b""")
def waveform_shape(spark, d):
    f = waves(spark, d).select("unit_key", features.waveform_features(F.col("w")).alias("f"))
    return f.select("unit_key", F.col("f.trough").cast("long").alias("trough"), F.col("f.peak").cast("long").alias("peak"), R("f.width_ms").alias("width_ms"), R("f.amplitude").alias("amplitude"))


@query(f"""WITH {_W} SELECT unit_key, round(list_avg(w), 6) AS w_mean, round(list_stddev_pop(w), 6) AS w_std, round(list_min(w), 6) AS w_min, round(list_max(w), 6) AS w_max FROM wv""")
def flatten_long_wide(spark, d):
    f = flat(waves(spark, d), ["unit_key"])
    return f.select("unit_key", *[R(f"w_{s}").alias(f"w_{s}") for s in ("mean", "std", "min", "max")])


# -- directions and geometry -----------------------------------------------------------------------------------------


def direction_rates(spark, d):
    k = F.pmod(F.floor(F.col("t") / 10), F.lit(8))
    s = spikes(spark, d).where("unit_key IS NOT NULL")
    return s.groupBy("unit_key").agg(*[F.count_if(k == i).cast("double").alias(f"r{i}") for i in range(8)])


_DIR = f"""{_SP}, dr AS (SELECT unit_key, {", ".join(f"count(*) FILTER (CAST(floor(t / 10) AS BIGINT) % 8 = {i}) AS r{i}" for i in range(8))} FROM sp WHERE unit_key IS NOT NULL GROUP BY 1)"""
_SUMS = ", ".join(f"{' + '.join(f'r{i} * {f}({h} * 2 * pi() * {i} / 8)' for i in range(8))} AS {n}" for h, f, n in ((1, "cos", "x1"), (1, "sin", "y1"), (2, "cos", "x2"), (2, "sin", "y2")))


@query(f"""WITH {_DIR}, v AS (SELECT *, {_SUMS}, greatest({", ".join(f"r{i}" for i in range(8))}) AS top, {" + ".join(f"r{i}" for i in range(8))} AS total FROM dr)
SELECT unit_key, round(CASE WHEN top > 0 THEN sqrt(x1 * x1 + y1 * y1) / top ELSE 0 END, 5) AS dsi, round(CASE WHEN total > 0 THEN sqrt(x2 * x2 + y2 * y2) / total ELSE 0 END, 5) AS osi,
CASE WHEN sqrt(x1 * x1 + y1 * y1) > 1e-6 THEN round(((degrees(atan2(y1, x1)) % 360) + 360) % 360, 3) END AS preferred FROM v""")
def direction_orientation_index(spark, d):
    r = [F.col(f"r{i}") for i in range(8)]
    dsi, angle = G.direction_index(r)
    x, y = G.vector_sum(r, 1)
    return direction_rates(spark, d).select("unit_key", R(dsi, 5).alias("dsi"), R(G.orientation_index(r), 5).alias("osi"), F.when(F.sqrt(x * x + y * y) > 1e-6, R(angle, 3)).alias("preferred"))


@query(f"""WITH {_CELL}, s AS (SELECT dataset_id, sum(dsi * sin(radians(preferred_direction))) AS y, sum(dsi * cos(radians(preferred_direction))) AS x FROM ce WHERE dsi IS NOT NULL AND preferred_direction IS NOT NULL GROUP BY 1)
SELECT dataset_id, round(((degrees(atan2(y, x)) % 360) + 360) % 360, 4) AS direction FROM s""")
def circular_weighted_mean(spark, d):
    c = one_cell_each(spark, d).where("dsi IS NOT NULL AND preferred_direction IS NOT NULL")
    return c.groupBy("dataset_id").agg(R(G.circular_mean(F.col("preferred_direction"), F.col("dsi")), 4).alias("direction"))


_LINE = f"""{_UNIT}, li AS (SELECT dataset_id, count(*) AS n, regr_slope(CAST(col AS DOUBLE), CAST(row AS DOUBLE)) AS m, regr_intercept(CAST(col AS DOUBLE), CAST(row AS DOUBLE)) AS c, regr_r2(CAST(col AS DOUBLE), CAST(row AS DOUBLE)) AS r2 FROM un GROUP BY 1 HAVING count(*) >= 10)"""


def unit_lines(spark, d):
    return pathways.fitted_lines(one_unit_each(spark, d), ["dataset_id"], "row", "col")


@query(f"WITH {_LINE} SELECT dataset_id, n, round(m, 6) AS slope, round(c, 4) AS intercept, round(r2, 6) AS r2 FROM li")
def line_fits(spark, d):
    return unit_lines(spark, d).where("slope IS NOT NULL").select("dataset_id", "n", R("slope").alias("slope"), R("intercept", 4).alias("intercept"), R("r2").alias("r2"))


@query(f"""WITH {_LINE}, q AS (SELECT substr(dataset_id, 1, 10) AS day, m, c, r2 / (1 + m * m) AS q FROM li WHERE m IS NOT NULL AND r2 > 0),
s AS (SELECT day, count(*) AS n, sum(q * m * m) AS a, sum(-q * m) AS b, sum(q) AS d, sum(-q * m * c) AS e, sum(q * c) AS f FROM q GROUP BY 1)
SELECT day, n AS n_lines, CASE WHEN a * d - b * b > 1e-9 * a * d THEN round((d * e - b * f) / (a * d - b * b), 3) END AS x, CASE WHEN a * d - b * b > 1e-9 * a * d THEN round((a * f - b * e) / (a * d - b * b), 3) END AS y FROM s""")
def common_line_point(spark, d):
    li = unit_lines(spark, d).withColumn("day", F.substring("dataset_id", 1, 10))
    return pathways.common_point(li, ["day"], "slope", "intercept", "r2").select("day", "n_lines", R("x", 3).alias("x"), R("y", 3).alias("y"))


# -- averages and fits -----------------------------------------------------------------------------------------------


@query(f"""WITH {_EV}, s AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, user_id, event_type, value FROM events), p AS (SELECT user_id, i FROM s WHERE event_type = 'purchase' AND i >= 5)
SELECT p.user_id, o AS "offset", round(avg(s.value), 8) AS average, count(*) AS n_spikes FROM p, (SELECT unnest(range(-5, 1)) AS o) JOIN s ON s.i = p.i + o GROUP BY ALL""")
def sta_average(spark, d):
    e = table(spark, d, "events")
    # Frame numbers come from ranks inside hours and their totals, so no task orders the whole table.
    day = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    ranked = e.select("user_id", "event_type", "value", day.alias("day"), F.row_number().over(Window.partitionBy(day).orderBy("ts", "event_id")).alias("k"))
    days = ranked.groupBy("day").agg(F.max("k").alias("n"))
    days = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    s = ranked.join(days, "day").withColumn("i", F.col("before") + F.col("k") - 1)
    got = sta.spike_triggered_average(s.where("event_type = 'purchase'").select("user_id", F.col("i").alias("f")), s, "user_id", "f", "i", None, "value", -5, 0, 1 << 62)
    return got.select("user_id", F.col("offset").cast("long").alias("offset"), R("average", 8).alias("average"), "n_spikes")


@query(f"""WITH {_SP}, {_LEN}, s AS (SELECT sp.*, 6 * CAST(floor(dur / 60) AS BIGINT) AS bins FROM sp JOIN len USING (recording_no) WHERE unit_key IS NOT NULL AND floor(t / 10) < 6 * floor(dur / 60)),
c AS (SELECT unit_key, CAST(floor(t / 10) AS BIGINT) AS k, max(bins) AS bins, count(*) AS n FROM s GROUP BY ALL),
g AS (SELECT u.unit_key, u.k, u.bins, coalesce(n, 0) AS y, sin(2 * pi() * u.k / 6) AS s, cos(2 * pi() * u.k / 6) AS c FROM (SELECT unit_key, max(bins) AS bins, unnest(range(max(bins))) AS k FROM c GROUP BY unit_key) u LEFT JOIN c USING (unit_key, k)),
f AS (SELECT unit_key, 2 * sum(y * s) / max(bins) AS a, 2 * sum(y * c) / max(bins) AS b, avg(y) AS o FROM g GROUP BY 1) SELECT unit_key, round(sqrt(a * a + b * b), 5) AS amp, round(o, 5) AS "offset" FROM f""")
def sine_fit_closed_form(spark, d):
    """Over whole periods the sine, the cosine and the constant are orthogonal, so each weight is one sum and empty bins add nothing. Periods are the whole minutes of a recording."""
    bins = 6 * F.floor(F.col("dur") / 60)
    s = spikes(spark, d).where("unit_key IS NOT NULL").join(lengths(spark, d), "recording_no").where(F.floor(F.col("t") / 10) < bins)
    c = s.groupBy("unit_key", F.floor(F.col("t") / 10).alias("k")).agg(F.count("*").alias("n"), F.max(bins).alias("bins"))
    w = 2 * 3.141592653589793 * F.col("k") / 6
    a, b = 2 * F.sum(F.col("n") * F.sin(w)) / F.max("bins"), 2 * F.sum(F.col("n") * F.cos(w)) / F.max("bins")
    return c.groupBy("unit_key").agg(R(F.sqrt(a * a + b * b), 5).alias("amp"), R(F.sum("n") / F.max("bins"), 5).alias("offset"))


@query()
def udf_bessel_filter(spark, d):
    return waves(spark, d).select("unit_key", F.transform(lowpass(F.col("w"), 2000.0, 20000.0), lambda x: R(x, 4)).alias("filtered"))


@query()
def udf_peaks_prominence(spark, d):
    return waves(spark, d).select("unit_key", peak_positions(F.col("w"), prominence=2.0).alias("peaks"))


@query()
def mixture_kinds(spark, d):
    """A diagonal mixture over standardised indices; the clusters and their sizes."""
    dims = ["dsi", "osi", "iprgc_2hz_QI"]
    c = clusters.standardized(one_cell_each(spark, d).dropna(subset=dims), dims)
    mix = clusters.fit_mixture(c, dims, 8)
    return clusters.assign(c, dims, mix).select("unit_key", "cluster", R("posterior", 4).alias("posterior"))


@query()
def kmeans_k(spark, d):
    dims = ["dsi", "osi", "iprgc_2hz_QI"]
    c = one_cell_each(spark, d).dropna(subset=dims)
    return clusters.kmeans(c, dims, 8).select("unit_key", F.col("cluster").cast("long").alias("cluster"))


@query()
def embedding_components(spark, d):
    e = table(spark, d, "embeddings")
    mean, comp, _ = clusters.principal_components(e, "embedding", 4)
    return e.select("vec_id", F.transform(clusters.project(F.col("embedding").cast("array<double>"), mean, comp), lambda x: R(x, 4)).alias("scores"))


_DIMS3 = ("dsi", "osi", "iprgc_2hz_QI")
_SIL = f"""{_CELL}, pt AS (SELECT unit_key, axon_type, dsi, osi, iprgc_2hz_QI AS q FROM ce WHERE dsi IS NOT NULL AND osi IS NOT NULL AND iprgc_2hz_QI IS NOT NULL AND axon_type IS NOT NULL),
cl AS (SELECT axon_type AS c, count(*) AS n, sum(dsi) AS x, sum(osi) AS y, sum(q) AS z, sum(dsi * dsi + osi * osi + q * q) AS qq FROM pt GROUP BY 1),
far AS (SELECT unit_key, axon_type, c, n, n * (dsi * dsi + osi * osi + q * q) + qq - 2 * (dsi * x + osi * y + q * z) AS total FROM pt CROSS JOIN cl),
ab AS (SELECT unit_key, axon_type, max(CASE WHEN c = axon_type AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN c <> axon_type THEN total / n END) AS b FROM far GROUP BY ALL)"""


@query(f"WITH {_SIL} SELECT axon_type, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 5) AS silhouette FROM ab GROUP BY 1")
def cluster_silhouette(spark, d):
    dims = ["dsi", "osi", "iprgc_2hz_QI"]
    return clusters.centre_silhouette(kmeans_input(spark, d), dims, "axon_type").select("axon_type", R("silhouette", 5).alias("silhouette"))


def kmeans_input(spark, d):
    return one_cell_each(spark, d).dropna(subset=["dsi", "osi", "iprgc_2hz_QI", "axon_type"])
