"""Queries of summaries, reports and streams over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spikeloom.functions import geometry as G
from spikeloom.functions.keys import usable
from spikeloom.operators import ordered, pathways, population, responses, timeline
from spikeloom.plans import core_queries as C
from spikeloom.plans.core_queries import _CELL, _LEN, _LINE, _MATCH, _RD, _SP, _TR, _UNIT, R, query_of
from spikeloom.session import cut, shared_dir, table
from spikeloom.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


query = query_of(QUERIES, SQL)


@query(f"""WITH {_SP}, {_LEN}, k AS (SELECT recording_no, floor(dur / 60) AS k FROM len WHERE dur >= 60)
SELECT unit_key, CAST(floor((t % 60) / 2) AS BIGINT) AS bin_no, count(*) AS n, round(count(*) / (any_value(k) * 2) , 6) AS rate FROM sp JOIN k USING (recording_no) WHERE unit_key IS NOT NULL AND t < k * 60 GROUP BY ALL""")
def psth_response(spark, d):
    k = C.lengths(spark, d).where("dur >= 60").select("recording_no", F.floor(F.col("dur") / 60).alias("k"))
    s = C.spikes(spark, d).join(k, "recording_no").where(F.col("unit_key").isNotNull() & (F.col("t") < F.col("k") * 60))
    s = s.withColumn("since", F.pmod(F.col("t"), F.lit(60.0)))
    got = responses.psth(s, ["unit_key", "k"], "k", "since", 2.0, F.col("k"))
    return got.select("unit_key", "bin_no", "n", R("rate").alias("rate"))


@query(f"""WITH {_CELL}, x AS (SELECT dataset_id, axon_type = 'rgc' AS g, step_up_QI AS v FROM ce WHERE axon_type IS NOT NULL AND step_up_QI IS NOT NULL),
p AS (SELECT dataset_id, v, count(*) AS n, count(*) FILTER (g) AS a FROM x GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY dataset_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM p),
s AS (SELECT dataset_id, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(n) - sum(a) AS DOUBLE) AS b, sum(a * rk) AS r, sum(n * n * n - n) AS t FROM r GROUP BY 1)
SELECT dataset_id, CAST(a AS BIGINT) AS n_a, CAST(b AS BIGINT) AS n_b, CASE WHEN a > 0 AND b > 0 THEN round(r - a * (a + 1) / 2, 2) END AS u,
CASE WHEN a > 0 AND b > 0 THEN round((r - a * (a + 1) / 2 - a * b / 2) / sqrt(a * b / 12 * ((a + b + 1) - t / ((a + b) * (a + b - 1)))), 5) END AS z FROM s""")
def rank_sum_quality(spark, d):
    got = responses.rank_sum(C.one_cell_each(spark, d), ["dataset_id"], F.col("axon_type") == "rgc", "step_up_QI")
    return got.select("dataset_id", "n_a", "n_b", R("u", 2).alias("u"), R("z", 5).alias("z"))


@query(f"""WITH {_RD}, e AS (SELECT chip, course_key, avg(r) FILTER (t >= 20 AND t < 30) AS a, avg(r) FILTER (t >= 30 AND t < 40) AS b FROM rd GROUP BY ALL)
SELECT chip, count(*) AS n, round(avg(b - a), 6) AS mean_difference, round(CASE WHEN count(*) > 1 AND stddev_samp(b - a) > 0 THEN avg(b - a) / (stddev_samp(b - a) / sqrt(count(*))) END, 5) AS t FROM e WHERE b - a IS NOT NULL GROUP BY 1""")
def paired_effect(spark, d):
    r, t = C.readings(spark, d), F.col("t")
    e = r.groupBy("chip", "course_key").agg(F.avg(F.when((t >= 20) & (t < 30), F.col("r"))).alias("a"), F.avg(F.when((t >= 30) & (t < 40), F.col("r"))).alias("b"))
    return responses.paired_t(e, ["chip"], "a", "b").select("chip", "n", R("mean_difference").alias("mean_difference"), R("t", 5).alias("t"))


_D3 = ("dsi", "osi", "iprgc_2hz_QI")


@query(f"""WITH {_CELL}, x AS (SELECT axon_type AS c, dsi AS a, osi AS b, iprgc_2hz_QI AS e FROM ce WHERE axon_type IS NOT NULL AND dsi IS NOT NULL AND osi IS NOT NULL AND iprgc_2hz_QI IS NOT NULL),
m AS (SELECT c, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(e) AS me FROM x GROUP BY 1), g AS (SELECT avg(a) AS ga, avg(b) AS gb, avg(e) AS ge FROM x),
s AS (SELECT c, avg(sqrt((a - ma) ** 2 + (b - mb) ** 2 + (e - me) ** 2)) AS s, sum((a - ma) ** 2 + (b - mb) ** 2 + (e - me) ** 2) AS w FROM x JOIN m USING (c) GROUP BY 1),
o AS (SELECT * FROM m JOIN s USING (c)), h AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS k, sum(n * ((ma - ga) ** 2 + (mb - gb) ** 2 + (me - ge) ** 2)) AS bt, sum(w) AS w FROM o, g),
r AS (SELECT p.c, max((p.s + q.s) / sqrt((p.ma - q.ma) ** 2 + (p.mb - q.mb) ** 2 + (p.me - q.me) ** 2)) AS r FROM o p JOIN o q ON p.c <> q.c GROUP BY 1)
SELECT n, k, round((bt / (k - 1)) / (w / (n - k)), 5) AS calinski_harabasz, (SELECT round(avg(r), 4) FROM r) AS davies_bouldin FROM h""")
def cluster_indices(spark, d):
    got = responses.cluster_indices(C.one_cell_each(spark, d), list(_D3), "axon_type")
    return got.select("n", "k", R("calinski_harabasz", 5).alias("calinski_harabasz"), R("davies_bouldin", 4).alias("davies_bouldin"))


@query(f"""WITH {_CELL}, v AS (SELECT axon_type, list_reverse(quantile_cont(dsi, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS v FROM ce WHERE dsi IS NOT NULL GROUP BY 1)
SELECT axon_type, CAST(i AS BIGINT) AS point, round(v[i + 1] + 1e-8, 6) AS value FROM v, (SELECT unnest(range(11)) AS i)""")
def falling_curves(spark, d):
    got = responses.falling_curves(C.one_cell_each(spark, d), "axon_type", "dsi")
    return got.select("axon_type", F.col("point").cast("long").alias("point"), R(F.col("value") + 1e-8).alias("value"))


_MISS = ("dsi", "osi", "preferred_direction", "ds_p_value", "step_up_QI", "iprgc_2hz_QI", "iprgc_20hz_QI")


@query("WITH " + "l AS (" + " UNION ALL ".join(f"SELECT dataset_id, '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = 'nan') AS n_missing FROM cells GROUP BY 1" for c in _MISS) + ") SELECT dataset_id, \"column\", n_missing, round(100.0 * n_missing / n, 5) AS percent FROM l")
def missing_report(spark, d):
    got = responses.missing_report(table(spark, d, "cells"), ["dataset_id"], list(_MISS))
    return got.select("dataset_id", "column", "n_missing", R("percent", 5).alias("percent"))


_THR, _EDGE = [0.2, 0.4, 0.6, 0.8], [-1, 0, 5, 10, 20, 1000]


@query(f"""WITH {_CELL}, k AS (SELECT dataset_id, th, count(*) FILTER (step_up_QI >= th) AS k FROM ce, (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS th) GROUP BY ALL),
b AS (SELECT unnest([0, 1, 2, 3, 4]) AS bucket, unnest([-1, 0, 5, 10, 20]) AS lo, unnest([0, 5, 10, 20, 1000]) AS hi)
SELECT CAST(th AS DOUBLE) AS threshold, CAST(bucket AS BIGINT) AS bucket, count(*) FILTER (k > lo AND k <= hi) AS n_groups FROM k, b GROUP BY ALL""")
def threshold_grid(spark, d):
    return responses.threshold_grid(C.one_cell_each(spark, d), ["dataset_id"], "step_up_QI", _THR, _EDGE)


@query(f"""WITH {_MATCH}, ch AS (SELECT m0.a AS n0, m0.b AS n1, m1.b AS n2 FROM mt m0 LEFT JOIN mt m1 ON m1.a = m0.b WHERE NOT EXISTS (SELECT 1 FROM mt m3 WHERE m3.b = m0.a))
SELECT n0, n1, n2, coalesce(x.rate, 0) AS v0, coalesce(y.rate, 0) AS v1, coalesce(z.rate, 0) AS v2 FROM ch LEFT JOIN un x ON x.unit_key = n0 LEFT JOIN un y ON y.unit_key = n1 LEFT JOIN un z ON z.unit_key = n2""")
def chain_zero_fill(spark, d):
    from spikeloom.operators.joins import left_chain

    m = C.matched_units(spark, d).select("a", "b")
    heads = m.join(m.select(F.col("b").alias("a")), "a", "left_anti")
    return responses.zero_filled(left_chain(heads, [heads, m], "a"), C.one_unit_each(spark, d), "unit_key", "rate", 2)


@query(f"""WITH {_SP}, {_LEN}, {_TR}, j AS (SELECT sp.recording_no, trial_idx FROM sp JOIN tr ON sp.recording_no = tr.recording_no AND t >= s AND t < e)
SELECT recording_no, {", ".join(f"count(*) FILTER (trial_idx = {i}) AS trial_{i}" for i in range(10))}, count(*) FILTER (trial_idx >= 10) AS later FROM j GROUP BY 1""")
def pivot_trials(spark, d):
    j = timeline.section_events(C.spikes(spark, d), C.trial_spans(spark, d), ["recording_no"], "t", "s", "e", 0.0, 0.0, 30.0)
    # A column per trial of the usual length, and one for those of longer recordings.
    wide = j.withColumn("slot", F.least("trial_idx", F.lit(10))).groupBy("recording_no").pivot("slot", list(range(11))).count().na.fill(0)
    return wide.select("recording_no", *[F.col(str(i)).alias(f"trial_{i}") for i in range(10)], F.col("10").alias("later"))


@query("""SELECT chip, count(*) AS n_rows, count(DISTINCT dataset_id) AS n_recordings, coalesce(bool_and(stage1_completed), false) AS all_done, round(avg(duration_sec) FILTER (duration_sec > 0 AND CAST(duration_sec AS VARCHAR) <> 'nan'), 6) AS mean_duration,
arg_min(condition_name, (loaded_at, recording_no)) FILTER (condition_name IS NOT NULL AND loaded_at IS NOT NULL) AS first_condition FROM recordings GROUP BY 1""")
def chip_summary(spark, d):
    r = table(spark, d, "recordings")
    first = F.min_by("condition_name", F.when(F.col("condition_name").isNotNull() & F.col("loaded_at").isNotNull(), F.struct("loaded_at", "recording_no")))
    mean = F.avg(F.when(usable("duration_sec") & (F.col("duration_sec") > 0), F.col("duration_sec")))
    return r.groupBy("chip").agg(F.count("*").alias("n_rows"), F.count_distinct("dataset_id").alias("n_recordings"), F.coalesce(F.every("stage1_completed"), F.lit(False)).alias("all_done"), R(mean).alias("mean_duration"), first.alias("first_condition"))


@query(f"""WITH {_SP}, u AS (SELECT recording_no, unit_key, min(t) AS a, max(t) AS b FROM sp GROUP BY ALL) SELECT recording_no, count(*) AS n_units, min(a) AS first_of_first, max(a) AS last_of_first, min(b) AS first_of_last, max(b) AS last_of_last FROM u GROUP BY 1""")
def extremes_of_extremes(spark, d):
    u = C.spikes(spark, d).groupBy("recording_no", "unit_key").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return u.groupBy("recording_no").agg(F.count("*").alias("n_units"), F.min("a").alias("first_of_first"), F.max("a").alias("last_of_first"), F.min("b").alias("first_of_last"), F.max("b").alias("last_of_last"))


@query("SELECT condition_name, genotype, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rank FROM recordings GROUP BY ALL")
def value_counts(spark, d):
    n = table(spark, d, "recordings").groupBy("condition_name", "genotype").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.rank().over(Window.orderBy(F.desc("n"))).cast("long"))  # over distinct values


@query(f"""WITH {_UNIT}, {_CELL} SELECT un.dataset_id, count(*) AS n_good, count(DISTINCT (un.row, un.col)) AS n_electrodes, round(count(DISTINCT (un.row, un.col)) / 4225.0, 8) AS area, round(count(*) / (count(DISTINCT (un.row, un.col)) / 4225.0 * 3000), 6) AS factor
FROM un JOIN ce ON un.unit_key = ce.unit_key WHERE step_up_QI > 0.5 GROUP BY 1""")
def effective_area(spark, d):
    u = C.one_unit_each(spark, d).select("unit_key", "dataset_id", "row", "col").join(C.one_cell_each(spark, d).where("step_up_QI > 0.5").select("unit_key"), "unit_key")
    per = u.groupBy("dataset_id", "row", "col").agg(F.count("*").alias("k")).groupBy("dataset_id").agg(F.sum("k").alias("n_good"), F.count("*").alias("n_electrodes"))
    area = F.col("n_electrodes") / 4225.0
    return per.select("dataset_id", "n_good", "n_electrodes", R(area, 8).alias("area"), R(F.col("n_good") / (area * 3000)).alias("factor"))


@query(f"""WITH {_CELL} SELECT lpad(CAST(CAST((round_even((preferred_direction + 30) / 45, 0) * 45) % 360 AS INT) AS VARCHAR), 3, '0') AS angle, count(*) AS n FROM ce WHERE preferred_direction IS NOT NULL GROUP BY 1""")
def corrected_angles(spark, d):
    c = C.one_cell_each(spark, d).where("preferred_direction IS NOT NULL")
    return c.groupBy(G.corrected_angle(F.col("preferred_direction"), F.lit(30.0)).alias("angle")).agg(F.count("*").alias("n"))


@query(f"""WITH {_CELL}, s AS (SELECT dataset_id, sum(osi * sin(radians(preferred_direction))) AS y, sum(osi * cos(radians(preferred_direction))) AS x FROM ce WHERE osi >= 0.5 AND preferred_direction IS NOT NULL GROUP BY 1),
c AS (SELECT dataset_id, ((degrees(atan2(y, x)) % 360) + 360) % 360 AS c FROM s WHERE abs(x) > 1e-12 OR abs(y) > 1e-12)
SELECT unit_key, round(c, 4) AS consensus, coalesce(least(abs(preferred_direction - c) % 360, 360 - abs(preferred_direction - c) % 360) <= 45, false) AS agrees FROM ce LEFT JOIN c USING (dataset_id)""")
def direction_consensus(spark, d):
    c = C.one_cell_each(spark, d)
    seen = c.withColumn("weight", F.when(F.col("preferred_direction").isNotNull(), F.col("osi")))
    return pathways.consensus_direction(seen, ["dataset_id"], "preferred_direction", "weight", 0.5).select("unit_key", R("consensus", 4).alias("consensus"), "agrees")


@query(f"""WITH {_UNIT} SELECT unit_key, round(sqrt((col - 110) ** 2 + (row - 110) ** 2), 6) AS radius, round(((degrees(atan2(row - 110, col - 110)) % 360) + 360) % 360, 5) AS angle,
CASE WHEN col >= 110 AND row >= 110 THEN 'Q1' WHEN col < 110 AND row >= 110 THEN 'Q2' WHEN col < 110 AND row < 110 THEN 'Q3' ELSE 'Q4' END AS quadrant, CASE WHEN row >= 110 THEN 'dorsal' ELSE 'ventral' END || '-' || CASE WHEN col >= 110 THEN 'nasal' ELSE 'temporal' END AS place FROM un""")
def unit_polar(spark, d):
    dx, dy = (F.col("col") - 110).cast("double"), (F.col("row") - 110).cast("double")
    r, a = G.polar(dx, dy)
    return C.one_unit_each(spark, d).select("unit_key", R(r).alias("radius"), R(a, 5).alias("angle"), G.quadrant(dx, dy).alias("quadrant"), G.retinal_quadrant(dy, dx).alias("place"))


@query(f"""WITH {_LINE} SELECT un.dataset_id, count(*) AS n, round(avg(abs(m * row - col + c) / sqrt(m * m + 1)), 5) AS mean_distance, round(avg((m * row - col + c) ** 2 / (m * m + 1)), 4) AS mean_square FROM un JOIN li ON li.dataset_id = un.dataset_id WHERE m IS NOT NULL GROUP BY 1""")
def line_errors(spark, d):
    li = C.unit_lines(spark, d).where("slope IS NOT NULL").select("dataset_id", "slope", "intercept")
    at = lambda x: F.col("slope") * x + F.col("intercept")
    g = G.line_distance(F.col("row").cast("double"), F.col("col").cast("double"), F.lit(0.0), at(0.0), F.lit(1.0), at(1.0))
    u = C.one_unit_each(spark, d).join(li, "dataset_id").withColumn("g", g)
    return u.groupBy("dataset_id").agg(F.count("*").alias("n"), R(F.avg("g"), 5).alias("mean_distance"), R(F.avg(F.col("g") * F.col("g")), 4).alias("mean_square"))


@query(f"""WITH {_LEN}, {_TR} SELECT recording_no, trial_idx, row_number() OVER (PARTITION BY recording_no ORDER BY trial_idx) - 1 AS new_idx FROM (SELECT *, row_number() OVER (PARTITION BY recording_no ORDER BY trial_idx DESC) AS back FROM tr) WHERE back <= 3""")
def last_trials(spark, d):
    w = Window.partitionBy("recording_no")
    back = C.trial_spans(spark, d).withColumn("back", F.row_number().over(w.orderBy(F.desc("trial_idx")))).where("back <= 3")
    return back.select("recording_no", "trial_idx", (F.row_number().over(w.orderBy("trial_idx")) - 1).cast("long").alias("new_idx"))


@query(f"""WITH {_SP}, g AS (SELECT unit_key, t, row_number() OVER (PARTITION BY unit_key ORDER BY t) - 1 AS i, lead(t) OVER (PARTITION BY unit_key ORDER BY t) - t AS g FROM sp WHERE unit_key IS NOT NULL)
SELECT CAST(i % 8 AS BIGINT) AS direction, count(g) AS n, round(min(g), 6) AS shortest, round(max(g), 6) AS longest, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS sd, count(*) FILTER (g < 0) AS n_negative FROM g WHERE g IS NOT NULL GROUP BY 1""")
def durations_by_direction(spark, d):
    from spikeloom.operators.directions import duration_stats

    b = F.floor(F.col("t") / 60)
    n = ordered.running_sum(C.spikes(spark, d).where("unit_key IS NOT NULL"), ["unit_key"], ["t"], b, F.lit(1), "i")
    s = ordered.with_neighbours(n, ["unit_key"], "i", b, F.col("t"), "before", "e").where("e IS NOT NULL").select(F.pmod(F.col("i"), F.lit(8)).cast("long").alias("direction"), "t", "e")
    got = duration_stats(s, ["direction"], "t", "e")
    return got.select("direction", "n", *[R(c).alias(c) for c in ("shortest", "longest", "mean", "sd")], "n_negative")


@query("""WITH n AS (SELECT condition_name, recording_no, CAST(floor(max(duration_sec) / 60) AS BIGINT) AS k FROM recordings WHERE condition_name IS NOT NULL AND duration_sec > 0 AND CAST(duration_sec AS VARCHAR) <> 'nan' GROUP BY ALL)
SELECT condition_name, count(*) AS n_files, count(DISTINCT k) AS n_lengths, min(k) AS shortest, max(k) AS longest, count(DISTINCT k) = 1 AS consistent FROM n GROUP BY 1""")
def length_consistency(spark, d):
    r = table(spark, d, "recordings").where(F.col("condition_name").isNotNull() & usable("duration_sec") & (F.col("duration_sec") > 0))
    n = r.groupBy("condition_name", "recording_no").agg(F.floor(F.max("duration_sec") / 60).cast("long").alias("k"))
    return n.groupBy("condition_name").agg(F.count("*").alias("n_files"), F.count_distinct("k").alias("n_lengths"), F.min("k").alias("shortest"), F.max("k").alias("longest"), (F.count_distinct("k") == 1).alias("consistent"))


@query(f"""WITH {_CELL}, per AS (SELECT dataset_id, count(*) AS n, count(*) FILTER (iprgc_2hz_QI > 0.8) AS k FROM ce WHERE iprgc_2hz_QI IS NOT NULL GROUP BY 1), base AS (SELECT sum(k) / sum(n) AS p0 FROM per),
pmf AS (SELECT dataset_id, n, k, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p0) + (n - i) * ln(1 - p0)) AS m FROM (SELECT *, unnest(range(n + 1)) AS i FROM per), base),
own AS (SELECT dataset_id, max(m) FILTER (i = k) AS mk FROM pmf GROUP BY 1), t AS (SELECT pmf.dataset_id, any_value(n) AS n, any_value(k) AS k, least(1, sum(m) FILTER (m <= mk * (1 + 1e-7))) AS p FROM pmf JOIN own USING (dataset_id) GROUP BY 1),
r AS (SELECT *, count(*) OVER () AS total, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS rk FROM (SELECT dataset_id, n, k, round(p, 12) AS p FROM t))
SELECT dataset_id, n, k, round(p, 8) AS p, round(least(1, min(p * total / rk) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 8) AS p_adjusted FROM r""")
def binomial_enrichment(spark, d):
    """Per recording: is the share of ipRGC cells off the overall one? Exact test, adjusted over recordings."""
    c = C.one_cell_each(spark, d).where("iprgc_2hz_QI IS NOT NULL")
    per = c.groupBy("dataset_id").agg(F.count("*").alias("n"), F.count_if(F.col("iprgc_2hz_QI") > 0.8).alias("k"))
    base = per.agg((F.sum("k") / F.sum("n")).alias("base"))
    tested = per.join(F.broadcast(base)).withColumn("p", F.round(population.binomial_two_sided(F.col("k"), F.col("n"), F.col("base")), 12))  # one row
    return population.fdr_adjusted(cut(tested, "tested"), [], "p").select("dataset_id", "n", "k", R("p", 8).alias("p"), R("p_adjusted", 8).alias("p_adjusted"))


@query(f"WITH {_CELL} SELECT unit_key, axon_type FROM ce ORDER BY md5('42:' || unit_key), unit_key LIMIT 200")
def seeded_sample(spark, d):
    """A sampling operator: two hundred cells in the order of a seeded hash."""
    return population.seeded_sample(C.one_cell_each(spark, d), "unit_key", 200).select("unit_key", "axon_type")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    """Hourly counts by a stream over all there is; the last state of each window is what a batch would give."""
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    counts = streams.tumbling_rates(source, ["event_type"], "ts", "1 hour", "40 days")
    path = f"{shared_dir(spark)}/spikeloom/{spark.sparkContext.applicationId}/stream-{abs(hash((d, id(source))))}"
    # Only windows that changed come out of a batch; of each the last count holds. The watermark drops windows from the state.
    q = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    q = q.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out/batch={i}")).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{path}/out").groupBy("event_type", "start").agg(F.max_by("n", "batch").alias("n"))
    return last.select("event_type", F.unix_micros("start").alias("start_us"), "n")
