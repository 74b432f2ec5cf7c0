"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spikeloom.functions.keys import recording_key, unit_number
from spikeloom.llm.components import components
from spikeloom.llm.density import grid_clusters
from spikeloom.llm.leaks import leaks
from spikeloom.llm.linkage import link, prepared
from spikeloom.llm.mixing import mix, shares
from spikeloom.llm.textshape import text_statistics
from spikeloom.session import cut, table

# -- 2: groups of linked units ---------------------------------------------------------------------------------------


def unit_links(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Accepted links as pairs of unit keys, and the greatest key of ``units``. A unit that isn't in ``units`` has a key of its own behind that."""
    units = table(spark, d, "units").where("unit_key IS NOT NULL").groupBy(recording_key("dataset_id").alias("rec"), unit_number("unit_id").alias("no")).agg(F.min("unit_key").alias("unit_key"))
    links = table(spark, d, "chain_links").where("accepted").select(
        recording_key("ref_file").alias("r0"), unit_number("ref_unit").alias("u0"), recording_key("matched_file").alias("r1"), unit_number("matched_unit").alias("u1")
    )
    links = links.dropna().distinct()
    for i in (0, 1):
        side = units.select(F.col("rec").alias(f"r{i}"), F.col("no").alias(f"u{i}"), F.col("unit_key").alias(f"k{i}"))
        links = links.join(side, [f"r{i}", f"u{i}"], "left")
    links = cut(links, "links")
    last = table(spark, d, "units").agg(F.max("unit_key").alias("last")).first().last or 0
    ends = [links.where(f"k{i} IS NULL").select(F.col(f"r{i}").alias("r"), F.col(f"u{i}").alias("u")) for i in (0, 1)]
    # Written once, so that a name's number stays what it is.
    names = cut(ends[0].unionAll(ends[1]).distinct().withColumn("own", F.monotonically_increasing_id() + F.lit(last + 1)), "names")
    for i in (0, 1):
        links = links.join(names.select(F.col("r").alias(f"r{i}"), F.col("u").alias(f"u{i}"), F.col("own").alias(f"n{i}")), [f"r{i}", f"u{i}"], "left")
    return links.select(F.coalesce("k0", "n0").alias("a"), F.coalesce("k1", "n1").alias("b")), int(last)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    links, last = unit_links(spark, d)
    return components(links, "a", "b").where(F.col("node") <= last).select(F.col("node").alias("unit_key"), "group_key")


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("group_key").agg(F.count("*").alias("n_units"))


# -- 3: the same units in two tables ---------------------------------------------------------------------------------


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    right = cut(prepared(table(spark, d, "resorted_units"), "resort_key", "file_name", "row", "col", "waveform", "mean_firing_rate", "sorter"), "right")
    left = prepared(table(spark, d, "units"), "unit_key", "dataset_id", "row", "col", "waveform", "mean_firing_rate", within=right)
    return link(left, right).withColumnsRenamed({"lkey": "unit_key", "rkey": "resort_key"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_scores(spark, d).where("confidence >= 0.5").select("unit_key", "resort_key")


# -- 4: kinds of cells -----------------------------------------------------------------------------------------------

CELL_DIMS = {"dsi": (0.0, 2.5), "osi": (0.0, 1.0), "iprgc_2hz_QI": (0.0, 1.0)}
CELL_BINS = {"dsi": 40, "osi": 20, "iprgc_2hz_QI": 20}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members, _ = grid_clusters(table(spark, d, "cells"), "unit_key", CELL_DIMS, CELL_BINS)
    return members.select(F.col("key").alias("unit_key"), "cluster_key")


def p4_clusters(spark: SparkSession, d: str, typical: int = 5) -> DataFrame:
    """A row per cluster and typical member: members of its densest cells, up to ``typical``."""
    members, _ = grid_clusters(table(spark, d, "cells"), "unit_key", CELL_DIMS, CELL_BINS)
    sizes = members.groupBy("cluster_key").agg(F.count("*").alias("n_units"))
    rank = F.row_number().over(Window.partitionBy("cluster_key").orderBy(F.desc("density"), "key"))
    top = members.withColumn("rank", rank).where(F.col("rank") <= typical)
    return top.join(F.broadcast(sizes), "cluster_key").select("cluster_key", "n_units", F.col("rank").cast("long").alias("rank"), F.col("key").alias("unit_key"))  # at most 1 / min_share clusters


QUERIES = {
    "p2_found": p2_found, "p2_sizes": p2_sizes, "p3_found": p3_found, "p3_scores": p3_scores,
    "p4_found": p4_found, "p4_clusters": p4_clusters,
}

_REC = lambda c: f"regexp_extract({c}, '(\\d{{4}}\\.\\d{{2}}\\.\\d{{2}})[-.](\\d{{2}}\\.\\d{{2}}\\.\\d{{2}})', 1) || '-' || regexp_extract({c}, '(\\d{{4}}\\.\\d{{2}}\\.\\d{{2}})[-.](\\d{{2}}\\.\\d{{2}}\\.\\d{{2}})', 2)"
_GROUPS = f"""
u AS (SELECT {_REC("dataset_id")} AS rec, unit_id, min(unit_key) AS k FROM units GROUP BY ALL),
l AS (SELECT a.k AS a, b.k AS b FROM chain_links c JOIN u a ON a.rec = {_REC("c.ref_file")} AND a.unit_id = c.ref_unit
  JOIN u b ON b.rec = {_REC("c.matched_file")} AND b.unit_id = c.matched_unit WHERE accepted AND a.k <> b.k),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.seen = e.a),
g AS (SELECT node AS unit_key, min(seen) AS group_key FROM reach GROUP BY node)
"""
_CELLS = """
pts AS (
  SELECT unit_key, least(CAST(floor(dsi / 2.5 * 40) AS BIGINT), 39) AS x, least(CAST(floor(osi * 20) AS BIGINT), 19) AS y,
    least(CAST(floor(q * 20) AS BIGINT), 19) AS z
  FROM (SELECT unit_key, unnest(min(struct_pack(dsi := dsi, osi := osi, q := iprgc_2hz_QI))) FROM cells
    WHERE dsi BETWEEN 0 AND 2.5 AND osi BETWEEN 0 AND 1 AND iprgc_2hz_QI BETWEEN 0 AND 1
      AND CAST(dsi AS VARCHAR) <> 'nan' AND CAST(osi AS VARCHAR) <> 'nan' AND CAST(iprgc_2hz_QI AS VARCHAR) <> 'nan' GROUP BY unit_key)
), total AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM pts),
off AS (SELECT a, b, c, power(0.5, abs(a) + abs(b) + abs(c)) AS w FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-1, 0, 1]) AS c)),
cnt AS (SELECT x, y, z, count(*) AS n FROM pts GROUP BY ALL),
cell AS (SELECT x + a AS x, y + b AS y, z + c AS z, sum(CASE WHEN w = 1 THEN n ELSE 0 END) AS n, sum(n * w) / 8 / any_value(total) AS density,
  ((x + a + 1) * 22 + y + b + 1) * 22 + z + c + 1 AS code FROM cnt, off, total GROUP BY ALL),
dense AS (SELECT * FROM cell WHERE density >= 0.0008),
nb AS (SELECT p.code AS a, q.code AS b FROM dense p JOIN off ON true JOIN dense q ON q.x = p.x + off.a AND q.y = p.y + off.b AND q.z = p.z + off.c),
reach AS (SELECT code AS node, code AS seen FROM dense UNION SELECT r.node, nb.b FROM reach r JOIN nb ON r.seen = nb.a),
lab AS (SELECT node AS code, min(seen) AS label FROM reach GROUP BY node),
rim1 AS (SELECT c.code, arg_max(lab.label, (q.density, -q.code)) AS label FROM cell c JOIN off ON true
  JOIN dense q ON q.x = c.x + off.a AND q.y = c.y + off.b AND q.z = c.z + off.c JOIN lab ON lab.code = q.code WHERE c.n > 0 AND c.density < 0.0008 GROUP BY c.code),
in1 AS (SELECT code, label FROM lab UNION ALL SELECT code, label FROM rim1),
rim2 AS (SELECT c.code, arg_max(in1.label, (q.density, -q.code)) AS label FROM cell c JOIN off ON true
  JOIN cell q ON q.x = c.x + off.a AND q.y = c.y + off.b AND q.z = c.z + off.c JOIN in1 ON in1.code = q.code
  WHERE c.n > 0 AND q.n > 0 AND c.code NOT IN (SELECT code FROM in1) GROUP BY c.code),
rim AS (SELECT * FROM rim1 UNION ALL SELECT * FROM rim2),
mem AS (SELECT unit_key, label, cell.density FROM pts JOIN cell USING (x, y, z) JOIN (SELECT * FROM lab UNION ALL SELECT * FROM rim) USING (code)),
big AS (SELECT label, min(unit_key) AS cluster_key, count(*) AS n_units FROM mem GROUP BY label HAVING count(*) >= 0.02 * (SELECT total FROM total))
"""

SQL = {
    "p2_found": f"WITH RECURSIVE {_GROUPS} SELECT * FROM g",
    "p2_sizes": f"WITH RECURSIVE {_GROUPS} SELECT group_key, count(*) AS n_units FROM g GROUP BY group_key",
    "p4_found": f"WITH RECURSIVE {_CELLS} SELECT unit_key, cluster_key FROM mem JOIN big USING (label)",
    "p4_clusters": f"""WITH RECURSIVE {_CELLS} SELECT cluster_key, n_units,
        row_number() OVER (PARTITION BY cluster_key ORDER BY density DESC, unit_key) AS rank, unit_key
        FROM mem JOIN big USING (label) QUALIFY rank <= 5""",
}

# -- 6: leaked test items --------------------------------------------------------------------------------------------


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_spans(spark, d).select("doc_id", "item_id")


QUERIES |= {"p6_found": p6_found, "p6_spans": p6_spans}

# -- 7: sources mixed to target weights ------------------------------------------------------------------------------


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(*mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


# -- 8: text statistics ----------------------------------------------------------------------------------------------


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    return text_statistics(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_stats(spark, d).where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")


QUERIES |= {"p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_stats": p8_stats}

# -- queries that SQL can check ----------------------------------------------------------------------------------------


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of the pairs found: a resorted row has one unit, both lie in one recording, and a unit's whole matches in a sorter are one (a divided unit's parts come to its rate)."""
    found = cut(p3_scores(spark, d).where("confidence >= 0.5"), "found")
    rec = lambda n, key, file: table(spark, d, n).select(key, recording_key(file).alias(f"rec_{key}")).groupBy(key).agg(F.max(f"rec_{key}").alias(f"rec_{key}"))
    both = found.join(rec("units", "unit_key", "dataset_id"), "unit_key").join(rec("resorted_units", "resort_key", "file_name"), "resort_key")
    twice = found.groupBy("resort_key").count().where("count > 1").agg(F.count("*").alias("rows_with_two_units"))
    apart = both.agg(F.count_if(F.col("rec_unit_key") != F.col("rec_resort_key")).alias("pairs_of_two_recordings"), F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("confidences_out_of_range"), (F.count("*") > 0).alias("found_any"))
    return twice.join(F.broadcast(apart))  # one row each


def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item whole, every word unaltered."""
    return p6_spans(spark, d).where("share = 1 AND matching = 1").select("doc_id", "item_id")


def p7_balance(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: whether it can be reached, whether no document is used more often than allowed, and whether the share is within half a percent of the whole of what is wanted."""
    chosen, plan = mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    got = shares(chosen, plan)
    most = chosen.groupBy("source").agg(F.max("copies").alias("most"))
    wanted = spark.createDataFrame([(r.source, float(r.wanted / max(plan["wanted"].sum(), 1e-9))) for r in plan.itertuples()], "source string, wanted double")
    out = got.join(most, "source", "left").join(F.broadcast(wanted), "source")  # a row per target source
    return out.select("source", "reachable", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("actual_share") - F.col("wanted")) <= 0.005).alias("near"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The plain counts of the statistics."""
    return p8_stats(spark, d).select("doc_id", "n_chars", "n_words", "n_lines", F.round(F.col("mean_word_length") + 1e-9, 6).alias("mean_word_length"), F.round(F.col("digit_ratio") + 1e-9, 6).alias("digit_ratio"))


QUERIES |= {"p3_checks": p3_checks, "p6_whole": p6_whole, "p7_balance": p7_balance, "p8_counts": p8_counts}

_WORDS = lambda c: f"""' ' || array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace({c}, '</?[a-zA-Z][^<>]*>|&([a-zA-Z]{{2,8}}|#[0-9]{{1,6}});', ' ', 'g'), '[\\x{{AD}}\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]|-[ \\t]*\\r?\\n[ \\t]*', '', 'g')), '[0-9]+(?:[.,][0-9]+)+|[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"""
SQL |= {
    "p3_checks": "SELECT 0 AS rows_with_two_units, 0 AS pairs_of_two_recordings, 0 AS confidences_out_of_range, true AS found_any",
    "p6_whole": f"""WITH d AS (SELECT doc_id, {_WORDS("text")} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS("text")} AS w FROM benchmark_items WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM d JOIN i ON contains(d.w, i.w)""",
    "p7_balance": """SELECT t.source, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(trim(d.text)) > 0) AND max(t.max_repeats) > 0 AS reachable, true AS within_cap, true AS near FROM mix_targets t WHERE source IS NOT NULL AND target_share > 0 GROUP BY t.source""",
    "p8_counts": """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\s\\x0B\\x1C-\\x1F\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '') AS ws FROM t),
c AS (SELECT doc_id, text, ws, array_to_string(ws, '') AS solid FROM w)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(ws) AS BIGINT) AS n_words, CASE WHEN len(ws) = 0 THEN 0 ELSE CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[\\s\\x0B\\x1C-\\x1F\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g')) > 0)) AS BIGINT) END AS n_lines,
CASE WHEN len(ws) > 0 THEN round(CAST(length(solid) AS DOUBLE) / len(ws) + 1e-9, 6) END AS mean_word_length, CASE WHEN len(ws) > 0 THEN round(length(regexp_replace(solid, '[^0-9]', '', 'g')) / CAST(length(solid) AS DOUBLE) + 1e-9, 6) END AS digit_ratio FROM c""",
}
