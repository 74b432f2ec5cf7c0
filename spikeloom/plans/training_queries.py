"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.operators import schema_drift as drift
from spikeloom.operators.regular_grid import event_rates, regular_grid
from spikeloom.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    docs = drift.snapshot_documents(table(spark, d, "stimulus_snapshots"))
    return drift.changes(docs, drift.fuse(docs), 2).select(F.col("doc_key").alias("snapshot_id"), "field_path", "change")


def p1_schema(spark: SparkSession, d: str) -> DataFrame:
    docs = drift.snapshot_documents(table(spark, d, "stimulus_snapshots"))
    fused = drift.fuse(docs)
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us")
    return fused.select(F.col("path").alias("field_path"), F.col("tag").alias("type"), "n_documents", at("first_at"), at("last_at"), F.col("n_alternatives").cast("long").alias("n_alternatives"), "canonical")


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    docs = drift.snapshot_documents(table(spark, d, "stimulus_snapshots"))
    got = drift.typed_branches(docs, drift.fuse(docs)).withColumnsRenamed({"doc_key": "snapshot_id", "path": "field_path", "tag": "type"})
    return got.withColumn("as_integer", F.col("as_integer").cast("string"))


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per snapshot and one column per field; conflicting fields as typed branches, names unique where case is ignored."""
    docs = drift.snapshot_documents(table(spark, d, "stimulus_snapshots"))
    return drift.wide_table(docs, drift.fuse(docs), key="snapshot_id")


def p1_alternatives(spark: SparkSession, d: str) -> DataFrame:
    docs = drift.snapshot_documents(table(spark, d, "stimulus_snapshots"))
    got = drift.appearances(docs, 2)
    return got.select(F.col("s0").alias("rig"), F.col("s1").alias("movie"), F.col("path").alias("field_path"), F.col("tag").alias("type"), F.unix_micros(F.col("first_at").cast("timestamp")).alias("first_at_us"), F.col("doc_key").alias("snapshot_id"), "replaces")


def rate_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "time_course"), "course_key", "time_bins_min", "firing_rates", 0.5, ("arrived_at", "reading_id"))


def spike_grid(spark: SparkSession, d: str) -> DataFrame:
    rates = cut(event_rates(table(spark, d, "spikes"), "recording_no", "spike_times_sec", 10.0, ("unit_key",)), "rates")  # read twice by the grid
    return regular_grid(rates, "source_key", "time", "value", 10.0)


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    both = rate_grid(spark, d).withColumn("source_kind", F.lit("rates")).unionByName(spike_grid(spark, d).withColumn("source_kind", F.lit("spikes")))
    return both.select("source_kind", "source_key", "bin_no", "n_readings", F.round("support", 3).alias("support"), F.round("value", 3).alias("value"), "status")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    both = rate_grid(spark, d).withColumn("source_kind", F.lit("rates")).unionByName(spike_grid(spark, d).withColumn("source_kind", F.lit("spikes")))
    return both.where(F.col("status").isin("filled", "missing")).select("source_kind", "source_key", "bin_no")


QUERIES = {"p1_found": p1_found, "p1_schema": p1_schema, "p1_table": p1_table, "p1_wide": p1_wide, "p1_alternatives": p1_alternatives, "p5_found": p5_found, "p5_grid": p5_grid}

_MEMBERS = """
docs AS (
  SELECT rig, movie, exported_at, min(snapshot_id) AS snapshot_id, arg_min(raw, snapshot_id)::JSON AS j
  FROM stimulus_snapshots WHERE json_valid(raw) GROUP BY rig, movie, exported_at
), top AS (
  SELECT snapshot_id, k AS name, json_extract(j, '$."' || k || '"') AS v
  FROM (SELECT snapshot_id, j, unnest(json_keys(j)) AS k FROM docs WHERE json_type(j) = 'OBJECT')
), members AS (
  SELECT snapshot_id, '' AS obj, name, name AS path, v FROM top WHERE json_type(v) NOT IN ('OBJECT', 'NULL')
  UNION ALL
  SELECT snapshot_id, obj, k AS name, obj || '.' || k AS path, json_extract(v, '$."' || k || '"') AS v
  FROM (SELECT snapshot_id, name AS obj, v, unnest(json_keys(v)) AS k FROM top WHERE json_type(v) = 'OBJECT')
), fields AS (
  SELECT snapshot_id, obj, name, path, CAST(v AS VARCHAR) AS text,
    CASE json_type(v) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal'
      WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'object' END AS tag
  FROM members WHERE json_type(v) <> 'NULL'
)
"""

SQL = {
    "p1_found": f"""
WITH {_MEMBERS}, steps AS (
  SELECT snapshot_id AS new_id, lag(snapshot_id) OVER (PARTITION BY rig, movie ORDER BY exported_at) AS old_id
  FROM docs WHERE exported_at IS NOT NULL
), old AS (SELECT s.new_id AS id, f.* FROM steps s JOIN fields f ON f.snapshot_id = s.old_id),
new AS (SELECT s.new_id AS id, f.* FROM steps s JOIN fields f ON f.snapshot_id = s.new_id WHERE s.old_id IS NOT NULL),
gone AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.id = o.id AND n.obj = o.obj AND n.name = o.name)),
come AS (SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.id = o.id AND n.obj = o.obj AND n.name = o.name)),
one AS (
  SELECT g.id, g.obj, g.tag, g.text FROM (SELECT id, obj, tag, text FROM gone GROUP BY ALL HAVING count(*) = 1) g
  JOIN (SELECT id, obj, tag, text FROM come GROUP BY ALL HAVING count(*) = 1) c USING (id, obj, tag, text)
)
SELECT o.id AS snapshot_id, o.path AS field_path, 'retyped' AS change FROM old o JOIN new n USING (id, obj, name) WHERE o.tag <> n.tag
UNION ALL
SELECT g.id, g.path, CASE WHEN one.id IS NULL THEN 'removed' ELSE 'renamed' END FROM gone g LEFT JOIN one USING (id, obj, tag, text)
UNION ALL
SELECT c.id, c.path, 'added' FROM come c LEFT JOIN one USING (id, obj, tag, text) WHERE one.id IS NULL
""",
    "p1_schema": f"""
WITH {_MEMBERS}, alt AS (
  SELECT path, tag, count(*) AS n, epoch_us(min(exported_at)) AS a, epoch_us(max(exported_at)) AS z
  FROM fields JOIN docs USING (snapshot_id) GROUP BY path, tag
), tags AS (
  SELECT path, count(*) AS k, min(tag) AS one, bool_and(tag IN ('integer', 'decimal')) AS numeric FROM alt GROUP BY path
)
SELECT path AS field_path, tag AS type, n AS n_documents, a AS first_at_us, z AS last_at_us, k AS n_alternatives,
  CASE WHEN k = 1 THEN one WHEN numeric THEN 'decimal' ELSE 'text' END AS canonical
FROM alt JOIN tags USING (path)
""",
    "p1_table": f"""
WITH {_MEMBERS}, tags AS (
  SELECT path, count(DISTINCT tag) AS k, min(tag) AS one, bool_and(tag IN ('integer', 'decimal')) AS numeric FROM fields GROUP BY path
), objects AS (
  SELECT DISTINCT text, unnest(json_keys(text::JSON)) AS name FROM fields WHERE tag = 'object'
), sorted AS (
  SELECT text, '{{' || string_agg('"' || name || '":' || CAST(json_extract(text::JSON, '$."' || name || '"') AS VARCHAR), ',' ORDER BY name) || '}}' AS j FROM objects GROUP BY text
), typed AS (
  SELECT f.*, CASE WHEN tag = 'object' THEN coalesce(sorted.j, '{{}}') ELSE CAST(json(text) AS VARCHAR) END AS laid_out, CASE WHEN k = 1 THEN one WHEN numeric THEN 'decimal' ELSE 'text' END AS canonical, json_extract_string(('{{"x":' || text || '}}')::JSON, '$.x') AS plain
  FROM fields f JOIN tags USING (path) LEFT JOIN sorted USING (text)
)
SELECT snapshot_id, path AS field_path, tag AS type, canonical, CASE WHEN tag = 'integer' THEN text END AS as_integer, CASE WHEN tag = 'decimal' THEN CAST(text AS DOUBLE) END AS as_decimal,
  CASE WHEN tag = 'text' THEN plain END AS as_text, CASE WHEN tag = 'boolean' THEN CAST(text AS BOOLEAN) END AS as_boolean,
  CASE WHEN tag IN ('array', 'object') THEN laid_out END AS as_json,
  CASE WHEN canonical = 'decimal' OR tag = 'decimal' THEN CAST(CAST(text AS DOUBLE) AS VARCHAR) WHEN tag = 'text' THEN plain WHEN tag IN ('array', 'object') THEN laid_out ELSE text END AS canonical_value
FROM typed
""",
    "p1_alternatives": f"""
WITH {_MEMBERS}, alt AS (
  SELECT rig, movie, path, tag, min((exported_at, snapshot_id)) AS f FROM fields JOIN docs USING (snapshot_id) WHERE exported_at IS NOT NULL GROUP BY ALL
)
SELECT rig, movie, path AS field_path, tag AS type, epoch_us(f[1]) AS first_at_us, f[2] AS snapshot_id,
  row_number() OVER (PARTITION BY rig, movie, path ORDER BY f, tag) > 1 AS replaces FROM alt
""",
    "p5_found": """
WITH r AS (
  SELECT 'rates' AS source_kind, course_key AS source_key, CAST(floor(time_bins_min / 0.5) AS BIGINT) AS bin_no
  FROM time_course WHERE time_bins_min >= 0 AND CAST(time_bins_min AS VARCHAR) <> 'nan' AND firing_rates >= 0 AND CAST(firing_rates AS VARCHAR) <> 'nan'
  UNION SELECT 'spikes', recording_no, CAST(floor(spike_times_sec / 10) AS BIGINT)
  FROM spikes WHERE spike_times_sec >= 0 AND CAST(spike_times_sec AS VARCHAR) <> 'nan'
), s AS (SELECT source_kind, source_key, min(bin_no) AS lo, max(bin_no) AS hi FROM r WHERE source_key IS NOT NULL GROUP BY ALL)
SELECT source_kind, source_key, bin_no FROM (SELECT source_kind, source_key, unnest(range(lo, hi + 1)) AS bin_no FROM s)
EXCEPT SELECT source_kind, source_key, bin_no FROM r
""",
    "p5_grid": """
WITH once AS (
  SELECT 'rates' AS source_kind, course_key AS source_key, time_bins_min / 0.5 AS x,
    arg_max(firing_rates, (arrived_at, reading_id)) AS y
  FROM time_course WHERE course_key IS NOT NULL AND time_bins_min >= 0 AND CAST(time_bins_min AS VARCHAR) <> 'nan' AND firing_rates >= 0 AND CAST(firing_rates AS VARCHAR) <> 'nan'
  GROUP BY ALL
), counted AS (
  SELECT 'spikes' AS source_kind, recording_no AS source_key, floor(spike_times_sec / 10) + 0.5 AS x,
    count(DISTINCT (unit_key, spike_times_sec)) / 10.0 AS y
  FROM spikes WHERE recording_no IS NOT NULL AND spike_times_sec >= 0 AND CAST(spike_times_sec AS VARCHAR) <> 'nan' GROUP BY ALL
), r AS (SELECT *, CAST(floor(x) AS BIGINT) AS b FROM (SELECT * FROM once UNION ALL SELECT * FROM counted)),
s AS (SELECT source_kind, source_key, min(b) AS lo, max(b) AS hi FROM r GROUP BY ALL),
g AS (SELECT source_kind, source_key, unnest(range(lo, hi + 1)) AS bin_no FROM s),
near AS (SELECT g.*, r.x - g.bin_no - 0.5 AS d, r.y, 1 - ((r.x - g.bin_no - 0.5) / 2.5) ** 2 AS w, r.b = g.bin_no AS own
  FROM g JOIN (SELECT *, b + unnest([-2, -1, 0, 1, 2]) AS hit FROM r) r ON g.source_kind = r.source_kind AND g.source_key = r.source_key AND g.bin_no = r.hit),
fit AS (SELECT source_kind, source_key, bin_no, count(*) FILTER (WHERE own) AS n, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2,
  sum(w * y) AS t0, sum(w * d * y) AS t1, sum(w * w) AS q FROM near GROUP BY ALL),
est AS (SELECT g.*, coalesce(n, 0) AS n, CASE WHEN s0 >= 0.01 THEN s0 * s0 / q ELSE 0.0 END AS support,
  CASE WHEN s0 >= 0.01 AND s0 * s2 - s1 * s1 > 1e-6 * s0 * s0 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) WHEN s0 >= 0.01 THEN t0 / s0 END AS v
  FROM g LEFT JOIN fit USING (source_kind, source_key, bin_no))
SELECT source_kind, source_key, bin_no, n AS n_readings, round(support, 3) AS support,
  CASE WHEN n > 0 OR (support >= 2 - 1e-6 AND v IS NOT NULL) THEN round(greatest(v, 0), 3) END AS value,
  CASE WHEN n > 0 THEN 'observed' WHEN support >= 2 - 1e-6 AND v IS NOT NULL THEN 'filled' ELSE 'missing' END AS status
FROM est
""",
}
