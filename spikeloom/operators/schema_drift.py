"""Schemas that drift between files: tagged-union inference over JSON documents.

Each document is parsed once into a variant and laid out as tagged members: a
member carries its path, a type tag and its canonical text. From the members
come

* ``fuse``: the union schema. Schemas of single documents are fused with an
  associative aggregate, so partial schemas merge before the shuffle; a path
  keeps every alternative type it ever had, under a code of its own.
* ``appearances``: when each alternative of a path first appears in a series.
* ``typed_branches`` and ``wide_table``: one consistent table in which a path
  whose types conflict is split into typed branches beside one canonical
  conversion; by field, or with a row per document.
* ``changes``: a report of every alternative or field that appears, goes, or
  changes its name between one document of a series and the next. Documents
  are compared as sets of the union schema's alternatives; the schema gives the
  codes that differ their names back.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spikeloom.session import cut

# The type tags, from the most special to the most general.
TAGS = ("boolean", "integer", "decimal", "text", "array", "object")


@contextmanager
def _repeated_names(spark: SparkSession):
    """Lets the parser take objects that repeat a name, while expressions are built."""
    key = "spark.sql.variant.allowDuplicateKeys"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def tagged_members(df: DataFrame, raw: str, out: str = "members") -> DataFrame:
    """Add ``out``: an array of ``struct<obj, name, path, tag, text>``, NULL where ``raw`` isn't valid JSON.

    A member of the top level that isn't an object is a field (``obj`` NULL);
    so is each member of a top-level object, no deeper. JSON null counts as
    absent. Valid JSON that isn't an object has no members. Of members of one
    object with the same name the last counts. Numbers written with a point or
    an exponent are decimal, other numbers integer; a number of more than 38
    digits is an integer if no number of the document has an exponent, and none
    as long has a point. ``text`` is the value as JSON with sorted keys and
    without layout.
    """
    # The brackets make the parser reject anything behind the document. Each level is a lambda's argument, so it is computed once.
    tmp = "doc"
    parsed = f"try_cast(try_parse_json(concat('[', `{raw}`, ']')) AS ARRAY<VARIANT>)"
    long_integers = f"(`{raw}` RLIKE '[0-9]{{39}}' AND NOT `{raw}` RLIKE '[0-9][eE][-+0-9]|[0-9]{{39,}}[.]')"
    members = f"""
      transform(filter(flatten(transform(
        coalesce(map_entries(try_cast(`{tmp}` AS MAP<STRING, VARIANT>)), array()),
        e -> CASE WHEN schema_of_variant(e.value) LIKE 'OBJECT%'
             THEN transform(map_entries(try_cast(e.value AS MAP<STRING, VARIANT>)),
                            m -> named_struct('obj', e.key, 'name', m.key, 'value', m.value))
             ELSE array(named_struct('obj', CAST(NULL AS STRING), 'name', e.key, 'value', e.value)) END)),
        f -> NOT is_variant_null(f.value)),
        f -> named_struct('obj', f.obj, 'name', f.name,
          'path', concat_ws('.', f.obj, f.name),
          'tag', CASE
            WHEN schema_of_variant(f.value) = 'BIGINT' THEN 'integer'
            WHEN schema_of_variant(f.value) RLIKE '^DECIMAL\\\\((19|2[0-9]|3[0-9]),0\\\\)' THEN 'integer'
            WHEN schema_of_variant(f.value) = 'DOUBLE' AND {long_integers} AND abs(try_variant_get(f.value, '$', 'double')) >= 1e38D THEN 'integer'
            WHEN schema_of_variant(f.value) RLIKE '^(DECIMAL|DOUBLE|FLOAT)' THEN 'decimal'
            WHEN schema_of_variant(f.value) = 'STRING' THEN 'text'
            WHEN schema_of_variant(f.value) = 'BOOLEAN' THEN 'boolean'
            WHEN schema_of_variant(f.value) LIKE 'ARRAY%' THEN 'array'
            ELSE 'object' END,
          'text', to_json(f.value)))
    """
    with _repeated_names(df.sparkSession):
        return df.withColumn(out, F.expr(f"get(transform(filter(array({parsed}), a -> size(a) = 1), a -> get(transform(a, {tmp} -> {members}), 0)), 0)"))


def documents_of(df: DataFrame, key: str, series: tuple[str, ...], at: str, raw: str) -> DataFrame:
    """One row per document: ``doc_key, s0.., at, members``.

    Rows whose ``raw`` isn't valid JSON are left out. Rows of one series and
    time are one document, named by its smallest key, whose text it takes.
    NULLs in series columns are values like others. What moves between tasks is
    the text itself, which is smaller than its members.
    """
    rows = df.select(F.col(key).alias("doc_key"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(series)], F.col(at).alias("at"), F.col(raw).alias("raw"))
    with _repeated_names(df.sparkSession):
        valid = rows.where("size(try_cast(try_parse_json(concat('[', raw, ']')) AS ARRAY<VARIANT>)) = 1")
    by = [f"s{i}" for i in range(len(series))] + ["at"]
    once = valid.groupBy(*by).agg(F.min("doc_key").alias("doc_key"), F.min_by("raw", "doc_key").alias("raw"))
    return tagged_members(once, "raw").drop("raw")


def _codes(m):
    """The codes of a member's path and of its alternative."""
    return F.xxhash64(m["obj"], m["name"]), F.xxhash64(m["obj"], m["name"], m["tag"])


def fuse(docs: DataFrame) -> DataFrame:
    """The union schema: a row per path and alternative type.

    ``path, tag, path_code, n_documents, first_at, last_at, obj, fits,
    n_alternatives, canonical``: ``obj`` is the object that holds the field,
    NULL at the top level; ``fits`` tells whether no value is an integer of
    more than 38 digits; ``canonical`` is the type all alternatives of the path convert
    to: the type itself, decimal for integer and decimal, else text. A path
    under the top level and one of the same spelling at the top level have
    different codes.
    """
    m = docs.select("at", F.explode("members").alias("m"))
    fits = (F.col("m.tag") != "integer") | F.col("m.text").try_cast("decimal(38,0)").isNotNull()
    alt = m.groupBy("m.path", "m.tag", _codes(F.col("m"))[0].alias("path_code")).agg(
        F.count("*").alias("n_documents"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min("m.obj").alias("obj"), F.bool_and(fits).alias("fits")
    )
    tags = alt.groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("tags"))  # at most len(TAGS) per path
    numeric = F.size(F.array_except("tags", F.array(F.lit("integer"), F.lit("decimal")))) == 0
    canonical = F.when(F.size("tags") == 1, F.col("tags")[0]).when(numeric, "decimal").otherwise("text")
    return alt.join(tags.select("path", F.size("tags").alias("n_alternatives"), canonical.alias("canonical")), "path")


def appearances(docs: DataFrame, n_series: int) -> DataFrame:
    """The first document of each series that holds an alternative: ``s0.., path, tag, first_at, doc_key, replaces``.

    ``replaces`` tells whether the path was there before with another type:
    the alternative is a conflict that appears, not a new field. Documents
    without a time are left out.
    """
    keys = [f"s{i}" for i in range(n_series)]
    m = docs.where("at IS NOT NULL").select(*keys, "at", "doc_key", F.explode("members").alias("m"))
    alt = m.groupBy(*keys, "m.path", "m.tag").agg(F.min(F.struct("at", "doc_key")).alias("f"))
    first = Window.partitionBy(*keys, "path").orderBy("f", "tag")  # at most len(TAGS) rows
    return alt.select(*keys, "path", "tag", F.col("f.at").alias("first_at"), "f.doc_key", (F.row_number().over(first) > 1).alias("replaces"))


def _branches(tag, text) -> list:
    """The typed branches of a value and its canonical form, by its tag and JSON text; ``canonical`` is a column."""
    plain = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x string")["x"]
    number = text.try_cast("double")
    return [
        F.when(tag == "integer", text.try_cast("decimal(38,0)")).alias("as_integer"), F.when(tag == "decimal", number).alias("as_decimal"),
        F.when(tag == "text", plain).alias("as_text"), F.when(tag == "boolean", text.try_cast("boolean")).alias("as_boolean"), F.when(tag.isin("array", "object"), text).alias("as_json"),
        F.when((F.col("canonical") == "decimal") | (tag == "decimal"), number.cast("string")).otherwise(F.when(tag == "text", plain).otherwise(text)).alias("canonical_value"),
    ]


def typed_branches(docs: DataFrame, schema: DataFrame) -> DataFrame:
    """The consistent table: a row per document and field, its value in the branch of its type and in canonical form.

    ``doc_key, path, tag, canonical, as_integer, as_decimal, as_text,
    as_boolean, as_json, canonical_value``. A value lands in exactly one
    branch; an integer of more than 38 digits only in the canonical form.
    """
    m = docs.select("doc_key", F.explode("members").alias("m")).select("doc_key", "m.path", "m.tag", "m.text")
    per_path = schema.select("path", "canonical").distinct()
    return m.join(per_path, "path").select("doc_key", "path", "tag", "canonical", *_branches(F.col("tag"), F.col("text")))


#: What a column of the wide table is, by the canonical type of its path.
_SQL_TYPES = {"integer": "decimal(38,0)", "decimal": "double", "text": "string", "boolean": "boolean", "array": "string", "object": "string"}


def _column_names(fields: list, key: str) -> list[str]:
    """A column name for each of ``fields`` (``path, n``), no two of them or ``key`` the same where case is ignored.

    A field is named by its path. Of fields whose paths are the same then, the
    one in most documents has the path, the others ``path#2``, ``path#3``, ..,
    without those that are paths themselves.
    """
    fold = lambda name: name.lower().upper()
    paths, taken, out = {fold(r.path) for r in fields}, {fold(key)}, {}
    for i in sorted(range(len(fields)), key=lambda i: (-fields[i].n, i)):
        name, k = fields[i].path, 1
        while fold(name) in taken or (k > 1 and fold(name) in paths):
            k += 1
            name = f"{fields[i].path}#{k}"
        taken.add(fold(name))
        out[i] = name
    return [out[i] for i in range(len(fields))]


def wide_table(docs: DataFrame, schema: DataFrame, max_columns: int = 2000, key: str = "doc_key") -> DataFrame:
    """The consistent table with a row per document: ``key``, and a column per field in the canonical type of its path.

    A path with several types has a struct ``value`` (canonical) beside a typed
    branch ``as_<tag>`` for each. Integers of a field that has one of more than
    38 digits are text. Columns are in order of their paths and named by them.
    Fields that differ in letter case alone, fields of one spelling at two
    levels and fields named as ``key`` keep columns of their own: see
    ``_column_names``. A column's metadata tell its field: ``path``, and
    ``object``, NULL at the top level. The union schema goes to the driver to
    name the columns: more than ``max_columns`` fields are an error, not a cut.
    """
    per_field = schema.groupBy("path", "path_code").agg(
        F.min("obj").alias("obj"), F.sort_array(F.collect_set("tag")).alias("tags"), F.first("canonical").alias("canonical"),
        F.max("n_alternatives").alias("n_alternatives"), F.sum("n_documents").alias("n"), F.bool_and("fits").alias("fits"),
    )
    fields = per_field.orderBy("path", "obj").limit(max_columns + 1).collect()
    if len(fields) > max_columns:
        raise ValueError(f"more than {max_columns} paths; use typed_branches")
    rows = docs.select(F.col("doc_key").alias(key), F.map_from_entries(F.transform("members", lambda m: F.struct(_codes(m)[0].alias("k"), F.struct(m["tag"].alias("tag"), m["text"].alias("text")).alias("v")))).alias("m"))

    def typed(v, tag: str, only: bool):
        text = v["text"]
        plain = F.when(v["tag"] == "text", F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x string")["x"]).otherwise(text)
        got = plain if _SQL_TYPES[tag] == "string" else text.try_cast(_SQL_TYPES[tag])
        return F.when(v["tag"] == tag, got) if only else got

    out = []
    for r, name in zip(fields, _column_names(fields, key)):
        v = F.try_element_at("m", F.lit(r.path_code).cast("long"))
        value = typed(v, r.canonical if r.fits or r.canonical != "integer" else "text", False)
        column = value if r.n_alternatives == 1 else F.when(v.isNotNull(), F.struct(value.alias("value"), *[typed(v, t, True).alias(f"as_{t}") for t in r.tags]))
        out.append(column.alias(name, metadata={"path": r.path, "object": r.obj}))
    return rows.select(key, *out)


def changes(docs: DataFrame, schema: DataFrame, n_series: int, bucket: str = "month") -> DataFrame:
    """Every change against the document before it in the same series: ``doc_key, field_path, change``.

    ``retyped``: in both with another type. ``renamed``: gone, while exactly
    one new field of the same object has its type and value and no other field
    gone from that object has them; reported under the old path, the new one
    isn't reported. Else ``removed`` or ``added``. The first document of a
    series has no changes. Documents without a time can't be ordered and
    aren't compared.

    Documents are laid out over the alternatives of the union schema: a document
    is a set of codes of (path, type), and only the alternatives that one of two
    neighbours lacks are looked at. ``schema`` gives codes their paths back.

    Skew: a series is cut into time buckets and rows are partitioned by
    (series, bucket). What crosses a bucket's edge is one row per bucket: its
    last document.
    """
    keys = [f"s{i}" for i in range(n_series)]
    code = lambda m: F.struct(_codes(m)[0].alias("c"), _codes(m)[1].alias("a"), F.xxhash64(m["obj"]).alias("o"), F.xxhash64(m["tag"], m["text"]).alias("v"))
    rows = docs.where("at IS NOT NULL").select("doc_key", *keys, "at", F.transform("members", code).alias("is"), F.date_trunc(bucket, F.col("at").cast("timestamp")).cast("long").alias("bucket"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("at")
    here = rows.withColumn("before", F.lag("is").over(inside))
    tails = rows.groupBy(*keys, "bucket").agg(F.max_by("is", "at").alias("tail"))
    tails = tails.withColumn("tail", F.lag("tail").over(Window.partitionBy(*keys).orderBy("bucket"))).where("tail IS NOT NULL")
    same = [here[k].eqNullSafe(tails[k]) for k in keys] + [here["bucket"] == tails["bucket"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    pairs = here.join(tails, on, "left").select(here["doc_key"], F.coalesce(here["before"], tails["tail"]).alias("was"), here["is"]).where("was IS NOT NULL")
    apart = lambda x, y: f"array_except(transform({x}, m -> m.a), transform({y}, m -> m.a))"
    pairs = pairs.select("doc_key", "was", "is", F.expr(apart("was", "is")).alias("lost"), F.expr(apart("is", "was")).alias("won")).where("size(lost) + size(won) > 0")
    # From here on only alternatives that differ: few of a document's.
    pairs = pairs.select("doc_key", F.expr("filter(was, m -> array_contains(lost, m.a))").alias("lost"), F.expr("filter(is, m -> array_contains(won, m.a))").alias("won"))
    pairs = pairs.select(
        "doc_key", F.expr("transform(filter(lost, p -> exists(won, n -> n.c = p.c)), p -> p.c)").alias("retyped"),
        F.expr("filter(lost, p -> NOT exists(won, n -> n.c = p.c))").alias("gone"), F.expr("filter(won, p -> NOT exists(lost, n -> n.c = p.c))").alias("come"),
    )
    twin = "size(filter(come, n -> n.o = p.o AND n.v = p.v)) = 1 AND size(filter(gone, n -> n.o = p.o AND n.v = p.v)) = 1"
    report = F.expr(f"""concat(
        transform(retyped, c -> named_struct('c', c, 'change', 'retyped')),
        transform(gone, p -> named_struct('c', p.c, 'change', CASE WHEN {twin} THEN 'renamed' ELSE 'removed' END)),
        transform(filter(come, p -> NOT ({twin})), p -> named_struct('c', p.c, 'change', 'added')))""")
    found = pairs.select("doc_key", F.explode(report).alias("r")).select("doc_key", F.col("r.c").alias("path_code"), "r.change")
    names = schema.select("path_code", F.col("path").alias("field_path")).distinct()
    return found.join(names, "path_code").select("doc_key", "field_path", "change")


def snapshot_documents(snapshots: DataFrame) -> DataFrame:
    """The documents of a stimulus snapshot table, cut."""
    return cut(documents_of(snapshots, "snapshot_id", ("rig", "movie"), "exported_at", "raw"), "drift")
