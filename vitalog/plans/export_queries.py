"""Queries over export files, the import of them, and the tables it writes."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import files, schemas
from ..functions.dates import lenient_iso_text, parse_date_strict
from ..functions.numeric import safe_float
from ..operators import rawxml, workouts as workout_ops
from ..params import WORKOUT_PREFIX
from ..session import scratch_dir
from ..sinks import tables as sinks
from ..sources import export_xml, markup, normalize
from ..sources.landing import Tables, compact_imports, import_export, malformed_files, scan_tables
from ..sources.tables import read_parquet, read_table, route_by_schema
from ..streaming import ingest, samples
from . import sql
from .export_files import FILE_ENDS, KEYS_PER_FILE, export_elements, export_path, raw_event_attributes, record_lines
from .views import EVENTS, SCALE, event_records, order_records, pages, stats, table, workouts

QUERIES = {}
ORACLES = {}


def query(name: str, build, oracle: str | None) -> None:
    QUERIES[name] = build
    if oracle:
        ORACLES[name] = oracle


AT = "date_trunc('second', ts) + INTERVAL 4 HOUR"
VALUE_TEXT = "CASE event_type WHEN 'error' THEN props WHEN 'signup' THEN '' ELSE CAST(value AS VARCHAR) END"
RECORDS = f"""SELECT event_type AS type,
  CASE WHEN event_type = 'click' THEN '9.1' ELSE '' END AS "sourceVersion",
  'user_' || CAST(user_id % 10 AS VARCHAR) AS "sourceName",
  CASE WHEN user_id % 3 = 0 THEN '<<HKDevice>, name:Watch>' ELSE '' END AS device,
  CAST({AT} AS TIMESTAMP) AS "startDate", CAST({AT} AS TIMESTAMP) AS "endDate",
  CAST({AT} AS TIMESTAMP) AS "creationDate",
  CASE WHEN event_type <> 'error' THEN 'count' ELSE '' END AS unit,
  CASE WHEN event_type IN ('error', 'signup') THEN 0.0 ELSE value END AS value,
  {VALUE_TEXT} AS "textValue" FROM events"""
# A click holds another record, of the same attributes but the type.
RECORDS = f"""{RECORDS} UNION ALL SELECT * REPLACE ('inner' AS type) FROM ({RECORDS}) WHERE type = 'click'"""
DURATION = """CASE WHEN o_orderpriority = '4-NOT SPECIFIED' OR o_orderstatus = 'P' THEN 0.0
  ELSE o_totalprice END"""
WORKOUTS = f"""SELECT 'HKWorkout' || o_orderpriority AS type, {DURATION} AS duration,
  'min' AS "durationUnit", o_orderstatus AS "sourceName", o_orderdate AS "startDate",
  o_orderdate AS "endDate", o_orderdate AS "creationDate" FROM orders"""
STATS = """SELECT l_returnflag AS type, l_shipdate AS "startDate", l_shipdate AS "endDate",
  CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0.0 END AS "sum", 0.0 AS average,
  l_extendedprice AS maximum, 0.0 AS minimum, l_linestatus AS unit
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""
DOUBLES = "CAST(average AS DOUBLE) AS average, CAST(minimum AS DOUBLE) AS minimum"
STATS_TYPED = f"""SELECT type, "startDate", "endDate", CAST("sum" AS DOUBLE) AS "sum", {DOUBLES},
  maximum, unit FROM ({STATS})"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events", EVENTS)


# --- XML scans -----------------------------------------------------------------------------
query("ingest_records",
      lambda s, d: scan_tables(s, export_path(s, d))["records"], RECORDS)
query("ingest_records_split", lambda s, d: markup.records(export_elements(s, d)), RECORDS)
query("ingest_workouts",
      lambda s, d: scan_tables(s, export_path(s, d))["workouts"].drop("workout_id"), WORKOUTS)
query("ingest_stats",
      lambda s, d: scan_tables(s, export_path(s, d))["stats"].drop("workout_id"), STATS_TYPED)
query("ingest_stats_split", lambda s, d: markup.stats(export_elements(s, d)).drop("workout_id"), STATS_TYPED)


def _linked(spark, sf_dir):
    """How the statistics hang on the workouts they were written in."""
    found = scan_tables(spark, export_path(spark, sf_dir))
    return workout_ops.stats_workout_keyed(found["workouts"], found["stats"], scale=SCALE)


LINKED = sql.with_views(
    f"""w AS (SELECT o_orderkey AS id, {DURATION} AS duration,
        'HKWorkout' || o_orderpriority AS type, 'min' AS unit FROM orders)""",
    """s AS (SELECT l_orderkey AS id, l_returnflag AS stat_type, l_linestatus AS unit,
        CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0.0 END AS total FROM lineitem)""") + f"""
  SELECT w.type, stat_type, 'duration' AS measure, w.unit AS unit, {sql.summary("duration")}
  FROM w JOIN s USING (id) GROUP BY w.type, stat_type, w.unit
  UNION ALL
  SELECT w.type, stat_type, 'sum' AS measure, s.unit AS unit, {sql.summary("total")}
  FROM w JOIN s USING (id) GROUP BY w.type, stat_type, s.unit"""
query("ingest_linked_stats", _linked, LINKED)
query("ingest_linked_stats_split",
      lambda s, d: workout_ops.stats_workout_keyed(
          markup.workouts(export_elements(s, d)), markup.stats(export_elements(s, d)), scale=SCALE), LINKED)

DOC_COLUMNS = ("tag", "type", "sourceName", "textvalue", "value", "dateComponents", "startDateText")
query("ingest_documents",
      lambda s, d: markup.documents(export_elements(s, d)).select(
          *DOC_COLUMNS, F.size("attrs").alias("n_attrs")),
      f"""SELECT 'Record' AS tag, event_type AS type, 'user_' || CAST(user_id % 10 AS VARCHAR) AS "sourceName",
        {VALUE_TEXT} AS textvalue,
        CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 0.0 ELSE value END AS value,
        CAST({AT} AS TIMESTAMP) AS "dateComponents",
        strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-04:00' AS "startDateText",
        CAST(5 + (event_type = 'click')::INT + (user_id % 3 = 0)::INT + (event_type <> 'error')::INT
             + (event_type <> 'signup')::INT AS INTEGER) AS n_attrs
      FROM events WHERE event_type <> 'purchase'
      UNION ALL SELECT 'Correlation', event_type, NULL, '', NULL, NULL, NULL, 1
      FROM events WHERE event_type = 'purchase'
      UNION ALL SELECT 'Workout', NULL, o_orderstatus, '', NULL, o_orderdate,
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00',
        CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '4-NOT SPECIFIED' THEN 6 ELSE 7 END
      FROM orders""")

# --- questions to the export itself --------------------------------------------------------
query("xml_structure", lambda s, d: rawxml.structure(export_elements(s, d)), """
  SELECT 'root_elements' AS kind, 'HealthData' AS name WHERE EXISTS (FROM events)
  UNION SELECT 'root_elements', 'Record' FROM events
  UNION SELECT 'root_elements', 'MetadataEntry' FROM events WHERE event_type = 'view'
  UNION SELECT 'root_elements', 'Correlation' FROM events WHERE event_type = 'purchase'
  UNION SELECT 'root_elements', 'Workout' FROM orders
  UNION SELECT 'root_elements', 'WorkoutStatistics' FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
  UNION SELECT 'record_types', event_type FROM events
  UNION SELECT 'record_types', 'inner' FROM events WHERE event_type = 'click'
  UNION SELECT 'workout_types', 'HKWorkout' || o_orderpriority FROM orders
  UNION SELECT 'sources', 'user_' || CAST(user_id % 10 AS VARCHAR) FROM events""")
query("xml_tag_counts",
      lambda s, d: rawxml.tag_counts(export_elements(s, d), ("Record", "Workout", "WorkoutStatistics")),
      f"""SELECT 'Record' AS tag, COUNT(*) AS "count" FROM ({RECORDS})
      UNION ALL SELECT 'Workout', COUNT(*) FROM orders
      UNION ALL SELECT 'WorkoutStatistics', COUNT(*) FROM lineitem
      WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
query("xml_tags", lambda s, d: rawxml.tags_in_text(pages(s, d), "html"),
      """SELECT tag, COUNT(*) AS "count" FROM (
        SELECT unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages)
      GROUP BY tag""")


def sql_escaped(text: str) -> str:
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, '{plain}', '{reference}')"
    return text


def sql_attribute(name: str, value: str) -> str:
    return f"""COALESCE(' {name}="' || {sql_escaped(value)} || '"', '')"""


STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' -0400'"
RECORD_XML = " || ".join([
    "'<Record'", sql_attribute("type", "shown_type"),
    sql_attribute("sourceName", "'user_' || CAST(user_id % 10 AS VARCHAR)"),
    sql_attribute("sourceVersion", "CASE WHEN event_type = 'click' THEN '9.1' END"),
    sql_attribute("device", "CASE WHEN user_id % 3 = 0 THEN '<<HKDevice>, name:Watch>' END"),
    sql_attribute("unit", "CASE WHEN event_type <> 'error' THEN 'count' END"),
    *[sql_attribute(n, STAMP) for n in ("creationDate", "startDate", "endDate")],
    sql_attribute("value", """CASE WHEN event_type = 'error' THEN props
      WHEN event_type <> 'signup' THEN CAST(value AS VARCHAR) END"""),
    """CASE WHEN shown_type = 'view' THEN '><MetadataEntry key="k" value="v" /></Record>' ELSE ' />' END"""])


def sql_opened(tag: str, *attributes: str) -> str:
    return " || ".join([f"'<{tag}'", *attributes])


# The bytes of every line of the files, with its line break.
RECORD_TAG = RECORD_XML.rsplit(" || ", 1)[0]
WORKOUT_AT, STAT_AT = (f"strftime({c}, '%Y-%m-%d %H:%M:%S') || ' +0000'" for c in ("o_orderdate", "l_shipdate"))
WORKOUT_TAG = sql_opened(
    "Workout", sql_attribute("workoutActivityType", "'HKWorkout' || o_orderpriority"),
    sql_attribute("duration", """CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'abc'
      WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS VARCHAR) END"""),
    sql_attribute("durationUnit", "'min'"), sql_attribute("sourceName", "o_orderstatus"),
    *[sql_attribute(n, WORKOUT_AT) for n in ("creationDate", "startDate", "endDate")])
STAT_TAG = sql_opened(
    "WorkoutStatistics", sql_attribute("type", "l_returnflag"), sql_attribute("startDate", STAT_AT), sql_attribute("endDate", STAT_AT),
    sql_attribute("sum", "CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS VARCHAR) END"),
    sql_attribute("maximum", "CAST(l_extendedprice AS VARCHAR)"), sql_attribute("unit", "l_linestatus"))
query("xml_file_size", lambda s, d: export_xml.file_size_mb(s, export_path(s, d, "none")), f"""
  WITH tags AS (SELECT event_type, strlen({RECORD_TAG}) AS n FROM (SELECT *, event_type AS shown_type FROM events)),
  lines AS (
    SELECT n + CASE event_type
        WHEN 'purchase' THEN strlen('<Correlation type="purchase">' || '/>' || '</Correlation>')
        WHEN 'view' THEN strlen('>x <MetadataEntry key="k" value="v"/>x</Record>')
        WHEN 'click' THEN n + strlen('>/></Record>') ELSE 2 END + 1 AS n FROM tags
    UNION ALL SELECT strlen({WORKOUT_TAG}) + 2 FROM orders
    UNION ALL SELECT strlen('</Workout>') + 1 FROM orders
    UNION ALL SELECT strlen({STAT_TAG}) + 3 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT {sum(len(text) + 1 for text, _ in FILE_ENDS)} FROM (
      SELECT event_id // {KEYS_PER_FILE} FROM events UNION SELECT o_orderkey // {KEYS_PER_FILE} FROM orders))
  SELECT ROUND(SUM(n) / 1048576.0, 2) AS file_size_mb FROM lines""")

# Records in the order they are written, a click before the record it holds.
SHOWN = f"""(SELECT event_id, user_id, shown_type, nested, CASE WHEN shown_type = 'click'
    THEN substr(xml, 1, length(xml) - 3) || '>' || replace(xml, 'type="click"', 'type="inner"') || '</Record>' ELSE xml END AS xml
  FROM (SELECT event_id, user_id, shown_type, nested, {RECORD_XML} AS xml FROM (
    SELECT *, event_type AS shown_type, 0 AS nested FROM events
    UNION ALL SELECT *, 'inner', 1 FROM events WHERE event_type = 'click')))"""
IN_FILE = "ORDER BY event_id, nested"  # files are cut by ranges of the key


def _as_xml(search):
    def run(spark, sf_dir):
        found = export_elements(spark, sf_dir)
        return rawxml.as_xml(found, search(found)).select("xml")
    return run


query("xml_search", _as_xml(lambda e: rawxml.search_elements(e, "USER_3", 50)),
      f"""SELECT xml FROM {SHOWN} WHERE user_id % 10 = 3 {IN_FILE} LIMIT 50""")
query("xml_by_type", _as_xml(lambda e: rawxml.elements_by_type(e, "error", 20)),
      f"""SELECT xml FROM {SHOWN} WHERE shown_type = 'error' {IN_FILE} LIMIT 20""")
query("xml_nested", _as_xml(lambda e: rawxml.elements_by_type(e, "click", 30)),
      f"""SELECT xml FROM {SHOWN} WHERE shown_type = 'click' {IN_FILE} LIMIT 30""")
query("xml_search_hits",
      lambda s, d: rawxml.hit_count(rawxml.search_elements(export_elements(s, d), "hkworkout5")),
      """SELECT COUNT(*) AS hits FROM (SELECT * FROM orders WHERE o_orderpriority LIKE '5%' LIMIT 50)""")


# --- normalisation rules -------------------------------------------------------------------
def _raw_events(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in raw_event_attributes()])


def _zones(spark, sf_dir):
    wall = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    zone = F.element_at(F.array(*map(F.lit, [" -0400", " +05:30", " Z"])), (F.col("user_id") % 3 + 1).cast("int"))
    return _events(spark, sf_dir).withColumn("text", F.concat(wall, zone))


query("norm_dates",
      lambda s, d: _zones(s, d).select("event_id", parse_date_strict(F.col("text")).alias("startDate")),
      """SELECT event_id, CAST(date_trunc('second', ts) + CASE user_id % 3 WHEN 0 THEN INTERVAL 4 HOUR
      WHEN 1 THEN INTERVAL (-330) MINUTE ELSE INTERVAL 0 HOUR END AS TIMESTAMP) AS "startDate" FROM events""")
query("norm_dates_lenient",
      lambda s, d: _zones(s, d).select("event_id", lenient_iso_text(
          F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("text"))).alias("text")),
      """SELECT event_id, CASE WHEN event_type = 'error' THEN props
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S')
           || CASE user_id % 3 WHEN 0 THEN '-04:00' WHEN 1 THEN '+05:30' ELSE '+00:00' END END AS text
      FROM events""")


def _number_texts(spark, sf_dir):
    written, kind = F.col("value").cast("string"), F.col("event_type")
    text = (F.when(kind == "click", F.concat(F.lit(" "), written, F.lit("\t")))
            .when(kind == "view", F.concat(written, F.lit("d")))
            .when(kind == "purchase", F.concat(F.lit("1_0"), written))
            .when(kind == "signup", F.concat(F.lit("-"), written, F.lit("e2")))
            .otherwise(F.col("props")))
    return _events(spark, sf_dir).select("event_id", safe_float(text).alias("number"))


query("safe_float", _number_texts,
      """SELECT event_id, CAST(CASE event_type WHEN 'click' THEN value
      WHEN 'purchase' THEN CAST('10' || CAST(value AS VARCHAR) AS DOUBLE)
      WHEN 'signup' THEN CAST('-' || CAST(value AS VARCHAR) || 'e2' AS DOUBLE)
      ELSE 0.0 END AS DOUBLE) AS number FROM events""")
query("norm_defaults",
      lambda s, d: normalize.fill_record_defaults(_raw_events(s, d)).select(
          "event_id", "unit", "sourceVersion", "device", "value"),
      f"""SELECT event_id, CASE WHEN event_type <> 'error' THEN 'count' ELSE '' END AS unit,
      CASE WHEN event_type = 'click' THEN '9.1' ELSE '' END AS "sourceVersion",
      CASE WHEN user_id % 3 = 0 THEN '<<HKDevice>, name:Watch>' ELSE '' END AS device,
      {VALUE_TEXT} AS value FROM events""")
query("norm_text",
      lambda s, d: normalize.keep_value_text(normalize.fill_record_defaults(_raw_events(s, d)))
      .select("event_id", "value", "textValue"),
      f"""SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 0.0 ELSE value END AS value,
      {VALUE_TEXT} AS "textValue" FROM events""")


query("norm_narrow",
      lambda s, d: normalize.narrowed(event_records(s, d)).select(
          "record_id", F.col("value").cast("double").alias("value"), "startDate"),
      """SELECT event_id AS record_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
      CAST(date_trunc('second', ts) AS TIMESTAMP) AS "startDate" FROM events""")


def _raw_stats(spark, sf_dir):
    source = stats(spark, sf_dir)
    written = F.date_format("startDate", "yyyy-MM-dd HH:mm:ss")
    return source.select(
        "type", F.concat(written, F.lit(" +0000")).alias("startDate"), F.lit(None).cast("string").alias("endDate"),
        F.when(F.col("type") != "N", F.col("sum").cast("string")).alias("sum"),
        F.lit(None).cast("string").alias("average"), F.col("maximum").cast("string").alias("maximum"),
        F.lit(None).cast("string").alias("minimum"), "unit")


STATS_NORM = """SELECT l_returnflag AS type, l_shipdate AS "startDate", CAST(NULL AS TIMESTAMP) AS "endDate",
  CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE {absent} END AS "sum",
  CAST({absent} AS DOUBLE) AS average, l_extendedprice AS maximum, CAST({absent} AS DOUBLE) AS minimum,
  l_linestatus AS unit FROM lineitem"""
query("norm_stats_defaults", lambda s, d: normalize.stats(_raw_stats(s, d)),
      STATS_NORM.format(absent="CAST(0.0 AS DOUBLE)"))
query("norm_stats_keep_null", lambda s, d: normalize.stats(_raw_stats(s, d), absent=None),
      STATS_NORM.format(absent="NULL"))


# --- routing -------------------------------------------------------------------------------
def _as_table(df: DataFrame, schema) -> DataFrame:
    return normalize.fit(df, schema)


def _route_by_schema(spark, sf_dir):
    """Frames of all three tables in mixed column order, counted by the table they end up in."""
    r = _as_table(event_records(spark, sf_dir), schemas.RECORDS)
    o = _as_table(order_records(spark, sf_dir), schemas.RECORDS)
    w = _as_table(workouts(spark, sf_dir), schemas.WORKOUTS)
    t = _as_table(stats(spark, sf_dir), schemas.STATS)
    frames = [t, r.select(*reversed(r.columns)), w, o, pages(spark, sf_dir)]
    routed = route_by_schema(frames)
    counts = [df.groupBy("type").agg(F.count(F.lit(1)).alias("count"))
              .withColumn("table", F.lit(name)) for name, df in routed.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


query("route_by_schema", _route_by_schema,
      """SELECT 'records' AS "table", event_type AS type, COUNT(*) AS "count" FROM events GROUP BY event_type
      UNION ALL SELECT 'records', o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority
      UNION ALL SELECT 'workouts', o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority
      UNION ALL SELECT 'stats', l_returnflag, COUNT(*) FROM lineitem GROUP BY l_returnflag""")


def _route_by_prefix(spark, sf_dir):
    named = F.concat(F.lit(WORKOUT_PREFIX), F.col("type")).alias("type")
    types = event_records(spark, sf_dir).select("type").unionByName(workouts(spark, sf_dir).select(named))
    return (types.withColumn("table", F.when(F.col("type").startswith(WORKOUT_PREFIX), "workouts")
                             .otherwise("records"))
            .groupBy("table", "type").agg(F.count(F.lit(1)).alias("count")))


query("route_by_prefix", _route_by_prefix,
      """SELECT 'records' AS "table", event_type AS type, COUNT(*) AS "count" FROM events GROUP BY event_type
      UNION ALL SELECT 'workouts', 'HKWorkout' || o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority""")


# --- stored tables -------------------------------------------------------------------------
def _import_counts(spark, sf_dir):
    """Rows written per table, as the import counted them while writing."""
    target = scratch_dir(spark, "import")
    counts = import_export(spark, export_path(spark, sf_dir), target)
    return spark.createDataFrame(sorted(counts.items()), "`table` string, `rows` bigint")


query("ingest_counts", _import_counts,
      f"""SELECT 'records' AS "table", COUNT(*) AS "rows" FROM ({RECORDS})
      UNION ALL SELECT 'workouts', COUNT(*) FROM orders
      UNION ALL SELECT 'stats', COUNT(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")


def _import_twice(spark, sf_dir):
    """A repeated import replaces the tables."""
    target = Tables(scratch_dir(spark, "import"))
    for layout in ("sorted", "plain"):
        import_export(spark, export_path(spark, sf_dir), target.root, layout=layout)
    return target.read(spark, "records")


query("ingest_repeated", _import_twice, RECORDS)


def _failed_import(spark, sf_dir):
    """An import that fails half way leaves the tables of the one before."""
    target = Tables(scratch_dir(spark, "import"))
    import_export(spark, export_path(spark, sf_dir), target.root)
    bad = scratch_dir(spark, "malformed")
    cut_short = table(spark, sf_dir, "events", EVENTS).select(
        F.concat(F.lit('<HealthData><Record type="'), F.col("event_type"), F.lit('" startDate="soon"/>')).alias("text"))
    cut_short.write.text(bad)
    try:
        import_export(spark, bad, target.root)
    except (ValueError, PySparkException):
        return target.read(spark, "records")
    raise AssertionError("a malformed export was imported")


query("ingest_failed_import", _failed_import, RECORDS)


# How a file of records ends: well, or with something a parser refuses.
_ENDINGS = ("</HealthData>", "<a><x></y><y></x></a></HealthData>", "</HealthData><G></G>", '</HealthData><Record type="late"/>',
            "<Record type=bare/></HealthData>", '<Record type "none"/></HealthData>', '<Record type="a"unit="b"/></HealthData>', "</HealthData> text")
_PARTS = 24


def _dealt_files(spark, sf_dir, n, path, endings):
    """The events dealt out into ``n`` files, each ending with one of ``endings``; returns the numbers of the files."""
    lines = record_lines(table(spark, sf_dir, "events", EVENTS)).withColumn("part", (F.col("key") % n).cast("int"))
    parts = lines.select("part").distinct()
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), F.col("part") % len(endings) + 1)
    columns = ["part", "section", "key", "sub", "tie", "text"]
    frames = [parts.select("part", F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("sub"), F.lit("").alias("tie"),
                           text.alias("text")) for section, text in ((0, F.lit(FILE_ENDS[0][0])), (3, ending))]
    (lines.select(columns).union(frames[0]).union(frames[1]).repartition("part")
     .sortWithinPartitions(*columns[:-1]).select("part", "text").write.partitionBy("part").text(path))
    return parts


def _malformed(spark, sf_dir):
    """Files of events, seven of eight of which are malformed: which are refused."""
    path = scratch_dir(spark, "malformed")
    parts = _dealt_files(spark, sf_dir, _PARTS, path, _ENDINGS)
    told = malformed_files(spark, path).select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("int").alias("part"), F.lit(True).alias("refused")).distinct()
    return parts.join(told, "part", "left").select("part", F.coalesce("refused", F.lit(False)).alias("refused"))


query("ingest_malformed", _malformed, f"""SELECT DISTINCT CAST(event_id % {_PARTS} AS INTEGER) AS part,
  event_id % {_PARTS} % {len(_ENDINGS)} <> 0 AS refused FROM events""")


def _append(spark, sf_dir):
    path = scratch_dir(spark, "append")
    for df in (event_records(spark, sf_dir), order_records(spark, sf_dir)):
        sinks.append(_as_table(df, schemas.RECORDS), path)
    return (read_parquet(spark, path, schemas.RECORDS)
            .select("type", "sourceName", "startDate", "unit", "value", "textValue"))


query("ingest_append", _append,
      """SELECT event_type AS type, 'user_' || CAST(user_id % 10 AS VARCHAR) AS "sourceName", ts AS "startDate",
      'u' AS unit, value, props AS "textValue" FROM events
      UNION ALL SELECT o_orderpriority, o_orderstatus, o_orderdate, 'usd', o_totalprice,
      CAST(o_totalprice AS VARCHAR) FROM orders""")


def _append_new(spark, sf_dir):
    """What is stored already is not added again; the rest is."""
    path = scratch_dir(spark, "append-new")
    rows = order_records(spark, sf_dir)
    sinks.append(rows.filter("sourceName = 'F'"), path)
    sinks.append_new(rows, path, within="startDate")
    sinks.append_new(rows, path)
    return read_parquet(spark, path, rows.schema)


query("ingest_append_new", _append_new,
      sql.with_views(sql.ORDER_RECORDS) + "SELECT * FROM records")


def _roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "roundtrip")
    rows = event_records(spark, sf_dir)
    sinks.write_parquet(rows, path)
    return read_parquet(spark, path, rows.schema)


EVENT_ROWS = sql.with_views(sql.EVENT_RECORDS) + "SELECT * FROM records"
query("roundtrip_parquet", _roundtrip, EVENT_ROWS)


def _sorted_layout(spark, sf_dir):
    path = scratch_dir(spark, "sorted")
    rows = event_records(spark, sf_dir)
    emptied = rows.withColumn("type", F.when(F.col("type") == "error", "").otherwise(F.col("type")))
    sinks.write_sorted(emptied, path, by_type=True)
    return sinks.read_by_type(spark, path, rows.schema)


query("sorted_layout", _sorted_layout, sql.with_views(sql.EVENT_RECORDS) + """
  SELECT * REPLACE (CASE WHEN type = 'error' THEN '' ELSE type END AS type) FROM records""")


def _compact(spark, sf_dir):
    """Chunks written one by one, then united."""
    base = scratch_dir(spark, "chunks")
    rows = _as_table(event_records(spark, sf_dir), schemas.RECORDS)
    more = _as_table(order_records(spark, sf_dir), schemas.RECORDS)
    for n, chunk in enumerate((rows, more)):
        sinks.write_parquet(chunk, f"{base}/chunk-{n}")
    chunks = [read_parquet(spark, f"{base}/chunk-{n}", schemas.RECORDS) for n in range(2)]
    sinks.compact(chunks, f"{base}/table")
    return (read_parquet(spark, f"{base}/table", schemas.RECORDS)
            .select("type", "sourceName", "startDate", "unit", "value", "textValue"))


query("compact_chunks", _compact, ORACLES["ingest_append"])


def _compact_imports(spark, sf_dir):
    """An import for each of a few files, then all united, however large the tables make them: the same records from one folder."""
    source, target = scratch_dir(spark, "small_files"), scratch_dir(spark, "compact_imports")
    _dealt_files(spark, sf_dir, 4, source, _ENDINGS[:1])
    for part in [n for n in files.names(spark, source) if n.startswith("part=")]:
        import_export(spark, f"{source}/{part}", target, mode="append")
    before = len(Tables(target).imports(spark))
    stored = files.size(spark, target)
    if compact_imports(spark, target, below=stored + 1) != before or len(Tables(target).imports(spark)) != 1:
        raise AssertionError("small imports are left")
    return Tables(target).read(spark, "records")


query("compact_imports", _compact_imports, RECORDS)


def _incremental(spark, sf_dir):
    """Micro-batches of four files, then a second run that finds nothing new."""
    base = scratch_dir(spark, "incremental")
    source, target, checkpoints = export_path(spark, sf_dir), f"{base}/target", f"{base}/checkpoints"
    for _ in range(2):
        ingest.import_new_files(spark, source, target, checkpoints, max_files=4)
    found = {"records": ingest.read_records(spark, target), "workouts": ingest.read_workouts(spark, target),
             "stats": ingest.read_stats(spark, target)}
    parts = [df.groupBy("type").agg(F.count(F.lit(1)).alias("count"), F.min("startDate").alias("first"),
                                    F.max("startDate").alias("last")).withColumn("table", F.lit(name))
             for name, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


query("ingest_incremental", _incremental, f"""
  SELECT 'records' AS "table", type, COUNT(*) AS "count", MIN("startDate") AS first, MAX("startDate") AS last
  FROM ({RECORDS}) GROUP BY type
  UNION ALL SELECT 'workouts', type, COUNT(*), MIN("startDate"), MAX("startDate") FROM ({WORKOUTS}) GROUP BY type
  UNION ALL SELECT 'stats', type, COUNT(*), MIN("startDate"), MAX("startDate") FROM ({STATS}) GROUP BY type""")


def _samples(spark, sf_dir):
    """Weekly samples that micro-batches of four files add up to."""
    base = scratch_dir(spark, "samples")
    samples.sample_new_files(spark, export_path(spark, sf_dir), f"{base}/target", f"{base}/checkpoint",
                             "week", SCALE, max_files=4)
    return samples.read_samples(spark, f"{base}/target", SCALE)


def _incremental_counts(spark, sf_dir):
    """Rows a run reports, added up over its micro-batches of one file each."""
    base = scratch_dir(spark, "incremental")
    counts = ingest.import_new_files(spark, export_path(spark, sf_dir), f"{base}/target", f"{base}/checkpoints", max_files=1)
    return spark.createDataFrame(sorted(counts.items()), "`table` string, `rows` bigint")


query("ingest_incremental_counts", _incremental_counts, ORACLES["ingest_counts"])


def _catalog(spark, sf_dir):
    """Catalog tables created, filled twice, emptied and filled again."""
    database = f"vitalog_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_dir(spark, 'catalog')}'")
    try:
        sinks.create_tables(spark, database)
        rows = _as_table(event_records(spark, sf_dir), schemas.RECORDS)
        sinks.append_to_table(rows, f"{database}.records")
        sinks.truncate_table(spark, f"{database}.records")
        sinks.append_to_table(rows, f"{database}.records")
        kept = scratch_dir(spark, "from-catalog")
        sinks.write_parquet(read_table(spark, f"{database}.records"), kept)
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")
    return read_parquet(spark, kept, schemas.RECORDS).select("type", "sourceName", "startDate", "unit", "value", "textValue")


query("catalog_tables", _catalog, sql.with_views(sql.EVENT_RECORDS) + """
  SELECT type, "sourceName", "startDate", unit, value, "textValue" FROM records""")


def _stored_documents(spark, sf_dir):
    """Documents appended to a store and read back."""
    path = scratch_dir(spark, "documents")
    sinks.write_documents(markup.documents(export_elements(spark, sf_dir)), path)
    return spark.read.parquet(path).select(*DOC_COLUMNS, F.size("attrs").alias("n_attrs"))


query("stored_documents", _stored_documents, ORACLES["ingest_documents"])


def _delete_all(spark, sf_dir):
    """How many rows emptying a table removed, and how many are left."""
    path = scratch_dir(spark, "emptied")
    rows = event_records(spark, sf_dir)
    sinks.write_parquet(rows, path)
    removed = sinks.delete_all(spark, path, rows.schema)
    left = read_parquet(spark, path, rows.schema).count()
    return spark.createDataFrame([(removed, left)], "removed bigint, remaining bigint")


query("delete_all", _delete_all, 'SELECT COUNT(*) AS removed, CAST(0 AS BIGINT) AS remaining FROM events')

query("ingest_samples", _samples, f"""
  SELECT type, "sourceName", unit, CAST(date_trunc('week', "startDate") AS TIMESTAMP) AS "startDate",
  {sql.mean("value")} AS value, MIN(value) AS min_value, MAX(value) AS max_value, COUNT(value) AS n_values
  FROM ({RECORDS}) GROUP BY type, "sourceName", unit, date_trunc('week', "startDate")""")
