"""The driver's tables written as export files, so that the XML sources have input of any size.

``events`` become ``Record`` elements (some inside ``Correlation``, some with children), ``orders``
become ``Workout`` elements and ``lineitem`` the ``WorkoutStatistics`` inside them. Each file is a
complete document; its lines are put in order by a sort inside the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import files
from ..operators.rawxml import escaped
from ..session import scratch_dir
from ..sources.landing import land_elements, landed_elements, shuffles_sized_for
from .views import EVENTS, LINEITEM, ORDERS, table

# Files are cut by key, so their number and not their size grows with the tables.
KEYS_PER_FILE = 20_000
# Text made of a stored byte of the tables, about; sizes the shuffle only.
TEXT_PER_BYTE = 10
_WRITTEN: dict[tuple, str] = {}


def _attribute(name: str, value: Column) -> Column:
    """`` name="value"``, or nothing when the value is NULL."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), escaped(value), F.lit('"')), F.lit(""))


def _plain(name: str, value: Column) -> Column:
    """The same for a value that holds nothing to be escaped."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), value, F.lit('"')), F.lit(""))


def _element(tag: str, *attributes: Column, end: str = "/>") -> Column:
    return F.concat(F.lit(f"<{tag}"), *attributes, F.lit(end))


def export_date(at: Column, offset: str) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" " + offset))


def _part(key: Column) -> Column:
    return F.format_string("f%012d", F.floor(key / KEYS_PER_FILE)).alias("part")


def _line(key: Column, section: int, sub: int, tie: Column) -> list[Column]:
    """The file of a line and its place in that."""
    return [_part(key), F.lit(section).alias("section"), key.alias("key"), F.lit(sub).alias("sub"), tie.cast("string").alias("tie")]


def raw_event_attributes() -> list[tuple[str, Column]]:
    """An event's attributes as text; NULL where the element leaves one out."""
    kind, at = F.col("event_type"), export_date(F.col("ts"), "-0400")
    return [
        ("type", kind),
        ("sourceName", F.concat(F.lit("user_"), (F.col("user_id") % 10).cast("string"))),
        ("sourceVersion", F.when(kind == "click", F.lit("9.1"))),
        ("device", F.when(F.col("user_id") % 3 == 0, F.lit("<<HKDevice>, name:Watch>"))),
        ("unit", F.when(kind != "error", F.lit("count"))),
        ("creationDate", at), ("startDate", at), ("endDate", at),
        ("value", F.when(kind == "error", F.col("props"))
         .when(kind != "signup", F.col("value").cast("string"))),
    ]


def _record_text() -> Column:
    kind = F.col("event_type")
    attributes = [_attribute(n, c) if n in ("type", "device", "value") else _plain(n, c) for n, c in raw_event_attributes()]
    inner = [_plain("type", F.lit("inner")), *attributes[1:]]
    # What differs stands around the same attributes, which are written once.
    before = (F.when(kind == "purchase", F.concat(_element("Correlation", _attribute("type", kind), end=">"), F.lit("<Record")))
              .otherwise(F.lit("<Record")))
    behind = (F.when(kind == "purchase", F.lit("/></Correlation>"))
              .when(kind == "click", F.concat(F.lit(">"), _element("Record", *inner), F.lit("</Record>")))
              .when(kind == "view", F.lit('>\n <MetadataEntry key="k" value="v"/>\n</Record>'))
              .otherwise(F.lit("/>")))
    return F.concat(before, *attributes, behind)


def record_lines(events: DataFrame) -> DataFrame:
    return events.select(*_line(F.col("event_id"), 1, 0, F.lit("")), _record_text().alias("text"))


def _workout_text() -> Column:
    at = export_date(F.col("o_orderdate"), "+0000")
    duration = (F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("abc"))
                .when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("string")))
    return _element(
        "Workout",
        _attribute("workoutActivityType", F.concat(F.lit("HKWorkout"), F.col("o_orderpriority"))),
        _plain("duration", duration), _plain("durationUnit", F.lit("min")), _attribute("sourceName", F.col("o_orderstatus")),
        _plain("creationDate", at), _plain("startDate", at), _plain("endDate", at), end=">")


def _stat_text() -> Column:
    at = export_date(F.col("l_shipdate"), "+0000")
    return _element(
        "WorkoutStatistics", _attribute("type", F.col("l_returnflag")), _plain("startDate", at), _plain("endDate", at),
        _plain("sum", F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("string"))),
        _plain("maximum", F.col("l_extendedprice").cast("string")), _attribute("unit", F.col("l_linestatus")))


# The first and the last line of every file, and their sections.
FILE_ENDS = (("<?xml version=\"1.0\" encoding=\"UTF-8\"?>\n<!DOCTYPE HealthData [\n"
              "<!-- <Record type=\"in a comment\"> -->\n]>\n<HealthData locale=\"en_US\">", 0), ("</HealthData>", 3))


# What lines are written from, and the names under which rows of all tables share columns on their way to their file.
_EVENT = {"ts": "at", "event_type": "name", "props": "note", "user_id": "user", "value": "number"}
_ORDER = {"o_orderdate": "at", "o_orderpriority": "name", "o_orderstatus": "note", "o_totalprice": "number"}
_LINEITEM = {"l_shipdate": "at", "l_returnflag": "name", "l_linestatus": "note", "l_quantity": "number", "l_extendedprice": "price"}
_SHARED = {"at": "timestamp", "name": "string", "note": "string", "user": "bigint", "number": "double", "price": "double"}
PLACE = ["part", "section", "key", "sub", "tie"]


def _rows(df: DataFrame, place: list[Column], columns: dict[str, str]) -> DataFrame:
    held = {shared: own for own, shared in columns.items()}
    return df.select(*place, *[(F.col(held[c]) if c in held else F.lit(None)).cast(kind).alias(c) for c, kind in _SHARED.items()])


def write_files(events: DataFrame, orders: DataFrame, lineitem: DataFrame, path: str, compression: str) -> None:
    """One complete document per part: a root element around the lines, in order.

    Rows go to their files once, as they are stored, and become text there. A statistic is written where its workout is, which has the same key
    and so is in the same file.
    """
    order, item = F.col("o_orderkey"), F.col("l_orderkey")
    body = (_rows(events, _line(F.col("event_id"), 1, 0, F.lit("")), _EVENT)
            .unionByName(_rows(orders, _line(order, 2, 0, F.lit("")), _ORDER))
            .unionByName(_rows(orders, _line(order, 2, 2, F.lit("")), {}))
            .unionByName(_rows(lineitem, _line(item, 2, 1, F.col("l_linenumber")), _LINEITEM)))
    frame = events.select(_part(F.col("event_id"))).union(orders.select(_part(order))).distinct()
    ends = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("sub"), F.lit("").alias("tie"))
                     for _, section in FILE_ENDS])
    framed = frame.select("part", F.inline(ends))
    body = body.unionByName(_rows(framed, [F.col(c) for c in PLACE], {}))

    of_workout = Window.partitionBy("part", "section", "key").orderBy("sub", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_workout = F.max((F.col("sub") == 0).cast("int")).over(of_workout) == 1
    placed = (body.repartition("part").withColumn("in_workout", in_workout & F.col("key").isNotNull())
              .filter((F.col("section") != 2) | (F.col("sub") != 1) | F.col("in_workout")))
    section, sub = F.col("section"), F.col("sub")
    text = F.lit(None).cast("string")
    for end, place in FILE_ENDS:
        text = F.when(section == place, F.lit(end)).otherwise(text)
    for columns, line, here in ((_EVENT, _record_text(), section == 1), (_ORDER, _workout_text(), (section == 2) & (sub == 0)),
                                (_LINEITEM, _stat_text(), (section == 2) & (sub == 1))):
        placed = placed.withColumns({own: F.col(shared) for own, shared in columns.items()})
        text = F.when(here, line).otherwise(text)
    text = F.when((section == 2) & (sub == 2), F.lit("</Workout>")).otherwise(text)
    (placed.sortWithinPartitions(*PLACE).select("part", text.alias("text"))
     .write.mode("append").option("compression", compression).option("zlib.compress.level", "BEST_SPEED").partitionBy("part").text(path))


def export_path(spark: SparkSession, sf_dir: str, compression: str = "gzip") -> str:
    """The tables as export files; written once per application.

    A file holds the text of ``KEYS_PER_FILE`` keys, about 20 MB, which one task reads whole anyway; compressed it takes a tenth of the disk.
    """
    key = (spark.sparkContext.applicationId, sf_dir, f"export {compression}")
    if key not in _WRITTEN:
        path = scratch_dir(spark, "export")
        events, orders, lineitem = (table(spark, sf_dir, n, s) for n, s in (("events", EVENTS), ("orders", ORDERS), ("lineitem", LINEITEM)))
        stored = sum(files.size(spark, f"{sf_dir}/{n}.parquet") for n in ("events", "orders", "lineitem"))
        with shuffles_sized_for(spark, TEXT_PER_BYTE * stored):
            write_files(events, orders, lineitem, path, compression)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def export_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of those files, landed once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, "elements")
    if key not in _WRITTEN:
        path = scratch_dir(spark, "elements")
        land_elements(spark, export_path(spark, sf_dir), path)
        _WRITTEN[key] = path
    return landed_elements(spark, _WRITTEN[key])
