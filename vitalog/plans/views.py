"""The driver's tables in the shape of the engine's tables.

Files are read with an explicit schema of just the needed columns. Times are stored without a
zone; reading them as TIMESTAMP takes them as UTC and keeps date filters pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
ORDERS = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
          "o_orderdate timestamp, o_orderpriority string")
LINEITEM = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
            "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
            "l_returnflag string, l_linestatus string, l_shipdate timestamp")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"

# All measures in the tables have two decimals.
SCALE = 2


def table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    configure(spark)
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as records over one month."""
    return table(spark, sf_dir, "events", EVENTS).select(
        F.col("event_id").alias("record_id"),
        F.col("event_type").alias("type"),
        F.lit("").alias("sourceVersion"),
        F.concat(F.lit("user_"), (F.col("user_id") % 10).cast("string")).alias("sourceName"),
        F.concat(F.lit("dev_"), (F.col("user_id") % 3).cast("string")).alias("device"),
        F.col("ts").alias("startDate"),
        F.col("ts").alias("endDate"),
        F.col("ts").alias("creationDate"),
        F.lit("u").alias("unit"),
        F.col("value"),
        F.col("props").alias("textValue"),
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as records over several years."""
    return table(spark, sf_dir, "orders", ORDERS).select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_orderstatus").alias("sourceName"),
        F.lit("dev").alias("device"),
        F.col("o_orderdate").alias("startDate"),
        F.lit("usd").alias("unit"),
        F.col("o_totalprice").alias("value"),
        F.col("o_totalprice").cast("string").alias("textValue"),
    )


def workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as workouts."""
    return table(spark, sf_dir, "orders", ORDERS).select(
        F.col("o_orderkey").alias("workout_id"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_totalprice").alias("duration"),
        F.lit("min").alias("durationUnit"),
        F.col("o_orderstatus").alias("sourceName"),
        F.col("o_orderdate").alias("startDate"),
    )


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as workout statistics; the order is the workout they belong to."""
    return table(spark, sf_dir, "lineitem", LINEITEM).select(
        F.col("l_orderkey").alias("workout_id"),
        F.col("l_returnflag").alias("type"),
        F.col("l_shipdate").alias("startDate"),
        F.col("l_quantity").alias("sum"),
        F.col("l_extendedprice").alias("maximum"),
        F.col("l_linestatus").alias("unit"),
    )


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as documents."""
    return table(spark, sf_dir, "events", EVENTS).select(
        F.col("event_id").alias("record_id"),
        F.col("event_type").alias("type"),
        F.concat(F.lit("user "), (F.col("user_id") % 10).cast("string")).alias("sourceName"),
        F.col("props").alias("textvalue"),
        F.col("value"),
        F.col("ts").alias("dateComponents"),
    )


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as documents without a date; the type names language and source."""
    return table(spark, sf_dir, "documents", DOCUMENTS).select(
        F.col("doc_id"),
        F.concat(F.col("lang"), F.lit("/"), F.col("source")).alias("type"),
        F.col("source").alias("sourceName"),
        F.col("text").alias("textvalue"),
        F.col("n_chars").cast("double").alias("value"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", PAGES)


def without_zone(df: DataFrame) -> DataFrame:
    """Times as zone-less UTC wall clock, the form the tables themselves use."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
