"""Values over calendar time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bucket, bucket_range, one_bucket
from ..functions.measures import measure_summary
from .filters import of_type


def trend(records: DataFrame, record_type: str | None = None, interval: str = "month",
          date_from=None, date_to=None, scale: int | None = None,
          tz: str | None = None) -> DataFrame:
    """Statistics of ``value`` per calendar bucket, type, source and unit, oldest bucket first.

    One partial aggregation on the filtered scan and one exchange of group rows; the final sort
    orders group rows only.
    """
    return (
        of_type(records, record_type, date_from, date_to)
        .groupBy("type", "sourceName", bucket(F.col("startDate"), interval, tz).alias("interval"), "unit")
        .agg(*measure_summary(F.col("value"), scale))
        .select("type", "sourceName", "interval", "average", "sum", "min", "max", "count", "unit")
        .orderBy("interval")
    )


def trend_device(records: DataFrame, record_type: str | None = None, interval: str = "month",
                 date_from=None, date_to=None, scale: int | None = None,
                 tz: str | None = None) -> DataFrame:
    """Statistics of ``value`` per calendar bucket and device, oldest bucket first."""
    return (
        of_type(records, record_type, date_from, date_to)
        .groupBy("device", bucket(F.col("startDate"), interval, tz).alias("interval"))
        .agg(*measure_summary(F.col("value"), scale))
        .select("device", "interval", "average", "sum", "min", "max", "count")
        .orderBy("interval")
    )


def fill_gaps(buckets: DataFrame, interval: str, keys: tuple[str, ...] = ("type",),
              at: str = "date", zero: tuple[str, ...] = ("count", "value_sum")) -> DataFrame:
    """Add the empty calendar buckets between the first and the last one of each group.

    ``buckets`` must already hold one row per group and bucket: a group then has at most as many
    rows as the calendar has buckets, however many records there were. Each row is repeated up
    to the next existing bucket; repeats carry 0 in ``zero`` and NULL in the other statistics.
    """
    following = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    last_missing = F.when(following.isNotNull(), following - one_bucket(interval)).otherwise(F.col(at))
    values = [c for c in buckets.columns if c not in (*keys, at)]
    spread = (
        buckets.withColumn("_until", last_missing)
        .select("*", F.posexplode(bucket_range(F.col(at), F.col("_until"), interval)).alias("_n", "_at"))
    )
    present = F.col("_n") == 0
    return spread.select(
        *keys, F.col("_at").alias(at),
        *[F.when(present, F.col(c)).otherwise(F.lit(0 if c in zero else None)
                                              .cast(buckets.schema[c].dataType)).alias(c)
          for c in values],
    )


def trend_gapfilled(records: DataFrame, record_type: str | None = None, interval: str = "month",
                    date_from=None, date_to=None, scale: int | None = None) -> DataFrame:
    """Calendar histogram: statistics per type and bucket, empty buckets included.

    Rows without a type or a start time belong to no bucket. ``count`` counts values.
    """
    rows = of_type(records, record_type, date_from, date_to).filter(
        F.col("type").isNotNull() & F.col("startDate").isNotNull())
    value = F.col("value")
    names = {"average": "avg_value", "min": "min_value", "max": "max_value", "sum": "value_sum"}
    statistics = [c for c in measure_summary(value, scale, names)][1:]
    per_bucket = (
        rows.groupBy("type", bucket(F.col("startDate"), interval).alias("date"))
        .agg(*statistics, F.count(value).alias("count"))
        .withColumn("value_sum", F.coalesce("value_sum", F.lit(0.0)))
    )
    return fill_gaps(per_bucket, interval).orderBy("type", "date")
