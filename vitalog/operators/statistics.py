"""Statistics of record values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import measure_summary
from ..functions.numeric import is_python_float
from .filters import of_type


def numeric_rows(records: DataFrame) -> DataFrame:
    """Records whose value was written as a number; text values are stored as 0.0 otherwise."""
    return records.filter(is_python_float(F.col("textValue")))


def stats_records(records: DataFrame, record_type: str | None = None, scale: int | None = None,
                  numeric_only: bool = False) -> DataFrame:
    """count, average, sum, min and max of ``value`` per type and unit.

    Text values take part as 0.0, as they are stored, unless ``numeric_only`` is set.
    """
    rows = numeric_rows(records) if numeric_only else records
    return (
        of_type(rows, record_type)
        .groupBy("type", "unit").agg(*measure_summary(F.col("value"), scale))
        .withColumn("stat_type", F.col("type"))
        .select("type", "stat_type", "count", "average", "sum", "min", "max", "unit")
    )


def stats_by_type(records: DataFrame, record_type: str | None = None,
                  scale: int | None = None) -> DataFrame:
    """As :func:`stats_records` with one row per type, whatever the units."""
    return (of_type(records, record_type)
            .groupBy("type").agg(*measure_summary(F.col("value"), scale)))


def stats_sources(records: DataFrame, record_type: str | None = None) -> DataFrame:
    """How many records of a type each source contributed, largest first."""
    return (of_type(records, record_type)
            .groupBy("type", "sourceName").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("type", F.desc("count"), F.asc_nulls_last("sourceName")))
