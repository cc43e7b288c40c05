"""Questions about data quality and recency that the statistics invite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bucket
from ..functions.measures import full_total, whole_units
from .filters import of_type
from .sized_join import join_group_rows
from .trend import trend


def source_overlap(records: DataFrame, interval: str = "day", record_type: str | None = None) -> DataFrame:
    """Buckets in which several sources recorded the same type, so that sums may count twice.

    Counted as two nested group-bys, so no task ever holds the sources of a busy bucket.
    """
    per_source = (
        of_type(records, record_type)
        .groupBy(bucket(F.col("startDate"), interval).alias("interval"), "type", "sourceName")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (per_source.groupBy("interval", "type")
            .agg(F.count("sourceName").alias("n_sources"), F.sum("n").alias("n_records"))
            .filter(F.col("n_sources") > 1))


def last_week_daily(records: DataFrame, record_type: str | None = None, days: int = 7,
                    scale: int | None = None) -> DataFrame:
    """Daily trend over the last ``days`` days before the newest record.

    The newest instant is a scalar subquery, so it reaches the scan as a pushed-down bound.
    """
    wanted = of_type(records, record_type)
    newest = wanted.agg(F.max("startDate").alias("newest"))
    since = newest.select(F.col("newest") - F.expr(f"INTERVAL '{int(days)}' DAY")).scalar()
    return trend(wanted.filter(F.col("startDate") >= since), None, "day", scale=scale)


def downsample(records: DataFrame, interval: str = "day", scale: int | None = None) -> DataFrame:
    """One sample per type, source, unit and bucket: mean, range and number of values."""
    value = F.col("value")
    total = full_total(value, scale)
    return (
        records.groupBy("type", "sourceName", "unit",
                        bucket(F.col("startDate"), interval).alias("startDate"))
        .agg((total / F.nullif(F.count(value), F.lit(0))).alias("value"),
             F.min(value).alias("min_value"),
             F.max(value).alias("max_value"),
             F.count(value).alias("n_values"))
    )


def outliers(records: DataFrame, z: float = 3.0, record_type: str | None = None,
             scale: int | None = None) -> DataFrame:
    """Records further than ``z`` sample standard deviations from their type's mean.

    Only finite values take part; ``nan`` and ``inf`` are neither counted nor returned, and a type whose values are
    all equal has no outliers. With ``scale`` the moments are summed as whole units, so that the result does not depend
    on the order of the partial sums. Runs the first pass when called (see :func:`join_group_rows`).
    """
    value = F.col("value")
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    rows = of_type(records, record_type).filter(finite)
    plain = [F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("sd_value")]
    if scale is None:
        per_type = rows.groupBy("type").agg(*plain)
    else:
        largest = F.max(F.abs(value)) * F.lit(float(10 ** scale))
        units = F.when(F.abs(value) < F.lit(_SQUARED_UNITS / 10 ** scale), whole_units(value, scale)).cast("decimal(18,0)")
        sums = rows.groupBy("type").agg(
            *plain, largest.alias("_largest"), F.count(value).alias("_n"), F.sum(units).alias("_s1"),
            F.sum((units * units).cast("decimal(28,0)")).alias("_s2"))
        exact = F.col("_largest") < F.lit(_SQUARED_UNITS)
        mean, deviation = _moments(scale)
        per_type = sums.select("type", F.when(exact, mean).otherwise(F.col("mean_value")).alias("mean_value"),
                               F.when(exact, deviation).otherwise(F.col("sd_value")).alias("sd_value"))
    joined = join_group_rows(rows, per_type, ["type"])
    distance = (value - F.col("mean_value")) / F.col("sd_value")
    return (joined.filter((F.col("sd_value") > 0) & ~F.isnan("sd_value"))
            .withColumn("z", distance)
            .filter(F.abs("z") > F.lit(float(z))))


# Values of fewer whole units are squared and summed exactly; a type with larger ones uses doubles.
_SQUARED_UNITS = 1e13


def _moments(scale: int) -> tuple[Column, Column]:
    """Mean and sample standard deviation from count, sum and sum of squares in whole units.

    With the whole part q of the mean and the rest r, the squared distances from q add up to s2 - q (s1 + r), in
    DECIMAL and so without cancellation; what the mean has beyond q takes r^2 / n off again.
    """
    n, unit = F.col("_n"), F.lit(float(10 ** scale))
    q = F.expr("CAST(_s1 div _n AS DECIMAL(18,0))")
    r = (F.col("_s1") - q * n).cast("decimal(20,0)")
    squares = F.col("_s2") - (q * (F.col("_s1") + r)).cast("decimal(38,0)")
    spread = squares.cast("double") - r.cast("double") * r.cast("double") / n
    variance = F.greatest(spread, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))
    return F.col("_s1").cast("double") / n / unit, F.sqrt(variance) / unit
