"""Exact quantiles of groups of any size, by counting in ever narrower ranges of values.

A round cuts the range that holds a group's wanted rank into ``STEPS`` equal parts, counts the values of each (combined inside the tasks), and goes on
with the part the rank falls into, narrowed to the values that occur there. Counts, minima and maxima merge in any order, so no task ever holds a
group's values, and after a few rounds smallest and largest value of the range are the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .filters import of_type
from .sized_join import join_group_rows

STEPS = 256
#: Median distance of normally distributed values from their median, in standard deviations, inverted.
NORMAL = 1.4826


def exact_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, median): the middle value of each group, or halfway between the two middle ones; null, nan and infinite values don't count.

    Runs a pass over ``rows`` per round when called, three to five for values spread over a few powers of ten.
    """
    finite = rows.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')")
    groups = finite.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    middle = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    ranks = checkpointed(groups.select(*keys, F.posexplode(middle).alias("which", "rank"), "low", "high"))
    found = ranks.filter("low = high")
    while True:
        open_ = ranks.filter("low < high")
        if open_.isEmpty():
            break
        held = join_group_rows(finite, open_, keys).filter("v BETWEEN low AND high")
        # halves, as the whole range may be more than a double holds
        part = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        step = F.least(F.floor(part * STEPS), F.lit(STEPS - 1)).alias("step")
        counted = held.groupBy(*keys, "which", "rank", step).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        along = Window.partitionBy(*keys, "which").orderBy("step")  # at most STEPS rows
        before = counted.withColumn("before", F.sum("n").over(along) - F.col("n"))
        ranks = checkpointed(before.filter("rank >= before AND rank < before + n").select(*keys, "which", (F.col("rank") - F.col("before")).alias("rank"), "low", "high"))
        found = found.union(ranks.filter("low = high"))
    ends = found.groupBy(*keys).agg(F.min("low").alias("a"), F.max("low").alias("b"))
    return ends.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("median"))


def robust_outliers(records: DataFrame, z: float = 3.5, record_type: str | None = None) -> DataFrame:
    """Records further than ``z`` robust deviations from their type's median.

    The deviation is the median distance from the median (MAD) times 1.4826, the standard deviation where values are normal. Neither moves when a few values
    are extreme, which hide one another from :func:`~vitalog.operators.insights.outliers`. Null, nan and infinite values take no part; a type of which more than
    half the values are equal has no deviation and no outliers. Adds ``median_value``, ``mad_value`` and ``robust_z``. Runs the passes for the medians when called.
    """
    value = F.col("value")
    rows = of_type(records, record_type).filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))
    medians = checkpointed(exact_medians(rows, ["type"], "value").withColumnRenamed("median", "median_value"))
    away = join_group_rows(rows.select("type", "value"), medians, ["type"]).select("type", F.abs(value - F.col("median_value")).alias("away"))
    spread = exact_medians(away, ["type"], "away").withColumnRenamed("median", "mad_value")
    told = join_group_rows(rows, medians.join(spread, "type"), ["type"])
    distance = (value - F.col("median_value")) / (F.col("mad_value") * NORMAL)
    return told.filter("mad_value > 0").withColumn("robust_z", distance).filter(F.abs("robust_z") > F.lit(float(z)))
