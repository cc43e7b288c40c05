"""How much data there is, by type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workouts import Parts, matched_instants


def summary_records(records: DataFrame) -> DataFrame:
    """``type, count``, largest first."""
    return (records.groupBy("type").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_last("type")))


def summary_workouts(workouts: DataFrame, stats: DataFrame) -> DataFrame:
    """``type, count, count_workouts``, largest first.

    ``count`` counts workout x statistic pairs that start at the same instant, ``count_workouts``
    the workouts behind them. The pairs themselves are never built: each instant contributes
    (workouts of the type) x (statistics).
    """
    per_type = workouts.groupBy("startDate", "type").agg(F.count(F.lit(1)).alias("n_workouts"))
    per_instant = stats.groupBy("startDate").agg(F.count(F.lit(1)).alias("n_stats"))
    return (
        matched_instants(per_type, per_instant)
        .groupBy("type")
        .agg(F.sum(F.col("n_workouts") * F.col("n_stats")).alias("count"),
             F.sum("n_workouts").alias("count_workouts"))
        .orderBy(F.desc("count"), F.asc_nulls_last("type"))
    )


def summary_workouts_keyed(workouts: DataFrame, stats: DataFrame, parts: Parts | None = None) -> DataFrame:
    """As :func:`summary_workouts`, paired by ``workout_id`` instead of by start time; ``parts`` as in :func:`.workouts.stats_workout_keyed`."""
    counted = []
    for w, s in parts or [(workouts, stats)]:
        per_workout = (s.filter(F.col("workout_id").isNotNull())
                       .groupBy("workout_id").agg(F.count(F.lit(1)).alias("n_stats")))
        counted.append(w.select("workout_id", "type").join(per_workout, "workout_id"))
    return (
        reduce(lambda a, b: a.unionByName(b), counted)
        .groupBy("type")
        .agg(F.sum("n_stats").alias("count"), F.count(F.lit(1)).alias("count_workouts"))
        .orderBy(F.desc("count"), F.asc_nulls_last("type"))
    )


def united(of_records: DataFrame, of_workouts: DataFrame) -> DataFrame:
    """Both summaries in one result, told apart by ``source_table``."""
    return (of_records.withColumn("source_table", F.lit("records"))
            .unionByName(of_workouts.withColumn("source_table", F.lit("workouts")),
                         allowMissingColumns=True))


def summary(records: DataFrame, workouts: DataFrame, stats: DataFrame) -> DataFrame:
    """Record types and workout types in one result."""
    return united(summary_records(records), summary_workouts(workouts, stats))


def summary_total(records: DataFrame) -> DataFrame:
    """Total number of records and of distinct types, from one pass over ``type``."""
    per_type = records.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return per_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
                        F.count("type").alias("record_types"))


def summary_range(records: DataFrame) -> DataFrame:
    """First and last start time and the number of rows of each type."""
    return records.groupBy("type").agg(
        F.min("startDate").alias("first_date"),
        F.max("startDate").alias("last_date"),
        F.count(F.lit(1)).alias("count"),
    )
