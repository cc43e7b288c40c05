"""Workouts and their statistics: pairing by start time or by key, and aggregates over the pairs.

Statistics were stored without a parent key, so the compatible pairing is "starts at the same
instant": many-to-many, and quadratic in the rows of a busy instant. Every aggregate over it is
computed from per-instant partial aggregates of the two sides instead. With n rows on each side,
sum over pairs of a workout measure = (its sum) x (statistics there), and min/max carry over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bucket
from ..functions.measures import exact_total, from_units, other_values, with_others
from ..params import SearchParams
from .filters import of_type, stat_conditions, workout_conditions
from .ordering import newest_first

MEASURES = ("duration", "sum")
#: Workouts and statistics that pair by key only among themselves.
Parts = list[tuple[DataFrame, DataFrame]]


def matched_instants(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two sides that were already reduced to one row per instant and group."""
    return left.join(right, "startDate", "inner")


def _partials(measure: str, prefix: str, scale: int | None) -> list[Column]:
    value = F.col(measure)
    return [
        F.count(F.lit(1)).alias(f"{prefix}_rows"),
        F.count(value).alias(f"{prefix}_values"),
        exact_total(value, scale).alias(f"{prefix}_total"),
        F.sum(other_values(value, scale)).alias(f"{prefix}_others"),
        F.min(value).alias(f"{prefix}_min"),
        F.max(value).alias(f"{prefix}_max"),
    ]


def _workout_partials(workouts: DataFrame, keys: list[str], scale: int | None) -> DataFrame:
    return workouts.groupBy("startDate", *keys).agg(*_partials("duration", "w", scale))


def _stat_partials(stats: DataFrame, keys: list[str], scale: int | None) -> DataFrame:
    renamed = stats.withColumnRenamed("type", "stat_type").withColumnRenamed("unit", "stat_unit")
    return renamed.groupBy("startDate", *keys).agg(*_partials("sum", "s", scale))


def _weighted(total: str, weight: str, scale: int | None) -> Column:
    """A side's total counted once per partner row; whole units stay exact in DECIMAL(38)."""
    kind = "double" if scale is None else "decimal(38,0)"
    return F.col(total).cast(kind) * F.col(weight).cast(kind if scale is None else "decimal(20,0)")


def _measure_rows(paired: DataFrame, duration_unit: Column, scale: int | None) -> DataFrame:
    """One row per measure and instant group, ready for the final aggregation."""
    pairs = F.col("w_rows") * F.col("s_rows")
    kind = "double" if scale is None else "decimal(38,0)"

    def entry(measure: str, unit: Column, own: str, other: str) -> Column:
        return F.struct(
            F.lit(measure).alias("measure"),
            unit.alias("unit"),
            pairs.alias("pairs"),
            (F.col(f"{own}_values") * F.col(f"{other}_rows")).alias("values"),
            _weighted(f"{own}_total", f"{other}_rows", scale).cast(kind).alias("total"),
            (F.col(f"{own}_others") * F.col(f"{other}_rows")).alias("others"),
            F.col(f"{own}_min").alias("low"),
            F.col(f"{own}_max").alias("high"),
        )

    both = F.array(entry("duration", duration_unit, "w", "s"), entry("sum", F.col("stat_unit"), "s", "w"))
    return paired.withColumn("m", F.explode(both))


def _final(rows: DataFrame, keys: list[str], scale: int | None) -> DataFrame:
    total = with_others(from_units(F.sum("m.total"), scale), F.sum("m.others"))
    return (
        rows.withColumn("measure", F.col("m.measure")).withColumn("unit", F.col("m.unit"))
        .groupBy(*keys, "measure", "unit")
        .agg(
            F.sum("m.pairs").alias("count"),
            (total / F.nullif(F.sum("m.values"), F.lit(0))).alias("average"),
            total.alias("sum"),
            F.min("m.low").alias("min"),
            F.max("m.high").alias("max"),
        )
    )


def _duration_unit(own_unit: bool) -> Column:
    return F.col("durationUnit") if own_unit else F.col("stat_unit")


def stats_workout(workouts: DataFrame, stats: DataFrame, record_type: str | None = None,
                  scale: int | None = None, own_unit: bool = True) -> DataFrame:
    """Statistics of ``duration`` and ``sum`` over the pairs, per workout and statistic type.

    A ``measure`` column tells the two apart. ``own_unit`` labels durations with the workout's
    unit; False gives them the statistic's unit, as a plain SELECT over the pairs would.
    """
    w = _workout_partials(of_type(workouts, record_type),
                          ["type", "durationUnit"] if own_unit else ["type"], scale)
    s = _stat_partials(stats, ["stat_type", "stat_unit"], scale)
    rows = _measure_rows(matched_instants(w, s), _duration_unit(own_unit), scale)
    return _final(rows, ["type", "stat_type"], scale)


def trend_workout(workouts: DataFrame, stats: DataFrame, record_type: str | None = None,
                  interval: str = "month", date_from=None, date_to=None, scale: int | None = None,
                  own_unit: bool = True, by_stat_type: bool = False,
                  tz: str | None = None) -> DataFrame:
    """``duration`` and ``sum`` per calendar bucket, type, source and unit over the pairs.

    Statistics of one unit are mixed unless ``by_stat_type`` is set.
    """
    wanted = of_type(workouts, record_type, date_from, date_to)
    w_keys = ["type", "sourceName"] + (["durationUnit"] if own_unit else [])
    s_keys = ["stat_unit"] + (["stat_type"] if by_stat_type else [])
    w = _workout_partials(wanted, w_keys, scale)
    s = _stat_partials(of_type(stats, None, date_from, date_to), s_keys, scale)
    rows = (_measure_rows(matched_instants(w, s), _duration_unit(own_unit), scale)
            .withColumn("interval", bucket(F.col("startDate"), interval, tz)))
    keys = ["interval", "type", "sourceName"] + (["stat_type"] if by_stat_type else [])
    return _final(rows, keys, scale).orderBy("interval")


def workout_stat_pairs(workouts: DataFrame, stats: DataFrame) -> DataFrame:
    """The pairing by start time, with equal pairs folded into one row and counted.

    One row per instant, workout (type, source, unit) and statistic (type, unit) with the number
    of pairs it stands for and the range of both measures, so its size follows the groups at an
    instant and not the product of the rows there.
    """
    w = workouts.groupBy("startDate", "type", "sourceName", "durationUnit").agg(
        F.count(F.lit(1)).alias("n_workouts"),
        F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"))
    s = (stats.withColumnRenamed("type", "stat_type")
         .groupBy("startDate", "stat_type", "unit").agg(
             F.count(F.lit(1)).alias("n_stats"),
             F.min("sum").alias("min_sum"), F.max("sum").alias("max_sum")))
    return matched_instants(w, s).withColumn("pairs", F.col("n_workouts") * F.col("n_stats"))


# A statistic's columns that would clash with the workout's.
_STAT_NAMES = {"workout_id": "stat_workout_id", "type": "stat_type",
               "startDate": "stat_startDate", "endDate": "stat_endDate"}


def _beside_workout(stats: DataFrame) -> DataFrame:
    """Names a statistic's columns so that they can stand beside the workout's."""
    return stats.select(*(F.col(n).alias(_STAT_NAMES.get(n, n)) for n in stats.columns))


def keyed_pairs(workouts: DataFrame, stats: DataFrame) -> DataFrame:
    """Each statistic beside the workout it was recorded in: one row per statistic."""
    side = _beside_workout(stats).withColumnRenamed("stat_workout_id", "workout_id")
    return workouts.join(side, "workout_id", "inner")


def stats_workout_keyed(workouts: DataFrame, stats: DataFrame, record_type: str | None = None,
                        scale: int | None = None, parts: Parts | None = None) -> DataFrame:
    """As :func:`stats_workout`, paired by ``workout_id``.

    ``parts`` are the same rows cut so that each part can be paired by itself; parts stored by workout are paired without a shuffle.
    """
    found = [(of_type(w, record_type).select("workout_id", "type", "durationUnit", "duration"), s) for w, s in parts or [(workouts, stats)]]
    return _keyed(found, ["type", "durationUnit"], ["type", "stat_type"], scale)


def trend_workout_keyed(workouts: DataFrame, stats: DataFrame, record_type: str | None = None,
                        interval: str = "month", date_from=None, date_to=None,
                        scale: int | None = None, tz: str | None = None, parts: Parts | None = None) -> DataFrame:
    """As :func:`trend_workout`, paired by ``workout_id`` and split by statistic type; ``parts`` as in :func:`stats_workout_keyed`."""
    found = [(of_type(w, record_type, date_from, date_to).select(
        "workout_id", "type", "sourceName", "durationUnit", "duration",
        bucket(F.col("startDate"), interval, tz).alias("interval")), s) for w, s in parts or [(workouts, stats)]]
    keys = ["interval", "type", "sourceName"]
    return _keyed(found, [*keys, "durationUnit"], [*keys, "stat_type"], scale).orderBy("interval")


def _keyed(parts: Parts, workout_keys: list[str], keys: list[str], scale: int | None) -> DataFrame:
    """Aggregates over the pairs of the wanted workouts with their own statistics.

    The join comes first: only statistics of wanted workouts go on, and every pair is one of their rows, so nothing is
    multiplied. Two partial aggregations by group follow, whose rows are few.
    """
    joined = [w.join(s.select("workout_id", F.col("type").alias("stat_type"), F.col("unit").alias("stat_unit"), "sum"), "workout_id")
              for w, s in parts]
    pairs = reduce(lambda a, b: a.unionByName(b), joined).groupBy(*workout_keys, "stat_type", "stat_unit").agg(
        *_partials("duration", "w", scale), *_partials("sum", "s", scale))
    kind = "double" if scale is None else "decimal(38,0)"

    def entry(measure: str, unit: str, own: str) -> Column:
        return F.struct(F.lit(measure).alias("measure"), F.col(unit).alias("unit"), F.col(f"{own}_rows").alias("pairs"),
                        F.col(f"{own}_values").alias("values"), F.col(f"{own}_total").cast(kind).alias("total"),
                        F.col(f"{own}_others").alias("others"), F.col(f"{own}_min").alias("low"), F.col(f"{own}_max").alias("high"))

    both = F.array(entry("duration", "durationUnit", "w"), entry("sum", "stat_unit", "s"))
    return _final(pairs.withColumn("m", F.explode(both)), keys, scale)


def search_workouts(workouts: DataFrame, stats: DataFrame, params: SearchParams) -> DataFrame:
    """The ``limit`` most recent pairs that start together, workout columns and ``stat_*`` columns.

    Exact for the total order (start desc, workout, statistic) without building the pairs:
    every matched workout yields at least one pair, so the first ``limit`` workouts suffice, and
    the statistics of the instants they need are among the first ``2 * limit`` of those instants.
    All cuts are per-task top-k merges of at most ``2 * limit`` rows.
    """
    limit = params.limit
    w = workouts.filter(workout_conditions(params))
    s = stats.filter(stat_conditions(params))

    per_instant = s.groupBy("startDate").agg(F.count(F.lit(1)).alias("n_stats"))
    newest_instants = (
        w.select("startDate").distinct().join(per_instant, "startDate")
        .orderBy(F.desc("startDate")).limit(limit)
    )
    w_top = w.join(newest_instants, "startDate").orderBy(*newest_first(w)).limit(limit)

    # Workouts whose predecessors already fill the result are not needed. At most ``limit`` rows.
    up_to_here = Window.orderBy(*newest_first(w)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    w_top = (w_top.withColumn("pairs_so_far", F.sum("n_stats").over(up_to_here))
             .filter(F.col("pairs_so_far") - F.col("n_stats") < limit))

    s_top = (s.join(newest_instants.select("startDate"), "startDate")
             .orderBy(*newest_first(s)).limit(2 * limit))
    side = _beside_workout(s_top.select(*s.columns))
    pairs = w_top.join(side, w_top["startDate"] == side["stat_startDate"])
    return _first_pairs(pairs, w, s, limit)


def search_workouts_keyed(workouts: DataFrame, stats: DataFrame, params: SearchParams) -> DataFrame:
    """The ``limit`` most recent workout/statistic pairs, paired by ``workout_id``."""
    limit = params.limit
    w = workouts.filter(workout_conditions(params))
    s = stats.filter(stat_conditions(params))
    w_top = (w.join(s.select("workout_id").distinct(), "workout_id")
             .orderBy(*newest_first(w)).limit(limit))
    side = _beside_workout(s)
    pairs = w_top.join(side, w_top["workout_id"] == side["stat_workout_id"])
    return _first_pairs(pairs, w, s, limit)


def _first_pairs(pairs: DataFrame, workouts: DataFrame, stats: DataFrame, limit: int) -> DataFrame:
    """Cut to ``limit`` in the order the two sides were cut in."""
    stat_names = ["workout_id"] if "workout_id" in stats.columns else []
    stat_names += [n for n in stats.columns if n != "workout_id"]
    order = [*newest_first(workouts),
             *(F.col(_STAT_NAMES.get(n, n)).asc_nulls_last() for n in stat_names)]
    shown = [_STAT_NAMES.get(n, n) for n in stats.columns]
    return pairs.orderBy(*order).limit(limit).select(*workouts.columns, *shown)
