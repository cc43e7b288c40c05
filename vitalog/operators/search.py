"""Row search: filtered top-k, latest and extreme rows per type, exact text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SearchParams, is_workout
from .filters import all_of, equals, in_dates, of_type, record_conditions
from .ordering import newest, sorted_newest
from .sized_join import join_group_rows


def search_records(records: DataFrame, params: SearchParams) -> DataFrame:
    """The ``params.limit`` most recent records that meet ``params``."""
    return newest(records.filter(record_conditions(params)), params.limit)


def latest_record(records: DataFrame, record_type: str | None = None) -> DataFrame:
    """The most recent record of one type, or of each type when None."""
    if record_type:
        return newest(of_type(records, record_type), 1)
    return _rows_at_extremes(records, [("latest", F.max, "startDate")]).drop("extreme")


def extreme_records(rows: DataFrame, measure: str = "value", record_type: str | None = None) -> DataFrame:
    """Per type, the whole row with the lowest and the one with the highest ``measure``."""
    return _rows_at_extremes(of_type(rows, record_type), [("lowest", F.min, measure), ("highest", F.max, measure)])


def _rows_at_extremes(rows: DataFrame, extremes: list[tuple[str, Callable[[str], Column], str]]) -> DataFrame:
    """Per type, one row for each (label, extreme, column it is taken of).

    First the extreme values by a hash aggregation over two columns, then the smallest id among the rows that hold
    them, over three narrow columns, and last those few rows. Further ties, and rows without an id column, go to the row that is
    smallest on its other columns. Runs the first passes when called (see :func:`join_group_rows`).
    """
    typed = rows.filter(F.col("type").isNotNull())
    per_type = rows.groupBy("type").agg(*(extreme(column).alias(f"_{label}") for label, extreme, column in extremes))
    held = [F.when(F.col(column) == F.col(f"_{label}"), F.lit(label)) for label, _, column in extremes]
    first = [c for c in ("record_id", "workout_id") if c in rows.columns]

    def at_extremes(found: DataFrame) -> DataFrame:
        return join_group_rows(found, per_type, ["type"]).select(
            *found.columns, F.explode(F.array_compact(F.array(*held))).alias("extreme"))

    if first:
        key = F.coalesce(F.col(first[0]).cast("string"), F.lit(""))
        narrow = typed.select(*dict.fromkeys(["type", first[0], *(column for _, _, column in extremes)]))
        winners = at_extremes(narrow).groupBy("type", "extreme").agg(F.min(first[0]).alias(first[0]))
        winners = winners.select("type", "extreme", key.alias("_key"))
        at_extreme = join_group_rows(typed.withColumn("_key", key), winners, ["type", "_key"])
    else:
        at_extreme = at_extremes(typed)
    rest = first + [c for c in rows.columns if c not in first and c != "type"]
    return (at_extreme.groupBy("type", "extreme")
            .agg(F.min(F.struct(*rest)).alias("row"))
            .select(*[F.col("row")[c].alias(c) if c != "type" else F.col(c) for c in rows.columns],
                    "extreme"))


def search_values(records: DataFrame, value: str, record_type: str | None = None,
                  date_from=None, date_to=None) -> DataFrame:
    """All records whose text value is exactly ``value``, most recent first.

    Workouts carry no text value, so asking for a workout type gives an empty result.
    """
    if is_workout(record_type):
        return records.limit(0)
    return sorted_newest(records.filter(all_of([
        F.col("textValue") == F.lit(value),
        equals(F.col("type"), record_type),
        in_dates(F.col("startDate"), date_from, date_to),
    ])))
