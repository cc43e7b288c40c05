"""Search parameters to predicates that Catalyst can push into the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SearchParams, parse_instant, parse_number


def all_of(conditions: list[Column | None]) -> Column:
    """Conjunction of the given conditions; absent ones drop out, none at all means true."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def equals(column: Column, wanted: str | None) -> Column | None:
    return None if not wanted else column == F.lit(wanted)


def between(column: Column, low, high) -> Column | None:
    """Inclusive range; either bound may be missing, both missing is no condition."""
    bounds = []
    if low is not None:
        bounds.append(column >= F.lit(low))
    if high is not None:
        bounds.append(column <= F.lit(high))
    return all_of(bounds) if bounds else None


def in_dates(column: Column, date_from, date_to) -> Column | None:
    """Inclusive instants. A bare end date means its midnight, so the rest of that day is out."""
    return between(column, parse_instant(date_from), parse_instant(date_to))


def in_values(column: Column, low, high) -> Column | None:
    return between(column, parse_number(low), parse_number(high))


def no_duration(params: SearchParams) -> None:
    if params.min_workout_duration is not None or params.max_workout_duration is not None:
        raise ValueError("a duration can only be asked of workouts: name a workout type")


def record_conditions(params: SearchParams) -> Column:
    """What ``params`` asks of a record row; a duration, which records don't have, is an error."""
    no_duration(params)
    return all_of([
        equals(F.col("type"), params.record_type),
        equals(F.col("sourceName"), params.source_name),
        in_dates(F.col("startDate"), params.date_from, params.date_to),
        in_values(F.col("value"), params.value_min, params.value_max),
    ])


def workout_conditions(params: SearchParams) -> Column:
    """What ``params`` asks of a workout row."""
    return all_of([
        equals(F.col("type"), params.record_type),
        equals(F.col("sourceName"), params.source_name),
        in_dates(F.col("startDate"), params.date_from, params.date_to),
        in_values(F.col("duration"), params.min_workout_duration, params.max_workout_duration),
    ])


def stat_conditions(params: SearchParams) -> Column:
    """What ``params`` asks of a statistic row: the value range applies to ``sum``."""
    return all_of([in_values(F.col("sum"), params.value_min, params.value_max)])


def of_type(df: DataFrame, record_type: str | None, date_from=None, date_to=None) -> DataFrame:
    """Rows of one type (all when None) in an inclusive date range."""
    return df.filter(all_of([
        equals(F.col("type"), record_type),
        in_dates(F.col("startDate"), date_from, date_to),
    ]))
