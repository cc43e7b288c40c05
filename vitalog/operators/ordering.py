"""One total order for "most recent first", so that cut and sorted results are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tie_break(df: DataFrame, first: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> list[Column]:
    """Ascending keys over ``first`` and then every other sortable column.

    Rows that tie on all of them are identical, so it does not matter which one is kept.
    """
    names = [n for n in first if n in df.columns]
    names += [f.name for f in df.schema.fields
              if f.name not in names and f.name not in skip
              and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [F.col(n).asc_nulls_last() for n in names]


def newest_first(df: DataFrame, key: str = "startDate",
                 first: tuple[str, ...] = ("record_id", "workout_id")) -> list[Column]:
    return [F.col(key).desc_nulls_last(), *tie_break(df, first, skip=(key,))]


def newest(df: DataFrame, limit: int, key: str = "startDate") -> DataFrame:
    """The ``limit`` most recent rows: a per-task top-k followed by a merge, no full sort."""
    return df.orderBy(*newest_first(df, key)).limit(limit)


def sorted_newest(df: DataFrame, key: str = "startDate") -> DataFrame:
    """All rows, most recent first. The tie-break columns are part of the range partitioning, so
    a timestamp shared by a large part of the data is still spread over many tasks."""
    return df.orderBy(*newest_first(df, key))
