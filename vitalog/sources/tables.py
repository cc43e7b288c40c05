"""Reading stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet file or directory on any file system Spark can reach."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or a temporary view."""
    return spark.table(name)


def table_kind(df: DataFrame) -> str | None:
    """Which stored table a frame holds, judged by its exact set of columns."""
    names = set(df.columns)
    for kind, schema in schemas.TABLES.items():
        if names in (set(schema.names), {"workout_id", *schema.names}):
            return kind
    return None


def route_by_schema(frames: list[DataFrame]) -> dict[str, DataFrame]:
    """Frames sorted into tables by their columns, columns put in stored order, and united.

    Frames that fit no table are left out, as they hold none of the tables' rows.
    """
    routed: dict[str, list[DataFrame]] = {}
    for df in frames:
        kind = table_kind(df)
        if kind:
            key = ["workout_id"] if "workout_id" in df.columns else []
            routed.setdefault(kind, []).append(df.select(*key, *schemas.TABLES[kind].names))
    return {kind: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            for kind, parts in routed.items()}
