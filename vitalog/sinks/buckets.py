"""Tables cut by a hash of a key, so that tables cut alike are joined and grouped by it without a shuffle.

Bucketed files carry the number of their bucket in their names, and Spark reads them as such through a table definition. Definitions
are made for a write or a read and dropped again: they name a folder and hold no data, so the folders go with the store, not with a catalog.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from .tables import COMPRESSION, write_counted

#: Compressed bytes of the larger table per bucket.
BUCKET_BYTES = 64 << 20
#: Keys with no more rows than this are never taken out of the buckets.
HOT_ROWS = 100_000
#: Rows with hot keys are broadcast up to this many, and this many bytes as they are stored.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 4 << 20


def bucket_count(size: int) -> int:
    """A power of two, so that one bucket holds at most ``BUCKET_BYTES`` of ``size`` evenly spread bytes."""
    return 1 << max(0, -(-size // BUCKET_BYTES) - 1).bit_length()


def _temporary_name() -> str:
    return f"vitalog_{uuid.uuid4().hex}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """One file per bucket, sorted by key; replaces what is at ``path``."""
    spark, name = df.sparkSession, _temporary_name()
    files.delete(spark, path)
    try:
        (df.repartition(buckets, key).write.format("parquet").option("compression", COMPRESSION).option("path", path)
         .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


# Buckets that a task may write at once without sorting its rows by bucket first.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Name of the file, beside a table of :func:`write_in_place`, that holds its keys and number of buckets.
_CUT = "_cut"


@contextmanager
def open_writers(spark: SparkSession, at_once: int = 64) -> Iterator[None]:
    """Tasks that write up to so many folders or buckets without sorting their rows by those first."""
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, at_once)
    try:
        yield
    finally:
        spark.conf.set(_WRITERS, before)


def write_in_place(df: DataFrame, path: str, keys: list[str], buckets: int, at_once: int = 64) -> None:
    """Cut a table by ``keys`` without a shuffle: each task writes one file for each bucket that it holds rows of.

    Meant for rows that lie together by ``keys`` already, so that a task holds few buckets.
    """
    spark, name = df.sparkSession, _temporary_name()
    try:
        with open_writers(spark, at_once):
            df.write.format("parquet").option("compression", COMPRESSION).option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    files.write_json(spark, f"{path}/{_CUT}", {"keys": keys, "buckets": buckets})


def read_in_place(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of :func:`write_in_place`, which Spark then groups by its keys without a shuffle."""
    cut = files.read_json(spark, f"{path}/{_CUT}")
    return _defined(spark, path, schema or spark.read.parquet(path).schema, cut["buckets"], cut["keys"])


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """A table that :func:`write_bucketed` wrote, from any session."""
    return _defined(spark, path, schema, buckets, [key], f"SORTED BY (`{key}`)")


def _defined(spark: SparkSession, path: str, schema: T.StructType, buckets: int, keys: list[str], order: str = "") -> DataFrame:
    name = _temporary_name()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) {order} "
              f"INTO {buckets} BUCKETS LOCATION :path", args={"path": path})
    try:
        return spark.read.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def write_pairs(one: DataFrame, many: DataFrame, folder: str, names: tuple[str, str], key: str, buckets: int) -> int:
    """Cut both tables by ``key`` alike; rows of ``many`` with a hot key, or none, go to a plain table of their own.

    A key is hot if it has more rows than a quarter of a bucket's even share (and than ``HOT_ROWS``), so there are at most four hot keys per
    bucket. The rows of ``one`` with such keys are also kept beside those of ``many``, and the two are joined apart. Returns the rows of ``one`` kept so.
    """
    spark = many.sparkSession
    total = many.count()
    limit = max(HOT_ROWS, total // (4 * buckets))
    hot = many.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > limit) & F.col(key).isNotNull()).select(key)
    ids = f"{folder}/hot_keys"
    found = write_counted(hot, ids, "overwrite")
    hot = spark.read.schema(hot.schema).parquet(ids)
    if found <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    write_bucketed(one, f"{folder}/{names[0]}_paired", key, buckets)
    write_bucketed(many.filter(F.col(key).isNotNull()).join(hot, key, "left_anti"), f"{folder}/{names[1]}_paired", key, buckets)
    kept = write_counted(one.join(hot, key, "left_semi").select(*one.columns), f"{folder}/{names[0]}_hot", "overwrite")
    apart = many.join(hot, key, "left_semi").select(*many.columns).unionByName(many.filter(F.col(key).isNull()))
    write_counted(apart, f"{folder}/{names[1]}_hot", "overwrite")
    return kept


def read_pairs(spark: SparkSession, folder: str, names: tuple[str, str], schemas: tuple[T.StructType, T.StructType], key: str,
               buckets: int, hot: int) -> list[tuple[DataFrame, DataFrame]]:
    """The two tables of :func:`write_pairs` in two parts: those cut by key, which join without a shuffle, and those with hot keys."""
    even = tuple(read_bucketed(spark, f"{folder}/{n}_paired", s, key, buckets) for n, s in zip(names, schemas, strict=True))
    one, many = (spark.read.schema(s).parquet(f"{folder}/{n}_hot") for n, s in zip(names, schemas, strict=True))
    if hot <= BROADCAST_ROWS and files.size(spark, f"{folder}/{names[0]}_hot") <= BROADCAST_BYTES:
        one = F.broadcast(one)
    return [even, (one, many)]
