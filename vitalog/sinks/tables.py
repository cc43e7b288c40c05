"""Writing tables: create, append, sorted layout, compaction, emptying.

Spark's commit protocol makes each write all-or-nothing: files of a failed or repeated task are
never visible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..files import exists

COMPRESSION = "zstd"


def create_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None) -> None:
    """A catalog table of a fixed schema, unless it is already there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    location = " LOCATION :path" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"OPTIONS (compression '{COMPRESSION}'){location}", args={"path": path} if path else None)


def create_tables(spark: SparkSession, database: str | None = None) -> None:
    for name, schema in schemas.TABLES.items():
        create_table(spark, f"{database}.{name}" if database else name, schema)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).option("compression", COMPRESSION).partitionBy(*partition_by).parquet(path)


def write_counted(df: DataFrame, path: str, mode: str) -> int:
    """Write and return the number of rows, counted while they pass."""
    seen = Observation()
    write_parquet(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, mode)
    return seen.get["rows"]


def append(df: DataFrame, path: str) -> int:
    """Append rows and return how many; appending the same rows again doubles them."""
    return write_counted(df, path, "append")


def append_to_table(df: DataFrame, name: str) -> int:
    seen = Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("rows"))
     .write.mode("append").format("parquet").saveAsTable(name))
    return seen.get["rows"]


def append_new(df: DataFrame, path: str, within: str | None = None) -> None:
    """Append the rows that are not stored yet, so that a repeated import adds nothing.

    Rows are told apart by all their columns; rows that repeat inside ``df`` are all new or all stored.
    ``within`` names a column by which the stored rows are cut to the range of the new ones, so that only that part of
    the store is read; stored rows that may equal new ones are brought to them as one row per hash.
    """
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    if within is not None:
        low, high, missing = df.agg(F.min(within), F.max(within), F.sum(F.col(within).isNull().cast("int"))).first()
        reach = F.col(within).between(F.lit(low), F.lit(high)) if low is not None else F.lit(False)
        stored = stored.filter(reach | F.col(within).isNull() if missing else reach)
    rows = F.struct(*df.columns)
    new = df.join(
        stored.distinct().select(F.xxhash64(rows).alias("_h"), *[F.col(c).alias(f"_{c}") for c in df.columns]),
        (F.xxhash64(rows) == F.col("_h"))
        & reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in df.columns)),
        "left_anti")
    write_parquet(new, path, "append")


def write_sorted(df: DataFrame, path: str, key: str = "startDate", mode: str = "errorifexists",
                 partitions: int | None = None, by_type: bool = False) -> None:
    """Range-partitioned and sorted by time, so that date filters skip files and row groups.

    A hash of the row is the last range key: rows that share an instant may fill several
    partitions. ``by_type`` also writes one folder per type, so a type filter prunes folders; read such a
    table with :func:`read_by_type`.
    """
    spread = F.xxhash64(*df.columns)
    keys = ([F.col("type")] if by_type else []) + [F.col(key), spread]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    layout = ranged.sortWithinPartitions(*(["type"] if by_type else []), key)
    if by_type:
        layout = layout.withColumn("type", _folder_of("type"))
    write_parquet(layout, path, mode, ("type",) if by_type else ())


# A folder can't be named by an empty text, which Spark would read back as NULL.
_MARK = "~"


def _folder_of(column: str) -> Column:
    kind = F.col(column)
    return F.when((kind == "") | kind.startswith(_MARK), F.concat(F.lit(_MARK), kind)).otherwise(kind)


def read_by_type(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Tables written with one folder per type; a filter on ``type`` still prunes folders."""
    # each table has a root of its own for its folders of types
    stored = reduce(lambda a, b: a.union(b), (spark.read.schema(schema).parquet(p) for p in ([paths] if isinstance(paths, str) else paths)))
    kind = F.col("type")
    written = F.when(kind.startswith(_MARK), F.substring(kind, 2, 2 ** 31 - 1)).otherwise(kind)
    return stored.withColumn("type", written).select(*schema.names)


def compact(frames: list[DataFrame], path: str, partitions: int | None = None) -> None:
    """Unite chunks of one table and write them as fewer, larger files.

    ``partitions`` merges neighbouring chunks without a shuffle; leave it out to let
    ``spark.sql.files.maxPartitionBytes`` set the size of the files.
    """
    united = reduce(lambda a, b: a.unionByName(b), frames)
    write_parquet(united.coalesce(partitions) if partitions else united, path)


def write_documents(documents: DataFrame, path: str, form: str = "parquet") -> int:
    """Append documents, as Parquet or as JSON lines, and return how many."""
    seen = Observation()
    counted = documents.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.mode("append")
    (writer.json(path) if form == "json" else writer.option("compression", COMPRESSION).parquet(path))
    return seen.get["rows"]


def delete_all(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """Empty a stored table and return how many rows it held; a missing one holds none."""
    if not exists(spark, path):
        return 0
    held = spark.read.schema(schema).parquet(path).count()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return held


def truncate_table(spark: SparkSession, name: str) -> None:
    if spark.catalog.tableExists(name):
        spark.sql(f"TRUNCATE TABLE {name}")
