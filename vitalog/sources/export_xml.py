"""The export files as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_size_mb(spark: SparkSession, path: str) -> DataFrame:
    """Total size of the export files in MB, from the file listing; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.round(F.sum("length") / F.lit(1048576.0), 2).alias("file_size_mb"))
