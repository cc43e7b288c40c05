"""Session settings and the shared scratch folder the engine relies on."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from . import files

# Runtime SQL settings every query is written against: timestamps mean UTC, bad casts are
# errors instead of silent NULLs, and joins/aggregations are re-planned from runtime sizes.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime SQL settings on an existing session and return it."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "vitalog", cpus: str | int = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def session_like(spark: SparkSession) -> SparkSession:
    """A session of its own with the same settings, so that work in another thread can change some."""
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if other.conf.get(key, None) != value:
            try:
                other.conf.set(key, value)
            except PySparkException:  # settings of the application are the same anyway
                continue
    return configure(other)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only in local mode, where none may be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="vitalog-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class _Open(threading.local):
    """Each thread's own, as imports may run at once."""

    def __init__(self) -> None:
        self.scratch: list[list[str]] = []


_OPEN = _Open()


def scratch_dir(spark: SparkSession, label: str, kept: bool = False) -> str:
    """A new, unused path under the shared folder for one intermediate table.

    Inside :func:`scratch` it is removed when that ends, unless it is ``kept``.
    """
    path = f"{checkpoint_root(spark)}/vitalog/{label}-{uuid.uuid4().hex}"
    if _OPEN.scratch and not kept:
        _OPEN.scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables that were named inside, also when the work fails."""
    _OPEN.scratch.append([])
    try:
        yield
    finally:
        for path in _OPEN.scratch.pop():
            files.delete(spark, path)


def checkpointed(df):
    """Cut lineage through a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)
