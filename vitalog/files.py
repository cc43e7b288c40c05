"""Small jobs on the cluster's file system, from the driver."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _path(spark, path)
    return system.exists(target)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Put a folder, or an empty one where none is at ``path``, in the place of what is at ``to``."""
    source, system = _path(spark, path)
    target, _ = _path(spark, to)
    system.delete(target, True)
    system.mkdirs(target.getParent())
    if not (system.rename(source, target) if system.exists(source) else system.mkdirs(target)):
        raise OSError(f"{path} can't be moved to {to}")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds; one that isn't there is fine."""
    target, system = _path(spark, path)
    system.delete(target, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; a missing folder holds none."""
    target, system = _path(spark, folder)
    if not system.exists(target):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(target))


def read_json(spark: SparkSession, path: str):
    target, system = _path(spark, path)
    stream = system.open(target)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    """Write a small file that appears whole or not at all; never replaces one, also not one that another session writes at the same time.

    A rename that fails where the target exists does that on a cluster's file system; on a local disk a link does.
    """
    target, system = _path(spark, path)
    draft, _ = _path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    stream = system.create(draft)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    try:
        if target.toUri().getScheme() in (None, "file") and system.getScheme() == "file":
            local = [spark._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)]
            try:
                spark._jvm.java.nio.file.Files.createLink(*local)
            except Py4JJavaError as error:
                if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                    raise FileExistsError(path) from error
                raise
        elif system.exists(target) or not system.rename(draft, target):
            raise FileExistsError(path)
    finally:
        system.delete(draft, False)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path; a missing one has none."""
    target, system = _path(spark, path)
    return system.getContentSummary(target).getLength() if system.exists(target) else 0
