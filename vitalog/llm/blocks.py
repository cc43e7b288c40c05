"""Blocks of input kept as files in the shared folder, and packed messages about them.

An operator that must come back to texts it has read cuts them into blocks where they are read. The files have names of their
own for each attempt, and only the rows a finished task returns name them, so a lost or repeated task does no harm.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

MESSAGE = "block string, shard int, body binary"


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI, as any executor sees it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return arrow_fs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, label: str) -> str:
    folder = scratch_dir(spark, label)
    system, place = opened(folder)
    system.create_dir(place, recursive=True)
    return folder


def save(folder: str, **fields) -> str:
    uri = f"{folder}/{uuid.uuid4().hex}"
    raw = pickle.dumps(fields, protocol=5)
    system, place = opened(uri)
    with system.open_output_stream(place, compression=None) as out:
        out.write(len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True))
    return uri


def load(uri: str) -> dict:
    system, place = opened(uri)
    with system.open_input_stream(place, compression=None) as stream:
        data = stream.read()
    return pickle.loads(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))


def small(numbers: np.ndarray) -> bytes:
    """Numbers, mostly below 255: one byte each, larger ones after them."""
    numbers = numbers.astype(np.uint64)
    large = numbers >= 255
    return zlib.compress(np.where(large, 255, numbers).astype(np.uint8).tobytes() + numbers[large].astype("<u8").tobytes(), 1)


def from_small(data: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(data)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    large = out == 255
    out[large] = np.frombuffer(raw, "<u8", int(large.sum()), n).astype(np.int64)
    return out


def message(**fields) -> bytes:
    return pickle.dumps(fields, protocol=5)


def sent(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    block, shard, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(block, pa.string()), pa.array(shard, pa.int32()), pa.array(body, pa.binary())], ["block", "shard", "body"])


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[tuple[str, int, dict]]]]:
    """Consecutive rows with the same key, as (block, shard, message)."""
    current, rows = None, []
    for batch in batches:
        blocks, shards, bodies = batch.columns
        for block, shard, body in zip(blocks.to_pylist(), shards.to_pylist(), bodies, strict=True):  # bodies are not all copied at once
            this = block if key == "block" else shard
            if rows and this != current:
                yield current, rows
                rows = []
            current = this
            rows.append((block, shard, pickle.loads(body.as_buffer())))
    if rows:
        yield current, rows


def block_tasks(spark: SparkSession, size: int, block_bytes: int) -> int:
    """Tasks for the blocks of ``size`` bytes of text, about two blocks each: a block's messages are small beside the work on it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * block_bytes)))


def by_block(messages: DataFrame, tasks: int) -> DataFrame:
    """Messages dealt out by block to a fixed number of tasks, each block's rows together and in order."""
    return messages.select("block", "shard", "body").repartition(tasks, "block").sortWithinPartitions("block", "shard")


def by_shard(messages: DataFrame, shards: int) -> DataFrame:
    """Messages dealt out by shard, one shard per task: hashing the numbers would put several into one."""
    return messages.select("block", "shard", "body").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block")
