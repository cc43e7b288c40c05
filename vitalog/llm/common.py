"""Helpers shared by the operators: scratch tables, word counts and text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the cluster's shared folder and read it back.

    The rows survive lost executors and are computed once, however often they are read.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words as bigint; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_fold(doc_id: Column, parts: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return crc % parts == fold


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and the n+1 offsets; null is empty."""
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    column = pc.fill_null(column, "" if text else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    width = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], width, len(column) + 1, np.dtype(width).itemsize * column.offset).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def groups_of(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut consecutive texts into groups of at most ``limit`` bytes, or of one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def text_groups(batches: Iterator[pa.RecordBatch], name: str, limit: int):
    """Yield (batch, first row, end row, bytes, offsets) for groups of whole texts."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(name)))
        for lo, hi in groups_of(offsets, limit):
            yield batch, lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z, and nothing else, in lower case."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of its text; words never cross texts."""
    letter = ~((data == 32) | ((data >= 9) & (data <= 13)))
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    end = letter.copy()
    end[:-1] &= ~letter[1:]
    inner = offsets[1:-1]
    first, last = inner[inner < len(data)], inner[inner > 0] - 1
    start[first] = letter[first]
    end[last] = letter[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_BASE = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93
_PIECE = 1 << 17


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse base^-i modulo 2^64 for i < n; base is odd."""
    both = []
    for factor in (base, pow(base, -1, 1 << 64)):
        run = np.full(max(n, 1), factor, np.uint64)
        run[0] = 1
        both.append(np.multiply.accumulate(run))
    return both[0], both[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span from prefix polynomial hashes, mixed so that all bits are usable.

    Starts ascend; the spans are worked off piece by piece, and a hash does not depend on where its span stands.
    """
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _PIECE)))
        base = int(starts[lo])
        part = data[base:int(ends[lo:hi].max())]
        up, down = powers(len(part) + 1)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mixed((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))
        lo = hi
    return out


def mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * np.uint64(_MIX)
    value = (value ^ (value >> np.uint64(32))) * np.uint64(_MIX)
    return value ^ (value >> np.uint64(32))


def learning_ids(labels: DataFrame, label: str, parts: int, fold: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids outside the held-out fold, those with the smallest hash, with their label as y.

    Null ids and labels are no labels; of contradicting rows the smaller label holds.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~in_fold(F.col("doc_id"), parts, fold))
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, fold: int, bound: int) -> DataFrame:
    """(doc_id, text, y) of the bounded sample; the ids are broadcast, as ``bound`` limits them."""
    ids = learning_ids(labels, label, parts, fold, bound)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
