"""Exact deduplication by Grace hashing.

Equal rows of one input batch are folded before anything is moved. Records then go to partitions by content hash;
inside a task they are split into spill files by further hash bits until the different contents of a
bucket fit an open-addressing table, which compares complete contents. Lists of ids travel beside
each content, so a copied text costs one row per batch, not one per copy.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

TABLE_BYTES = 48 << 20
FAN_OUT = 16
FLUSH_BYTES = 8 << 20
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


class OpenTable:
    """Linear probing over a power-of-two slot array; a slot matches only on equal complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.content_bytes = 0

    def entry(self, hashed: int, content: bytes) -> int:
        """Index of the content, new or old."""
        mask = len(self.slots) - 1
        at = hashed & mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == hashed and self.contents[found] == content:
                return found
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.content_bytes += len(content)
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return len(self.hashes) - 1

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        slots = [-1] * (mask + 1)
        for index, hashed in enumerate(self.hashes):
            at = hashed & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = index
        self.slots = slots


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per different content of a batch: hash, content, ids."""
    for batch in batches:
        table, ids = OpenTable(), []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            content = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_FOLD)
            at = table.entry(xxhash.xxh3_64_intdigest(content), content)
            if at == len(ids):
                ids.append([])
            ids[at].append(doc_id)
        yield pa.record_batch([pa.array([_signed(h) for h in table.hashes], pa.int64()),
                               pa.array(table.contents, pa.binary()), pa.array(ids, pa.list_(pa.int64()))],
                              ["hash", "content", "ids"])


class _Spill:
    """Records of one bucket: in memory up to FLUSH_BYTES, the rest in a file of the task's temp folder."""

    def __init__(self, folder: str) -> None:
        self.folder, self.path = folder, None
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.bytes += len(row[1]) + 8 * len(row[2]) + 100
        if self.bytes > FLUSH_BYTES:
            if self.path is None:
                self.path = tempfile.mkstemp(dir=self.folder)[1]
            with open(self.path, "ab") as out:
                pickle.dump(self.rows, out, protocol=5)
            self.rows, self.bytes = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.path is not None:
            with open(self.path, "rb") as rows:
                while True:
                    try:
                        yield from pickle.load(rows)
                    except EOFError:
                        break
        yield from self.rows

    def drop(self) -> None:
        if self.path is not None:
            os.unlink(self.path)
        self.rows = []


def _bucket_rows(bucket: _Spill, depth: int, table_bytes: int) -> Iterator[tuple]:
    """Yield (ids, index of the kept id in them or -1, kept id, copies, sha256) for one bucket."""
    table, size, keep = OpenTable(), [], []
    for hashed, content, ids in bucket:
        at = table.entry(hashed, content)
        if at == len(size):
            size.append(0)
            keep.append(None)
        size[at] += len(ids)
        known = [i for i in ids if i is not None]
        if known and (keep[at] is None or max(known) > keep[at]):
            keep[at] = max(known)
        if table.content_bytes > table_bytes and len(size) > 1 and depth < 12:
            break
    else:
        shas = [hashlib.sha256(content).hexdigest() for content in table.contents]
        open_ = [True] * len(size)
        for hashed, content, ids in bucket:
            at = table.entry(hashed, content)
            winner = ids.index(keep[at]) if open_[at] and keep[at] in ids else -1
            open_[at] &= winner < 0
            yield ids, winner, keep[at], size[at], shas[at]
        return
    del table
    parts = [_Spill(bucket.folder) for _ in range(FAN_OUT)]
    for row in bucket:
        parts[(row[0] >> (60 - 4 * depth)) % FAN_OUT].add(row)
    bucket.drop()
    for part in parts:
        yield from _bucket_rows(part, depth + 1, table_bytes)
        part.drop()


def _grace(table_bytes: int):
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("winner", pa.int32()), ("keep_id", pa.int64()),
                        ("group_size", pa.int64()), ("text_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            bucket = _Spill(folder)
            for batch in batches:
                for hashed, content, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    bucket.add((hashed & ((1 << 64) - 1), content, ids))
            out: list[tuple] = []
            for row in _bucket_rows(bucket, 0, table_bytes):
                out.append(row)
                if len(out) == 2000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
    return run


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Find rows whose texts are equal after lower-casing A-Z.

    Returns one row per input row: doc_id, keep_id (largest id of the group), group_size, kept,
    text_sha256 (of the normalised text). Null text counts as empty. Of rows that repeat the kept id, exactly
    one is kept; a group whose ids are all null keeps its one null id row, with keep_id null.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    folded = rows.mapInArrow(_fold_batches, "hash long, content binary, ids array<long>")
    groups = folded.repartition("hash").mapInArrow(
        _grace(table_bytes), "ids array<long>, winner int, keep_id long, group_size long, text_sha256 string")
    return groups.select(F.posexplode("ids").alias("at", "doc_id"), "winner", "keep_id", "group_size", "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("at") == F.col("winner")).alias("kept"), "text_sha256")


ORACLE = """
WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)
"""
