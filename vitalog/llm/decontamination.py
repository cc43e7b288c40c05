"""Benchmark decontamination by pigeonhole edit matching.

A test item may appear in a text with up to k = rate x length edits. Cut into k + 1 pieces, at least one piece then stands in the text
unchanged. An Aho-Corasick automaton finds all pieces of a block of items in one pass over a text. A hit is
verified from small to large: a run of j pieces must match with at most j - 1 edits, the whole item with k,
each by Myers' bit-parallel distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Characters of test items that are searched for in one pass, and sent to every task.
BLOCK_CHARS = 4_000_000


def normalised(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of the text, and the first end of one with it."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = ((((eq & plus) + plus) ^ plus) | x) & full
        hp = minus | (full & ~(d0 | plus))
        hn = d0 & plus
        if hp & top:
            distance += 1
        elif hn & top:
            distance -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        plus = hn | (full & ~(d0 | hp))
        minus = hp & d0
        if distance < best:
            best, end = distance, at
    return best, end


class Item:
    """A test item, its error budget and the cuts of its pieces."""

    def __init__(self, number: int, item_id: int | None, text: str, rate: float) -> None:
        self.number, self.item_id, self.text = number, item_id, text
        self.budget = int(len(text) * rate)
        pieces = self.budget + 1
        self.cuts = [len(text) * i // pieces for i in range(pieces + 1)]

    def climb(self, piece: int) -> list[tuple[int, int]]:
        """Runs of pieces from the smallest proper run around ``piece`` up to the whole item, halved from above."""
        runs, lo, hi = [], 0, len(self.cuts) - 1
        while hi - lo > 1:
            runs.append((lo, hi))
            middle = (lo + hi) // 2
            lo, hi = (lo, middle) if piece < middle else (middle, hi)
        return runs[::-1]

    def verify(self, text: str, piece: int, at: int) -> tuple[int, int] | None:
        """Distance and end of the item around a piece found at ``at``, or None.

        If a run of j pieces has at most j - 1 edits, so has one of its halves, for its own number of pieces.
        """
        origin = at - self.cuts[piece]
        best, end = 0, at + self.cuts[piece + 1] - self.cuts[piece]
        for lo, hi in self.climb(piece):
            slack = hi - lo - 1
            begin = max(0, origin + self.cuts[lo] - slack)
            best, end = myers(self.text[self.cuts[lo]:self.cuts[hi]], text[begin:origin + self.cuts[hi] + slack])
            end += begin
            if best > slack:
                return None
        return best, end


class Matcher:
    """The automaton over all pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float) -> None:
        self.items = [Item(n, item_id, text, rate) for n, (item_id, text) in enumerate(items)]
        pieces: dict[str, list[tuple[Item, int]]] = {}
        for item in self.items:
            for i in range(len(item.cuts) - 1):
                pieces.setdefault(item.text[item.cuts[i]:item.cuts[i + 1]], []).append((item, i))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """Best (distance, end) of every item found in a normalised text, by item number."""
        found: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        done: set[tuple[int, int]] = set()
        if not self.items:
            return found
        for last, (length, where) in self.automaton.iter(text):
            at = last + 1 - length
            for item, piece in where:
                origin = at - item.cuts[piece]
                if (item.number, origin) in done:  # the whole item was matched at this very place
                    continue
                if (item.number, piece, origin) in tried:
                    continue
                tried.add((item.number, piece, origin))
                hit = item.verify(text, piece, at)
                if hit is not None:
                    done.add((item.number, origin))
                    if item.number not in found or hit < found[item.number]:
                        found[item.number] = hit
        return found


def _search(items: list[tuple[int | None, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                for number, (distance, end) in matcher.matches(normalised(text.as_py())).items():
                    rows.append((doc_id.as_py(), items[number][0], distance, end, matcher.items[number].budget))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "end", "budget"])
    return run


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """Normalised items, a bounded number of characters at a time; the driver never holds more than one block."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        text = normalised(row["text"])
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Find test items in documents, with edits up to ``rate`` times the item's length.

    Returns one row per document and item found: doc_id, item_id, distance (least number of edits), end (where the first best match
    ends in the normalised document) and budget. Case and white space don't count. Null and blank texts and items never match; an item
    shorter than 1 / rate characters must match exactly. Repeated documents or items give repeated rows; empty tables give an empty
    result. Documents are read once per block of items.
    """
    schema = "doc_id long, item_id long, distance int, end long, budget int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in _blocks(items, block_chars):
        hits = written(rows.mapInArrow(_search(block, rate), schema), "leaks")
        found = hits if found is None else found.union(hits)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)
