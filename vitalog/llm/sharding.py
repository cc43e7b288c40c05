"""Dealing documents into shards of near equal size by a histogram sort, with DataFrame operations only.

Rows are ordered by a key (a digest of the text, so that equal texts stand together), then by a digest of the id, then by row.
Splitters between the shards are found by counting: each round puts evenly spaced probes into every interval that still holds an
unfinished splitter, counts the exact weight between neighbouring probes across all partitions in one map-side combined
aggregate, and goes on in the step its target falls into, narrowed to the keys that occur there. A splitter is done when the target falls
into one group of equal keys one edge of which is within the tolerance, or else into a single row of that group. Only then are rows
exchanged, once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SHARDS = 16
#: A group of equal texts is cut only where neither of its edges is within this part of a shard of the target.
TOLERANCE = 0.01
#: Probes per unfinished splitter and round.
PROBES = 256
LEVELS = ("k0", "k1", "k2")
_DIGITS = 15
_ROW_BITS = 33


@dataclass(frozen=True)
class Splitter:
    """Rows whose leading keys are at or behind ``keys`` belong to later shards."""

    keys: tuple[int, ...]

    def behind(self) -> Column:
        *equal, last = self.keys
        out = F.col(LEVELS[len(equal)]) >= F.lit(last)
        for level, value in reversed(list(zip(LEVELS, equal, strict=False))):
            out = (F.col(level) > F.lit(value)) | ((F.col(level) == F.lit(value)) & out)
        return out


@dataclass(frozen=True)
class Interval:
    """Rows with the leading keys ``equal`` whose next key is in [low, high]."""

    equal: tuple[int, ...]
    low: int
    high: int
    probes: int

    @property
    def step(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // self.probes))

    @property
    def level(self) -> Column:
        return F.col(LEVELS[len(self.equal)])

    def holds(self) -> Column:
        equal = [F.col(level) == F.lit(value) for level, value in zip(LEVELS, self.equal, strict=False)]
        return reduce(lambda a, b: a & b, [*equal, self.level.between(F.lit(self.low), F.lit(self.high))])

    def place(self) -> Column:
        return F.expr(f"({LEVELS[len(self.equal)]} - {self.low}L) div {self.step}L")


def _digest(value: Column) -> Column:
    """The leading digits of a digest as a number below 16^15."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, _DIGITS), 16, 10).cast("long")


def _keyed(docs: DataFrame, carried: list[Column], id_col: str, text_col: str, by: str) -> DataFrame:
    text, doc_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    size = F.octet_length(text).cast("long") + 1
    rows = docs.select(
        doc_id.cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        _digest(text).alias("k0"), _digest(F.coalesce(doc_id.cast("string"), F.lit(""))).alias("k1"),
        F.monotonically_increasing_id().alias("k2"), (size if by == "bytes" else F.lit(1).cast("long")).alias("weight"), *carried)
    return written(rows, "shard-keys")  # row numbers are fixed from here on


def _histogram(keyed: DataFrame, intervals: list[Interval]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """Weight, rows and extreme keys of every step of every interval that holds rows; at most PROBES rows per interval."""
    which, place, level = (F.lit(None) for _ in range(3))
    for i, interval in reversed(list(enumerate(intervals))):
        which = F.when(interval.holds(), i).otherwise(which)
        place = F.when(interval.holds(), interval.place()).otherwise(place)
        level = F.when(interval.holds(), interval.level).otherwise(level)
    found = keyed.select(which.cast("int").alias("i"), place.cast("long").alias("s"), level.cast("long").alias("k"), "weight").filter("i IS NOT NULL")
    counted = found.groupBy("i", "s").agg(F.sum("weight"), F.count("*"), F.min("k"), F.max("k"))
    return {(r[0], r[1]): tuple(r[2:]) for r in counted.collect()}


def splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[Splitter]:
    """The ``shards`` - 1 splitters of a written table with columns k0, k1, k2 and weight.

    What goes to the driver are histograms of at most ``PROBES`` rows per unfinished splitter (``shards`` times that in the first round).
    """
    total, low, high = keyed.agg(F.sum("weight"), F.min("k0"), F.max("k0")).first()
    if not total:
        return []
    targets = [total * i // shards for i in range(1, shards)]
    first = Interval((), low, high, PROBES * shards)
    unfinished = {i: (first, 0) for i in range(len(targets))}  # the interval a target falls into and the weight in front of it
    done: dict[int, Splitter] = {}
    while unfinished:
        intervals = list(dict.fromkeys(interval for interval, _ in unfinished.values()))
        counts = _histogram(keyed, intervals)
        for i, (interval, before) in list(unfinished.items()):
            n = intervals.index(interval)
            for s in sorted(s for m, s in counts if m == n):
                weight, rows, low, high = counts[n, s]
                if before + weight >= targets[i]:
                    break
                before += weight
            left, right = Splitter((*interval.equal, low)), Splitter((*interval.equal, high + 1))
            nearer = left if targets[i] - before <= before + weight - targets[i] else right
            off = min(targets[i] - before, before + weight - targets[i])
            if low < high:
                unfinished[i] = Interval(interval.equal, low, high, PROBES), before
            elif rows == 1 or len(interval.equal) == len(LEVELS) - 1 or (not interval.equal and off <= tolerance * total / shards):
                done[i] = nearer
                del unfinished[i]
            else:
                unfinished[i] = Interval((*interval.equal, low), *_bounds(keyed, (*interval.equal, low)), PROBES), before
    return [done[i] for i in range(len(targets))]


def _bounds(keyed: DataFrame, equal: tuple[int, ...]) -> tuple[int, int]:
    """Extremes of the next key among the rows of a group."""
    held = reduce(lambda a, b: a & b, [F.col(level) == F.lit(value) for level, value in zip(LEVELS, equal, strict=False)])
    return tuple(keyed.filter(held).agg(F.min(LEVELS[len(equal)]), F.max(LEVELS[len(equal)])).first())


def _placed(docs: DataFrame, carried: list[Column], shards: int, tolerance: float, by: str, id_col: str, text_col: str) -> DataFrame:
    if by not in ("bytes", "rows"):
        raise ValueError(f"no such law: {by}")
    keyed = _keyed(docs, carried, id_col, text_col, by)
    found = splitters(keyed, shards, tolerance if by == "bytes" else 0.0)
    shard = reduce(lambda a, b: a + b, [s.behind().cast("int") for s in found], F.lit(0))
    order = ["shard", *LEVELS]
    # the one exchange: ranges of rows, so that a shard is sorted by many tasks; ids count rows inside a task
    ranged = keyed.withColumn("shard", shard).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "shard-ranges")
    ranged = ranged.withColumn("part", F.shiftright("at", _ROW_BITS).cast("int"))
    parts = ranged.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")
    offsets = parts.select("shard", "part", (F.col("first") - before).alias("shift"))
    # a row per shard and task of the exchange, whatever the number of documents
    return ranged.join(F.broadcast(offsets), ["shard", "part"]).withColumn("slot", F.col("at") - F.col("shift"))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, by: str = "bytes", id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Deal documents into ``shards`` consecutive ranges of the sort order, near equal in bytes (``by="rows"``: in rows).

    Returns doc_id, size (bytes of the text in UTF-8 plus 1), text_crc32, law, shard, slot (place in the shard, from 0) and
    grown_shard, which is null as neither law is one of keys. Null text is empty, a null id an id of its own. Equal texts stand in consecutive places;
    a splitter cuts such a group only if no edge of it is within ``tolerance`` of an even share (rows: always where the count says so).
    Rows repeated with their id are told apart by where they are read, so any of them may take either place. Fewer documents than
    shards leave shards empty; an empty table gives an empty result; other columns are ignored.
    """
    out = _placed(docs, [], shards, tolerance, by, id_col, text_col)
    return out.select("doc_id", "size", "text_crc32", F.lit(by).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE, by: str = "bytes", id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write the documents as Parquet, a folder ``shard=N`` each, in the order of the slots.

    The columns of ``docs`` are kept under ``document``, so no name can clash with ``slot``.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    out = _placed(docs, [whole], shards, tolerance, by, id_col, text_col)
    out.select("document", "slot", "shard").write.partitionBy("shard").parquet(path)


# The checksum goes half byte by half byte, low half first, with the 16 remainders of the polynomial worked out in the query.
ORACLE = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(16) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 4),
steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 4),
texts AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, pos, substr(h, pos + 1, 512) AS h FROM (SELECT doc_id, unnest(range(0, greatest(len(h), 1), 512)) AS pos, h FROM texts)),
halves AS (
  SELECT doc_id, flatten(list(list_transform(range(len(h)), lambda i: instr('123456789ABCDEF', h[xor(i, 1) + 1])) ORDER BY pos)) AS x
  FROM pieces GROUP BY doc_id),
checksums AS (
  SELECT doc_id, xor(4294967295, list_reduce(x, lambda c, b: xor(c >> 4, t[(xor(c, b) & 15) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM halves, steps),
sized AS (
  SELECT doc_id, len(h) // 2 + 1 AS size, substr(md5(text), 1, 15) AS k0, substr(md5(doc_id::VARCHAR), 1, 15) AS k1, text_crc32
  FROM texts JOIN checksums USING (doc_id)),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY k0, k1, doc_id)::BIGINT AS upto, sum(size) OVER ()::BIGINT AS total,
    sum(size) OVER (ORDER BY k0 RANGE UNBOUNDED PRECEDING)::BIGINT AS group_upto, sum(size) OVER (PARTITION BY k0)::BIGINT AS group_size,
    count(*) OVER (PARTITION BY k0) AS group_rows FROM sized),
goals AS (SELECT i, total * i // 16 AS goal, 0.01 * total / 16 AS slack FROM (SELECT DISTINCT total FROM summed), range(1, 16) r(i)),
crossed AS (  -- the row each goal falls into, and the weight in front of the cut
  SELECT i, goal, slack, s.*, least(goal - (group_upto - group_size), group_upto - goal) AS group_off FROM goals, summed s
  WHERE upto >= goal AND upto - size < goal),
cuts AS (
  SELECT i, CASE WHEN group_rows = 1 OR group_off > slack
      THEN CASE WHEN goal - (upto - size) <= upto - goal THEN upto - size ELSE upto END
      ELSE CASE WHEN goal - (group_upto - group_size) <= group_upto - goal THEN group_upto - group_size ELSE group_upto END END AS cut FROM crossed),
dealt AS (SELECT s.*, (SELECT count(*) FROM cuts WHERE cut <= s.upto - s.size)::INTEGER AS shard FROM summed s)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY k0, k1, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM dealt
"""
