"""The trie of conversation prefixes, from sorted conversations and the lengths of their common prefixes.

Turns are named by a digest of role and text, and a conversation is the sequence of its names. Conversations are range-sorted and cut into
blocks; what neighbours have in common (LCP) decides everything: a conversation begins a node for each depth beyond its LCP with the one before. Every such candidate
searches its extents for itself, to the right for its members and to the left for its parent, by doubling steps over a sparse table of range
minima. A candidate that leaves its block searches on in a sparse table over whole blocks, and adds up what the blocks on its way have to
say about its depth. Counts, leaves and savings are differences of running sums over an extent.

No task holds more than a block. Conversations of more than ``PIECE`` turns are cut into pieces, which form tries of their own under the digest of
all that precedes them; shared ones are worked off from the deepest, and their totals go to the conversation with the smallest id above.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sized_join import join_group_rows
from .common import written

PIECE = 512
BLOCK_ROWS, BLOCK_TURNS = 50_000, 1 << 20
#: Bytes of a turn's name, from SHA-256.
NAME = 16
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


# --- numbering turns ------------------------------------------------------------------------------------------------

def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position of every row among the rows of its conversation in this task; rows come sorted."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(batch.schema.get_field_index("conv_id")).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        pos = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
        if conv[0] == last:
            pos[:starts[1] if len(starts) > 1 else len(conv)] += n
        last, n = conv[-1], int(pos[-1]) + 1
        yield pa.record_batch([*batch.columns, pa.array(pos, pa.int64())], [*batch.schema.names, "pos"])


def numbered(rows: DataFrame, order: list[Column | str], label: str) -> DataFrame:
    """Add ``pos``, each row's place in its conv_id by ``order``, by one range exchange: a long conversation goes to many tasks."""
    keys = ["conv_id", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("pos", T.LongType())])
    counted = written(ranged.mapInArrow(_count_runs, schema), label)
    # a row per task: its first conversation, and its last one with the rows it has there
    parts = counted.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos")).alias("end"))
    parts = parts.withColumn("upto", F.sum(F.col("end.pos") + 1).over(W.partitionBy("end.conv_id").orderBy("part")))
    by_part = W.orderBy("part")
    before = F.when(F.lag("end.conv_id").over(by_part) == F.col("first"), F.lag("upto").over(by_part))
    carried = parts.select("part", F.col("first").alias("conv_id"), before.alias("before")).filter("before IS NOT NULL")
    return counted.join(F.broadcast(carried), ["part", "conv_id"], "left").withColumn(
        "pos", F.col("pos") + F.coalesce("before", F.lit(0))).drop("part", "before")


def rebuilt_turns(conversations: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, pos, name, chars) of the rebuilt conversations, and the ids of all.

    Every conversation c begins with the first h turns of conversation c - c % ``group`` (towards zero for negative ids), h being crc32 of its id modulo ``most``, and goes on
    with its own turns after its first h.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * NAME)).alias("name"), F.char_length(text).cast("long").alias("chars"))
    own = written(numbered(turns, [F.col("turn").asc_nulls_first(), "name"], "trie-turns").drop("turn"), "trie-own")
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    convs = own.filter("pos = 0").select("conv_id")
    borrowed = own.filter((F.col("pos") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    asked = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), taken.alias("h"))
    heads = asked.join(borrowed, "base").filter("pos < h").select("conv_id", F.lit(0).alias("section"), "pos", "name", "chars")
    tails = own.filter(F.col("pos") >= taken).select("conv_id", F.lit(1).alias("section"), "pos", "name", "chars")
    both = heads.union(tails).withColumnRenamed("pos", "place")
    return numbered(both, ["section", "place"], "trie-rebuilt").select("conv_id", "pos", "name", "chars"), convs


# --- blocks ---------------------------------------------------------------------------------------------------------

def _shared(a: bytes, b: bytes) -> int:
    """Number of leading turns two sequences share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // NAME
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // NAME


_BLOCK = "part int, seq int, first_ctx string, first_keys binary, last_ctx string, last_keys binary, least int, body binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the sorted sequences of a task into blocks; the keys are needed no more once neighbours are compared."""
    rows: list[tuple] = []
    turns = seq = 0

    def block():
        keys = [r[2] for r in rows]
        inner = [_shared(a, b) if r[1] == s[1] else -1 for a, b, r, s in zip(keys, keys[1:], rows, rows[1:])]  # noqa: B905
        body = pickle.dumps({
            "conv": np.array([r[0] for r in rows], np.int64), "inner": np.array(inner, np.int32), "lens": np.array([len(k) // NAME for k in keys], np.int32),
            "chars": np.array([c for r in rows for c in r[3]], np.int64), "goes_on": np.array([r[4] for r in rows], bool),
            "extra": np.array([r[5:8] for r in rows], np.int64), "starts": {i: r[1] for i, r in enumerate(rows) if i == 0 or inner[i - 1] < 0}}, protocol=5)
        ends = [rows[0][1], keys[0], rows[-1][1], keys[-1]]
        return pa.record_batch([pa.array([rows[0][8]], pa.int32()), pa.array([seq], pa.int32()), *[pa.array([e], t) for e, t in zip(
            ends, [pa.string(), pa.binary()] * 2, strict=True)], pa.array([min(inner, default=1 << 30)], pa.int32()), pa.array([body], pa.binary())],
            ["part", "seq", "first_ctx", "first_keys", "last_ctx", "last_keys", "least", "body"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and (len(rows) >= BLOCK_ROWS or turns >= BLOCK_TURNS):
                yield block()
                rows, turns, seq = [], 0, seq + 1
            rows.append(row)
            turns += len(row[3])
    if rows:
        yield block()


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = batch.to_pydict()
        border = [-1 if p is None or p != c else _shared(a, b) for p, c, a, b in zip(
            got["prev_ctx"], got["first_ctx"], got["prev_keys"], got["first_keys"], strict=True)]
        yield pa.record_batch([batch.column("part"), batch.column("seq"), batch.column("no"), pa.array(border, pa.int32()), batch.column("least")],
                              ["part", "seq", "no", "border", "least"])


# --- extents --------------------------------------------------------------------------------------------------------

def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minima of all runs of 2^k values."""
    levels = [values]
    while 2 * (step := 1 << (len(levels) - 1)) <= len(values):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    return levels


def reach_right(table: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each start the last place up to which all values behind it are at least ``least``."""
    at = at.copy()
    for k in range(len(table) - 1, -1, -1):
        fits = at + (1 << k) < len(table[0])
        fits &= table[k][np.where(fits, at + 1, 0)] >= least
        at += fits.astype(at.dtype) << k
    return at


def reach_left(table: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each place the first one from which on all values up to the place, its own included, are at least ``least``."""
    at = at.copy()
    for k in range(len(table) - 1, -1, -1):
        fits = at - (1 << k) >= 0
        fits &= table[k][np.where(fits, at - (1 << k) + 1, 0)] >= least
        at -= fits.astype(at.dtype) << k
    return at


def least_in(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of the values from lo to hi, both included."""
    k = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), np.int64)
    for level in np.unique(k):
        mine = k == level
        out[mine] = np.minimum(table[level][lo[mine]], table[level][hi[mine] - (1 << int(level)) + 1])
    return out


CLOSED, OPEN, PASSED = 0, 1, 2
_FOUND = ("kind int, no long, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends_sha string, ends binary, "
          "parent_conv long, parent_in boolean, ctx string")


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that begin in a block, whole (CLOSED) or as far as the block goes (OPEN), and what the block adds to nodes that come in (PASSED)."""
    for batch in batches:
        for row in batch.to_pylist():
            yield _block_nodes(row["no"], row["border"], row["following"], pickle.loads(row["body"]))


def _block_nodes(no: int, border: int, following: int, body: dict) -> pa.RecordBatch:
    conv, lens, goes_on, extra = body["conv"], body["lens"].astype(np.int64), body["goes_on"], body["extra"]
    n = len(conv)
    lcp = np.concatenate([[border], body["inner"]]).astype(np.int64)
    behind = np.append(lcp[1:], following)
    first = np.concatenate([[0], np.cumsum(lens)])
    sums = np.concatenate([[0], np.cumsum(body["chars"])])
    chars = lambda i, k: sums[first[i] + np.maximum(k, 0)] - sums[first[i]]  # noqa: E731 - code points of the first k turns
    shared, ids = sparse_table(lcp), sparse_table(conv)
    running = lambda x: np.concatenate([[0], np.cumsum(x)])
    leaves = running(np.where(goes_on, extra[:, 1], behind < lens))
    saved, below = running(chars(np.arange(n), lcp)), running(extra[:, 2])

    # equal sequences that end here, ids ascending, stand at the front of their node
    run_start = np.ones(n, bool)
    run_start[1:] = ~((lcp[1:] == lens[1:]) & (lens[1:] == lens[:-1]) & (goes_on[1:] == goes_on[:-1]))
    starts = np.flatnonzero(run_start)
    run_end = np.empty(n, np.int64)
    run_end[starts] = np.append(starts[1:], n)
    ends = lambda i: ",".join(map(str, conv[i:run_end[i]].tolist())).encode()

    # candidates: row i begins the nodes of the depths behind its LCP
    new = lens - lcp
    at = np.concatenate([[0], np.cumsum(new)])
    i = np.repeat(np.arange(n), new)
    depth = np.arange(at[-1]) - at[i] + lcp[i] + 1
    right = reach_right(shared, i, depth)
    left = reach_left(shared, i, depth - 1)
    parent_in = (left == 0) & (border >= depth - 1) & (depth > 0)
    is_open = (right == n - 1) & (following >= depth)
    children = np.zeros(len(i), np.int64)
    passed_children = np.zeros(max(border, 0) + 2, np.int64)

    def add_children(lefts, depths, comes_in, count):
        inside = ~comes_in
        np.add.at(children, at[lefts[inside]] + depths[inside] - lcp[lefts[inside]] - 1, count[inside])
        np.add.at(passed_children, depths[comes_in], count[comes_in])

    has_parent = depth > 0
    add_children(left[has_parent], depth[has_parent] - 1, parent_in[has_parent], np.ones(int(has_parent.sum()), np.int64))
    more = np.flatnonzero(extra[:, 0])  # children in the next pieces
    if len(more):
        lefts = reach_left(shared, more, lens[more])
        add_children(lefts, lens[more], (lefts == 0) & (border >= lens[more]), extra[more, 0])

    n_convs = right - i + 1
    saving = saved[right + 1] - saved[i + 1] - (n_convs - 1) * chars(i, depth - 1) + below[right + 1] - below[i]
    node_ids = least_in(ids, i, right)
    parent = at[left] + depth - 1 - lcp[left] - 1
    known = has_parent & ~parent_in
    known[known] = ~is_open[parent[known]]
    parents = np.where(known, node_ids[np.where(known, parent, 0)], 0) if len(i) else node_ids
    own = (depth == lens[i]) & ~goes_on[i]
    sha = [hashlib.sha256(ends(k)).hexdigest() if o and not w else (None if w else _EMPTY) for k, o, w in zip(i.tolist(), own.tolist(), is_open.tolist(), strict=True)]
    texts = [ends(k) if o and w else None for k, o, w in zip(i.tolist(), own.tolist(), is_open.tolist(), strict=True)]
    ctx = [body["starts"].get(k) if d == 0 else None for k, d in zip(i.tolist(), depth.tolist(), strict=True)]

    # what comes in from the left passes through the first rows
    deep = np.arange(border + 1)
    stop = reach_right(shared, np.zeros(len(deep), np.int64), deep) + 1
    zero = np.zeros(len(deep), np.int64)
    passed = saved[stop] - stop * chars(zero, deep - 1) + below[stop]
    ended = [ends(0) if d == lens[0] and not goes_on[0] else None for d in deep.tolist()]

    def column(a, b, kind):
        return pa.array(np.concatenate([a, b]).astype(np.int64), kind)

    total = len(i) + len(deep)
    return pa.record_batch([
        pa.array(np.concatenate([is_open.astype(np.int32), np.full(len(deep), PASSED, np.int32)])), pa.array(np.full(total, no, np.int64)),
        pa.array(np.concatenate([depth, deep]).astype(np.int32)), column(node_ids, least_in(ids, zero, stop - 1), pa.int64()),
        column(n_convs, stop, pa.int64()), column(children, passed_children[:len(deep)], pa.int64()),
        column(leaves[right + 1] - leaves[i], leaves[stop], pa.int64()), column(saving, passed, pa.int64()),
        pa.array(sha + [None] * len(deep), pa.string()), pa.array(texts + ended, pa.binary()),
        pa.array(np.append(parents, zero), pa.int64(), mask=np.append(~known, np.ones(len(deep), bool))),
        pa.array(np.append(parent_in, np.zeros(len(deep), bool))), pa.array(ctx + [None] * len(deep), pa.string())],
        [f.split(" ")[0] for f in _FOUND.split(", ")])


def _covers(least: np.ndarray):
    """Blocks that an open node reaches into, from a sparse table over whole blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sparse_table(least)
        for batch in batches:
            no, depth = (batch.column(c).to_numpy() for c in ("no", "depth"))
            last = np.minimum(reach_right(table, no.astype(np.int64), depth.astype(np.int64)) + 1, len(least) - 1)
            size = last - no
            start, deep = np.repeat(no, size), np.repeat(depth, size)
            into = np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size) + start + 1
            yield pa.record_batch([pa.array(start, pa.int64()), pa.array(into, pa.int64()), pa.array(deep, pa.int32())], ["start", "no", "depth"])
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the id lists of a node, which come block by block and are not gathered."""
    current, state, pieces = None, None, 0
    for batch in batches:
        out = []
        for start, depth, ends in zip(*(batch.column(c).to_pylist() for c in ("start", "depth", "ends")), strict=True):
            if (start, depth) != current:
                if current:
                    out.append((*current, state.hexdigest()))
                current, state, pieces = (start, depth), hashlib.sha256(), 0
            state.update((b"," if pieces else b"") + ends)
            pieces += 1
        yield _digest_rows(out)
    if current:
        yield _digest_rows([(*current, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    start, depth, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(start, pa.int64()), pa.array(depth, pa.int32()), pa.array(sha, pa.string())], ["start", "depth", "sha"])


def _level(rows: DataFrame) -> DataFrame:
    """All nodes of the tries of one level, by context: conv_id, depth, ctx (of depth 0), parent_conv and the figures."""
    keys = ["ctx", "keys", "goes_on", "conv_id"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv_id", "ctx", "keys", "chars", "goes_on", "x_children", "x_leaves", "x_saved", F.spark_partition_id().alias("part"))
    blocks = written(ranged.mapInArrow(_blocks, _BLOCK), "trie-blocks")
    in_order = W.orderBy("part", "seq")  # a row per block: its two outer sequences
    outer = blocks.drop("body", "last_ctx", "last_keys").join(blocks.select(
        "part", "seq", F.lag("last_ctx").over(in_order).alias("prev_ctx"), F.lag("last_keys").over(in_order).alias("prev_keys"),
        (F.row_number().over(in_order) - 1).cast("long").alias("no")), ["part", "seq"])
    borders = written(outer.mapInArrow(_borders, "part int, seq int, no long, border int, least int"), "trie-borders")
    following = F.coalesce(F.lead("border").over(W.orderBy("no")), F.lit(-1)).alias("following")
    around = F.broadcast(borders.select("part", "seq", "no", "border", following))  # five numbers per block
    found = written(blocks.join(around, ["part", "seq"]).mapInArrow(_nodes, _FOUND), "trie-found")
    # one number per block goes to the driver
    least = np.array([min(r[0], r[1]) for r in borders.orderBy("no").select("border", "least").collect()], np.int64)
    opened = found.filter(F.col("kind") == OPEN)
    cover = written(opened.select("no", "depth").mapInArrow(_covers(least), "start long, no long, depth int"), "trie-cover")
    sums = [F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]]
    own = opened.select(F.col("no").alias("start"), "no", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
    passed = found.filter(F.col("kind") == PASSED).select("no", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
    parts = written(own.union(cover.join(passed, ["no", "depth"]).select(own.columns)), "trie-parts")
    shas = parts.filter("ends IS NOT NULL").select("start", "depth", "no", "ends").repartition("start", "depth").sortWithinPartitions("start", "depth", "no")
    shas = shas.mapInArrow(_digests, "start long, depth int, sha string")
    wholes = written(parts.groupBy("start", "depth").agg(*sums).join(shas, ["start", "depth"], "left"), "trie-wholes")
    parents = wholes.select(F.col("start").alias("no"), "depth", F.lit(False).alias("parent_in"), F.col("conv_id").alias("above")).union(
        cover.join(wholes, ["start", "depth"]).select("no", "depth", F.lit(True), "conv_id")).withColumnRenamed("depth", "parent_depth")
    told = opened.drop("conv_id", "n_convs", "n_children", "n_leaves", "saved").join(wholes.withColumnRenamed("start", "no"), ["no", "depth"])
    columns = ["no", "depth", "parent_in", "parent_conv", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "sha", "ctx"]
    nodes = found.filter(F.col("kind") == CLOSED).withColumn("sha", F.col("ends_sha")).select(columns).union(
        told.withColumn("sha", F.coalesce("sha", F.lit(_EMPTY))).select(columns))
    sure = (F.col("depth") == 0) | F.col("parent_conv").isNotNull()
    rest = nodes.filter(~sure).withColumn("parent_depth", F.col("depth") - 1)
    rest = join_group_rows(rest, parents, ["no", "parent_depth", "parent_in"]).withColumn("parent_conv", F.col("above"))
    return nodes.filter(sure).union(rest.select(columns))


def _pieces(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, piece, keys, chars): at most ``PIECE`` turns a row; a conversation without turns has one empty piece."""
    piece = F.floor(F.col("pos") / PIECE).cast("int").alias("piece")
    rows = turns.select("conv_id", piece, F.struct("pos", "name", "chars").alias("turn"))
    rows = rows.union(convs.select("conv_id", F.lit(0), F.lit(None).cast(rows.schema["turn"].dataType)))
    held = F.sort_array(F.collect_list("turn"))
    packed = rows.groupBy("conv_id", "piece").agg(held.alias("turns"))
    keys = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), ""))
    return packed.select("conv_id", "piece", keys.alias("keys"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def _contexts(pieces: DataFrame) -> DataFrame:
    """Pieces behind the first: digest of all that precedes them (ctx), how many share it (sharing), and the smallest id among all
    conversations that begin so, those that end there included (owner)."""
    full = F.size("chars") == PIECE
    long = pieces.filter(full).select("conv_id").distinct()
    digest = F.sha2(F.concat(F.col("piece").cast("string"), F.lit(":"), F.hex("keys")).cast("binary"), 256)
    several = pieces.join(long, "conv_id", "left_semi").select("conv_id", "piece", full.alias("full"), digest.alias("digest"))
    upto = W.partitionBy("conv_id").orderBy("piece").rowsBetween(W.unboundedPreceding, 0)  # digests, one per piece
    sums = [F.sum(F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(20,0)")).over(upto).cast("string") for at in (1, 16)]
    through = several.filter("full").select("conv_id", (F.col("piece") + 1).alias("piece"), F.concat_ws("-", *sums).alias("ctx"))
    through = written(through, "trie-through")
    behind = through.join(several.filter("piece > 0").select("conv_id", "piece", F.lit(1).alias("there")), ["conv_id", "piece"], "left")
    behind = written(behind, "trie-behind")
    groups = behind.groupBy("piece", "ctx").agg(F.count("there").alias("sharing"), F.min("conv_id").alias("owner"))
    return join_group_rows(behind.filter("there = 1").drop("there"), groups.filter("sharing > 0"), ["piece", "ctx"])


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of conversations given as turns (conv_id, pos, name, chars) and ids (conv_id); see :func:`prefix_trie`."""
    pieces = written(_pieces(turns, convs), "trie-pieces")
    contexts = written(_contexts(pieces), "trie-shared")
    deepest = contexts.filter("sharing > 1").agg(F.max("piece")).first()[0] or 0
    above = contexts.select("conv_id", (F.col("piece") - 1).alias("piece"), F.col("ctx").alias("next_ctx"), F.col("sharing").alias("next_sharing"))
    out, totals = [], None
    for level in range(deepest, -1, -1):
        rows = pieces.filter(F.col("piece") == level)
        if level:
            rows = rows.join(contexts.filter("sharing > 1").select("conv_id", "piece", "ctx"), ["conv_id", "piece"])
        else:
            rows = rows.withColumn("ctx", F.lit(""))
        rows = rows.join(above, ["conv_id", "piece"], "left")
        goes_on, alone = F.col("next_ctx").isNotNull(), F.when(F.col("next_sharing") == 1, 1)
        if totals is None:
            empty = rows.sparkSession.createDataFrame([], "next_ctx string, conv_id long, t_children long, t_leaves long, t_saved long")
            totals = empty
        # the smallest member stands for all that follows a shared piece
        rows = rows.join(totals, ["next_ctx", "conv_id"], "left").select(
            "conv_id", "ctx", "keys", "chars", goes_on.alias("goes_on"), F.coalesce(alone, "t_children", F.lit(0)).cast("long").alias("x_children"),
            F.coalesce(alone, "t_leaves", F.lit(0)).cast("long").alias("x_leaves"), F.coalesce("t_saved", F.lit(0)).alias("x_saved"))
        nodes = written(_level(rows), "trie-nodes")
        totals = nodes.filter("depth = 0").select(F.col("ctx").alias("next_ctx"), "conv_id", F.col("n_children").alias("t_children"),
                                                  F.col("n_leaves").alias("t_leaves"), F.col("saved").alias("t_saved"))
        shown = nodes
        if level:  # what ends above belongs to the parent too
            owners = contexts.filter(F.col("piece") == level).select("ctx", "owner").distinct()
            owners = nodes.filter("depth = 0").select("ctx", F.col("conv_id").alias("parent_conv")).join(owners, "ctx").drop("ctx")
            highest = join_group_rows(nodes.filter("depth = 1"), owners, ["parent_conv"]).withColumn("parent_conv", F.col("owner"))
            shown = nodes.filter("depth > 1").union(highest.select(nodes.columns))
        out.append(shown.select("conv_id", (F.col("depth") + level * PIECE).cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"),
                                "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256")))
    # pieces that nobody shares are chains
    lone = contexts.filter("sharing = 1").select("conv_id", "piece", "owner")
    lone = pieces.join(lone, ["conv_id", "piece"]).join(above.select("conv_id", "piece", F.lit(True).alias("goes_on")), ["conv_id", "piece"], "left")
    lone = lone.select("conv_id", "piece", "owner", "goes_on", F.size("chars").alias("n"), F.posexplode("chars").alias("at", "_"))
    last = F.col("goes_on").isNull() & (F.col("at") == F.col("n") - 1)
    out.append(lone.select(
        "conv_id", (F.col("piece") * PIECE + F.col("at") + 1).cast("long").alias("depth"), F.when(F.col("at") == 0, F.col("owner")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(_EMPTY).alias("ends_sha256")))
    nodes = out[0]
    for more in out[1:]:
        nodes = nodes.union(more)
    return nodes


def prefix_trie(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (see :func:`rebuilt_turns`), the empty one included.

    Returns conv_id (the smallest member), depth, parent_conv_id (that of the prefix one turn shorter; the root's is null), n_convs (members), n_children,
    n_leaves (childless prefixes that begin with this one, itself included), saved_tokens (over those prefixes, the code points of the last text times
    the members but one) and ends_sha256 (digest of the ids of the members that end here, ascending). Turns are ordered by turn, null first; rows with
    the same turn by a digest of role and text, and repeated rows are turns of their own. A null role or text is empty. Rows without conv_id belong to
    no conversation and are left out. An empty table gives an empty result; other columns are ignored.
    """
    return trie(*rebuilt_turns(conversations, group, most))


ORACLE = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
own AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(len(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS name,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(4294967295, list_reduce(list_transform(range(len(conv_id::VARCHAR)), lambda i: ord(substr(conv_id::VARCHAR, i + 1, 1))),
                                lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own), steps),
turns AS (
  SELECT c.conv_id, 0 AS section, o.pos, o.name, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.name, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h),
members AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(name, '') OVER w AS path, len(text) AS chars,
    count(*) OVER (PARTITION BY conv_id) AS length
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY section, pos)
  UNION ALL SELECT c.conv_id, 0, '', 0, (SELECT count(*) FROM turns t WHERE t.conv_id = c.conv_id) FROM convs c),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
  FROM members GROUP BY depth, path),
children AS (SELECT left(path, (depth - 1) * 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
ups AS (SELECT left(n.path, 32 * j) AS top, n.saved, (c.n IS NULL)::INTEGER AS leaf
        FROM (SELECT *, unnest(range(depth + 1)) AS j FROM nodes) n LEFT JOIN children c ON c.path = n.path),
sums AS (SELECT top, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM ups GROUP BY top)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, (n.depth - 1) * 32) LEFT JOIN children c ON c.path = n.path
JOIN sums s ON s.top = n.path
"""
