"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits of the fingerprints that go together are put into one of m parts. If two fingerprints differ in at most
tau bits, then for any thresholds that add up to tau - m + 1 they differ in at most T_i bits in some part i.
Every fingerprint gets thresholds of its own, by dynamic programming on the candidates it must expect in each part,
probes the parts within them, and verifies what it finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, text_groups, word_spans, written
from .components import connected

GROUP_BYTES = 1 << 20
HASHES = 1 << 18
BITS = 64
SEED = 42
#: Buckets of more fingerprints are searched through the fingerprints' one-bit neighbours instead.
CROWDED = 512


def shingle_spans(data: np.ndarray, offsets: np.ndarray, width: int):
    """Words joined by single spaces, and the spans and texts of all shingles; shorter texts give one."""
    starts, ends, text = word_spans(data, offsets)
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(at[-1], 32, np.uint8)
    joined[np.repeat(at[:-1] - starts, size) + _runs(starts, size)] = data[_runs(starts, size)]
    n_words = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n_words)])
    shingles = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(shingles)), shingles)
    word = _runs(first[:-1], shingles)
    last = np.minimum(word + width, first[owner + 1]) - 1
    return joined, at[word], at[last] + size[last], owner, shingles


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run, one after another."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    return np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the lower-cased texts: a bit is set if over half the shingles' hashes have it."""
    joined, a, b, owner, shingles = shingle_spans(lowered(data), offsets, width)
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    counts = np.zeros((len(shingles), BITS), np.int64)
    for lo in range(0, len(a), HASHES):  # a long text has its hashes made and counted piece by piece
        i, j, text = a[lo:lo + HASHES].tolist(), b[lo:lo + HASHES].tolist(), owner[lo:lo + HASHES]
        hashes = np.fromiter((digest(raw[x:y], SEED) for x, y in zip(i, j, strict=True)), np.uint64, len(i))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        counts[text[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    packed = np.packbits(2 * counts > shingles[:, None], axis=1)
    return packed.view(">u8").ravel().astype(np.uint64)


def _fingerprint_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in text_groups(batches, "text", GROUP_BYTES):
            ids = batch.column(batch.schema.get_field_index("doc_id")).slice(lo, hi - lo)
            yield pa.record_batch([ids, pa.array(fingerprints_of(data, offsets, width).view(np.int64))], ["doc_id", "fp"])
    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair of bits is set in the same fingerprint; pair (i, i) counts bit i, pair (64, 64) rows."""
    total = np.zeros((BITS + 1, BITS + 1))
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(fp), 1 << 15):
            bits = np.ones((len(fp[lo:lo + (1 << 15)]), BITS + 1), np.float32)
            bits[:, :BITS] = np.unpackbits(fp[lo:lo + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            total += (bits.T @ bits).astype(float)
    i, j = np.triu_indices(BITS + 1)
    yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])


def grouped_bits(together: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into parts of nearly equal width, each grown from a free bit by its closest correlations."""
    n = max(together[BITS, BITS], 1)
    p = np.diag(together)[:BITS] / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((together[:BITS, :BITS] / n - np.outer(p, p)) / np.outer(spread, spread))
    free, out = set(range(BITS)), []
    for left in range(parts, 0, -1):
        group = [min(free)]
        free.discard(group[0])
        for _ in range(-(-(len(free) + 1) // left) - 1):
            nearest = max(sorted(free), key=lambda b: tie[b, group].sum())
            group.append(nearest)
            free.discard(nearest)
        out.append(sorted(group))
    return out


def allocation(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds per row that add up to ``total`` at the least cost, by dynamic programming over the parts.

    ``costs[r, i, t + 1]`` is what part i costs row r at threshold t, from -1 (not probed) on.
    """
    rows, parts, options = costs.shape
    # state s: sum of (t + 1) over the parts so far
    goal = total + parts
    best = np.full((rows, goal + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((parts, rows, goal + 1), np.int64)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for option in range(min(options, goal + 1)):
            value = best[:, :goal + 1 - option] + costs[:, i, option][:, None]
            better = value < new[:, option:]
            new[:, option:][better] = value[better]
            took[i][:, option:][better] = option
        best = new
    state, out = np.full(rows, goal), np.zeros((rows, parts), np.int64)
    for i in range(parts - 1, -1, -1):
        out[:, i] = took[i][np.arange(rows), state]
        state = state - out[:, i]
    return out - 1


def _masks(groups: list[list[int]]) -> list[int]:
    """Bit masks of the parts; bit 0 of the correlation table is the highest."""
    return [sum(1 << (BITS - 1 - b) for b in group) for group in groups]


def _probe_rows(groups: list[list[int]], tau: int, n: int):
    masks = np.array(_masks(groups), np.uint64)
    widths = [len(g) for g in groups]
    flips = [[np.array([sum(1 << (BITS - 1 - b) for b in chosen) for chosen in combinations(g, t)], np.uint64)
              for t in range(tau + 1)] for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(groups))], 1).astype(float)
            costs = np.zeros((len(fp), len(groups), tau + 2))
            for i, width in enumerate(widths):
                costs[:, i, 1] = 1 + np.minimum(own[:, i], BITS + 1)  # a crowded bucket costs its one-bit neighbours
                for t in range(1, tau + 1):
                    costs[:, i, t + 1] = costs[:, i, t] + comb(width, t) * (1 + n / 2.0 ** width)
            thresholds = allocation(costs, tau - len(groups) + 1)
            part, value, source = [], [], []
            for i in range(len(groups)):
                for t in range(tau + 1):
                    chosen = fp[thresholds[:, i] >= t]
                    keys = ((chosen & masks[i])[:, None] ^ flips[i][t][None]).ravel()
                    part.append(np.full(len(keys), i, np.int32))
                    value.append(keys)
                    source.append(np.repeat(chosen, len(flips[i][t])))
            yield pa.record_batch([pa.array(np.concatenate(part)), pa.array(np.concatenate(value).view(np.int64)),
                                   pa.array(np.concatenate(source).view(np.int64))], ["part", "value", "fp"])
    return run


def spanning(members: np.ndarray, probes: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Verify a bucket: a forest of links that joins what pairs within tau bits join, at most one link per row."""
    nodes, where = np.unique(np.concatenate([members, probes]), return_inverse=True)
    a, b = where[:len(members)], where[len(members):]
    left, right = [], []
    for lo in range(0, len(probes), 1024):
        near = np.bitwise_count(probes[lo:lo + 1024, None] ^ members[None]) <= tau
        i, j = np.nonzero(near)
        left.append(b[i + lo])
        right.append(a[j])
    left, right = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def _verified(tau: int):
    def links(key_runs) -> pa.RecordBatch:
        u, v = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for kind, fp in key_runs:
            members, probes = fp[kind == 0], fp[kind == 1]
            if len(members) and len(probes) and (len(members) > 1 or (probes != members[0]).any()):
                a, b = spanning(members, probes, tau)
                u.append(a)
                v.append(b)
        return pa.record_batch([pa.array(np.concatenate(u).view(np.int64)), pa.array(np.concatenate(v).view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last, perhaps unfinished bucket
        for batch in batches:
            part, value, kind, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            rows = [part, value, kind, fp.view(np.uint64)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            part, value, kind, fp = rows
            if not len(part):
                continue
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1])) + 1
            bounds = np.concatenate([[0], cuts])
            yield links((kind[a:b], fp[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
            held = [x[bounds[-1]:] for x in rows]
        if held is not None:
            yield links([(held[2], held[3])])
    return run


def _neighbour_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under itself and its 64 one-bit neighbours; two meet there iff 2 or fewer bits differ."""
    flips = np.concatenate([[0], 1 << np.arange(BITS, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(fp), 4096):
            own = fp[lo:lo + 4096]
            yield pa.record_batch([pa.array((own[:, None] ^ flips[None]).ravel().view(np.int64)),
                                   pa.array(np.repeat(own, len(flips)).view(np.int64))], ["key", "fp"])


def _value(groups: list[list[int]]):
    """Column array of the parts of a fingerprint."""
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in _masks(groups)]
    return F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)])


def links(distinct: DataFrame, tau: int = 2, parts: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of fingerprints within ``tau`` bits.

    ``distinct`` has one bigint column fp without repeats. Buckets of at most ``crowded`` fingerprints
    are verified pair by pair inside one task; a bucket gives at most one link per row. Fuller
    buckets are never gathered: their members, and whoever probes them, meet under their one-bit neighbours, 65
    rows each and at most 65 under one key. Needs tau <= 2 for that.
    """
    if tau > 2:
        raise ValueError("one-bit neighbours find pairs of at most 2 differing bits")
    together = np.zeros((BITS + 1, BITS + 1))
    for row in distinct.mapInArrow(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        together[row["i"], row["j"]] = together[row["j"], row["i"]] = row["n"]
    n = int(together[BITS, BITS])
    if parts is None:  # narrower parts as long as a part's values outnumber the fingerprints
        parts = max(k for k in (1, 2, 3) if k == 1 or 2 ** (BITS // k) >= n / 8)
    groups = grouped_bits(together, parts)
    index = distinct.select("fp", F.explode(_value(groups)).alias("x")).select("fp", "x.part", "x.value")
    sizes = written(index.groupBy("part", "value").agg(F.count("*").alias("n")), "simhash-sizes")
    known = index.join(sizes, ["part", "value"])
    own = known.groupBy("fp").agg(*[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(parts)])
    probes = written(own.mapInArrow(_probe_rows(groups, tau, n), "part int, value long, fp long"), "simhash-probes")
    full = sizes.filter(F.col("n") > crowded).select("part", "value")
    rows = index.select("part", "value", F.lit(0).alias("kind"), "fp").union(probes.select("part", "value", F.lit(1).alias("kind"), "fp"))
    # buckets with one member and its own probe alone can't link anything
    loose = rows.join(full, ["part", "value"], "left_anti")
    # by a hash of the key: a repartition by the join's own keys would be planned away, and the join's partitions are
    # read piecemeal once it turns into a broadcast join at run time
    found = loose.repartition(F.xxhash64("part", "value")).sortWithinPartitions("part", "value").mapInArrow(_verified(tau), "u long, v long")
    met = rows.join(full, ["part", "value"], "left_semi").select("fp").distinct()
    keys = met.mapInArrow(_neighbour_keys, "key long, fp long")
    first = keys.groupBy("key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = first.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).filter("u <> v")
    return found.union(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, tau: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group texts whose SimHash fingerprints are linked by chains of at most ``tau`` differing bits.

    Returns doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id of the group, its own included. Texts
    without words, null ones too, have fingerprint zero and link like others. A null doc_id is never a component_id unless the
    whole group lacks ids. Repeated rows give repeated results; an empty table an empty one; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = written(rows.mapInArrow(_fingerprint_rows(width), "doc_id long, fp long"), "simhash-fingerprints")
    first = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected(links(first.select("fp"), tau), "simhash-links")
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    component = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(component, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
