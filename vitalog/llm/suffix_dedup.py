"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that also starts earlier covers it. Every such string (window) has an anchor, the leftmost of
its smallest 37-byte grams; equal windows have equal anchors at the same place. Only anchors that occur
more than once matter; the text around them (consecutive windows with one anchor: an instance) meets in shards.
There the suffixes that begin at the anchors, and the reversed prefixes that end there, are merge-sorted; two suffixes
are compared by binary search for their common extension on prefix polynomial hashes. Extensions of neighbours in the
sorted order are verified byte by byte, and tell which windows are equal.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MESSAGE, block_tasks, by_block, by_shard, from_small, grouped, load, message, new_folder, save, sent, small
from .common import mixed, powers, text_groups, written
from .elias_fano import EliasFano, encode

BLOCK_BYTES = 4 << 20
#: Windows per instance at most; their results fit the bits of one number.
SPAN = 64
#: Anchors with more different surroundings than this are dealt out window by window.
CROWDED = 16_384
CHUNK = 1 << 20
NO_ID = np.iinfo(np.int64).max


# --- windows and anchors --------------------------------------------------------------------------------------------

def _window_anchors(data: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of SPAN consecutive grams the place of the leftmost smallest one; also its hash."""
    n = len(data) - gram - SPAN + 2
    up, _ = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    _, down = powers(len(data) + 1)
    value = mixed((prefix[gram:] - prefix[:-gram]) * down[:len(data) - gram + 1])
    key = value & ~np.uint64((1 << 22) - 1) | np.arange(len(value), dtype=np.uint64)
    step = 1
    while step < SPAN:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    place = (key[:n] & np.uint64((1 << 22) - 1)).astype(np.int64)
    return place, value[place]


def instances(data: np.ndarray, offsets: np.ndarray, length: int):
    """Anchors of all windows of the texts: place, hash, first and last start of the windows, and text."""
    gram = length - SPAN + 1
    place, value, first, last, text = [], [], [], [], []
    for lo in range(0, max(len(data) - length + 1, 0), CHUNK):
        part = data[lo:lo + CHUNK + length - 1]
        at, hashed = _window_anchors(part, gram)
        start = np.arange(len(at)) + lo
        owner = np.searchsorted(offsets, start, side="right") - 1
        ok = start + length <= offsets[owner + 1]
        at, hashed, start, owner = at[ok] + lo, hashed[ok], start[ok], owner[ok]
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
        place.append(at[new])
        value.append(hashed[new])
        first.append(start[new])
        last.append(np.concatenate([start[new[1:] - 1], start[-1:]]))
        text.append(owner[new])
    if not place:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in (place, value, first, last, text))


# --- suffix sort ----------------------------------------------------------------------------------------------------

class Extensions:
    """Common extensions of places in a buffer, by binary search on prefix polynomial hashes.

    ``sign`` 1 extends to the right from each place, -1 to the left of it; ``room`` is how far each place may go.
    """

    def __init__(self, data: np.ndarray, place: np.ndarray, room: np.ndarray, sign: int, base: int) -> None:
        self.data, self.place, self.room, self.sign = data, place, room, sign
        self.up, _ = powers(len(data) + 1, base)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:-1], out=self.prefix[1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of the places numbered i and j, as far as the hashes tell."""
        x, y = self.place[i], self.place[j]
        limit = np.minimum(self.room[i], self.room[j])
        lo, hi = np.zeros(len(i), np.int64), limit.copy()
        px, py = self.prefix[x], self.prefix[y]
        if self.sign > 0:
            ux, uy = self.up[x], self.up[y]
        while (lo < hi).any():
            middle = (lo + hi + 1) >> 1
            if self.sign > 0:
                same = (self.prefix[x + middle] - px) * uy == (self.prefix[y + middle] - py) * ux
            else:
                a, b = x - middle, y - middle
                same = (px - self.prefix[a]) * self.up[b] == (py - self.prefix[b]) * self.up[a]
            lo, hi = np.where(same, middle, lo), np.where(same, hi, middle - 1)
        return lo

    def _byte(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Byte after (before) an extension, -1 at the end of the room."""
        place = self.place[at] + depth if self.sign > 0 else self.place[at] - depth - 1
        inside = depth < self.room[at]
        return np.where(inside, self.data[np.where(inside, place, 0)].astype(np.int64), -1)

    def less(self, i: np.ndarray, j: np.ndarray, equal: bool) -> np.ndarray:
        """Whether suffix i sorts before suffix j (or is equal, if ``equal``)."""
        depth = self.common(i, j)
        a, b = self._byte(i, depth), self._byte(j, depth)
        return (a <= b) if equal else (a < b)

    def verified(self, i: np.ndarray, j: np.ndarray, depth: np.ndarray) -> bool:
        """Whether the bytes of all these common extensions are equal and do end there."""
        for lo in range(0, len(i), 1 << 14):
            a, b, d = i[lo:lo + (1 << 14)], j[lo:lo + (1 << 14)], depth[lo:lo + (1 << 14)]
            step = np.arange(max(int(d.max(initial=0)), 1))
            inside = step[None] < d[:, None]
            go = step if self.sign > 0 else -1 - step
            x = np.where(inside, self.place[a][:, None] + go, 0)
            y = np.where(inside, self.place[b][:, None] + go, 0)
            if (self.data[x] != self.data[y]).any():
                return False
            u, v = self._byte(a, d), self._byte(b, d)
            if ((u == v) & (u >= 0)).any():
                return False
        return True


def merge_sorted(group: np.ndarray, extensions: Extensions) -> np.ndarray:
    """Numbers of the suffixes in order of group, then content: mergesort, all runs of a level at once."""
    order = np.argsort(group, kind="stable")
    if not len(order):
        return order
    begin = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]])
    size = np.diff(begin)
    start, stop = np.repeat(begin[:-1], size), np.repeat(begin[1:], size)
    run = 1
    while run < size.max():
        at = np.arange(len(order))
        pair = start + (at - start) // (2 * run) * (2 * run)
        middle, end = np.minimum(pair + run, stop), np.minimum(pair + 2 * run, stop)
        moving = np.flatnonzero(middle < end)
        at, pair, middle, end = at[moving], pair[moving], middle[moving], end[moving]
        left = at < middle
        # how many of the other run come before this suffix; equal ones keep the left run first
        lo, hi = np.where(left, middle, pair), np.where(left, end, middle)
        base = lo.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            probe = (lo[open_] + hi[open_]) >> 1
            other, own, from_left = order[probe], order[at[open_]], left[open_]
            before = np.empty(len(open_), bool)
            before[from_left] = extensions.less(other[from_left], own[from_left], equal=False)
            before[~from_left] = extensions.less(other[~from_left], own[~from_left], equal=True)
            lo[open_] = np.where(before, probe + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], probe)
        target = pair + (at - np.where(left, pair, middle)) + (lo - base)
        merged = order.copy()
        merged[target] = order[at]
        order, run = merged, 2 * run
    return order


def _sorted_depths(data, place, room, sign, group) -> tuple[np.ndarray, np.ndarray]:
    """Verified order of the suffixes and the common extension of each with the one before (-1 across groups)."""
    for attempt in range(20):
        extensions = Extensions(data, place, room, sign, 0x9E3779B97F4A7C15 + 2 * (attempt << 33))
        order = merge_sorted(group, extensions)
        depth = np.full(len(order), -1, np.int64)
        same = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
        depth[same] = extensions.common(order[same - 1], order[same])
        if extensions.verified(order[same - 1], order[same], depth[same]):
            return order, depth
    raise RuntimeError("hash collisions under twenty bases")


def repeated_windows(data: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Bit mask per instance: bit b is set if the window that starts at ``first + b`` is also in an instance before it.

    Instances are in order of the places they come from; windows are told apart within a group and by their distance
    from the anchor. ``data`` holds each instance's bytes from ``first`` to ``last + length``.
    """
    mask = np.zeros(len(anchor), np.uint64)
    if len(anchor) < 2:
        return mask
    right, right_depth = _sorted_depths(data, anchor, last + length - anchor, 1, group)
    left, left_depth = _sorted_depths(data, anchor, anchor - first, -1, group)
    n = np.uint64(len(anchor))
    for distance in range(int((anchor - first).max()) + 1):
        valid = (anchor - distance >= first) & (anchor - distance <= last)
        if valid.sum() < 2:
            continue
        classes = np.zeros(len(anchor), np.uint64)
        classes[right] = np.cumsum(right_depth < length - distance).astype(np.uint64)
        same_left = np.zeros(len(anchor), np.uint64)
        same_left[left] = np.cumsum(left_depth < distance).astype(np.uint64)
        at = np.flatnonzero(valid)
        _, earliest = np.unique(classes[at] * (n + np.uint64(1)) + same_left[at], return_index=True)
        again = np.ones(len(at), bool)
        again[earliest] = False
        at = at[again]
        mask[at] |= np.uint64(1) << (anchor[at] - distance - first[at]).astype(np.uint64)
    return mask


# --- first round: which anchors occur again ---------------------------------------------------------------------------

def _context_keys(data, first, last, length, anchor, value) -> np.ndarray:
    """Hash of each instance's whole context: equal keys stand for equal bytes around equal anchors."""
    up, down = powers(len(data) + 1, 0xD1342543DE82EF95)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    whole = (prefix[last + length] - prefix[first]) * down[first]
    shape = (anchor - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    return mixed(whole ^ mixed(shape) ^ value)


def _first_of_equal(data, keys, first, last, length, rank) -> np.ndarray:
    """For each instance the earliest one with an equal context in this block, compared byte by byte."""
    order = np.lexsort((rank, keys))
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(order) else np.zeros(0, bool)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    out = np.empty(len(order), np.int64)
    out[order] = head
    copies = np.flatnonzero(out != np.arange(len(out)))
    for lo in range(0, len(copies), 1 << 14):
        at = copies[lo:lo + (1 << 14)]
        size = last[at] - first[at] + length
        step = np.arange(int(size.max()))
        inside = step[None] < size[:, None]
        same = (data[np.where(inside, first[at][:, None] + step, 0)] == data[np.where(inside, first[out[at]][:, None] + step, 0)]).all(1)
        same &= size == last[out[at]] - first[out[at]] + length
        out[at[~same]] = at[~same]
    return out


def _found(block: dict, length: int) -> dict:
    """The instances of a new block in a compact form, to be kept with it."""
    data, offsets, ids = np.frombuffer(block["text"], np.uint8), block["offsets"], block["ids"]
    place, value, first, last, text = instances(data, offsets, length)
    by_id = np.empty(len(ids), np.int64)
    by_id[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    # texts in order of id, then places
    rank = by_id[text] * (len(data) + 1) + first
    head = _first_of_equal(data, _context_keys(data, first, last, length, place, value), first, last, length, rank)
    copies = np.flatnonzero(head != np.arange(len(head)))
    return {"windows": (last - first).astype(np.uint8), "before": (place - first).astype(np.int16), "copies": copies.astype(np.int32)}


def _state(block: dict, length: int):
    """Bytes, text offsets, anchors, first and last start of the instances, their texts, and which are copies."""
    data, offsets = np.frombuffer(block["text"], np.uint8), block["offsets"]
    windows = block["windows"].astype(np.int64)
    of_text = np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - length + 1, 0))])
    number = np.cumsum(windows + 1) - windows - 1
    text = np.searchsorted(of_text, number, side="right") - 1
    first = offsets[text] + number - of_text[text]
    copy = np.zeros(len(first), bool)
    copy[block["copies"]] = True
    return data, offsets, first + block["before"], first, first + windows, text, copy


def _anchor_values(data: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    gram = length - SPAN + 1
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return mixed((prefix[anchor + gram] - prefix[anchor]) * down[anchor])


def _block_anchors(folder: str, shards: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in text_groups(batches, "text", BLOCK_BYTES):
            raw = batch.column(batch.schema.get_field_index("doc_id")).slice(lo, hi - lo)
            ids = raw.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            fields = {"ids": ids, "null": np.asarray(raw.is_null()), "text": data.tobytes(), "offsets": offsets}
            fields |= _found(fields, length)
            block = save(folder, **fields)
            _, _, anchor, _, _, _, copy = _state(fields, length)
            # an anchor counts once per different context; one that comes again in this block counts as two at least
            values, inverse = np.unique(_anchor_values(data, anchor, length), return_inverse=True)
            times = np.bincount(inverse, ~copy, len(values)).astype(np.int64)
            times = np.maximum(times, np.minimum(np.bincount(inverse, minlength=len(values)), 2))
            owner = (values % np.uint64(shards)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[order], np.arange(shards + 1))
            rows = [(block, _nowhere(block, shards), message())]
            for shard in range(shards):
                mine = order[cut[shard]:cut[shard + 1]]
                if len(mine):
                    rows.append((block, shard, message(values=encode(values[mine] // np.uint64(shards)), times=small(times[mine]))))
            yield sent(rows)
    return run


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block's anchors: 0 occurs once, 1 occurs again, 2 occurs in very many contexts."""
    for shard, rows in grouped(batches, "shard"):
        if shard < 0:
            yield sent([(block, shard, message()) for block, _, _ in rows])
            continue
        asked = [EliasFano(m["values"]).all() for _, _, m in rows]
        values, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        times = np.concatenate([from_small(m["times"], len(a)) for a, (_, _, m) in zip(asked, rows, strict=True)])
        total = np.bincount(inverse, times, len(values)).astype(np.int64)
        kind = (total > 1).astype(np.uint8) + (total > CROWDED)
        at, out = 0, []
        for (block, _, _), mine in zip(rows, asked, strict=True):
            out.append((block, shard, message(kind=zlib.compress(kind[inverse[at:at + len(mine)]].tobytes(), 1))))
            at += len(mine)
        yield sent(out)


# --- second round: the contexts of those anchors ----------------------------------------------------------------------

def _chosen(rows, value: np.ndarray, copy: np.ndarray, first, last, shards: int, keys) -> tuple:
    """Instances to send: number, first and last start, and group. Crowded ones go window by window."""
    values, inverse = np.unique(value, return_inverse=True)
    owner = (values % np.uint64(shards)).astype(np.int64)
    kind = np.zeros(len(values), np.uint8)
    for _, shard, body in rows:
        if shard >= 0:
            kind[owner == shard] = np.frombuffer(zlib.decompress(body["kind"]), np.uint8)
    kind = kind[inverse]
    plain, crowded = np.flatnonzero(~copy & (kind == 1)), np.flatnonzero(~copy & (kind == 2))
    count = last[crowded] - first[crowded] + 1
    single = np.repeat(crowded, count)
    start = np.repeat(first[crowded], count) + (np.arange(len(single)) - np.repeat(np.cumsum(count) - count, count))
    return (np.concatenate([plain, single]), np.concatenate([first[plain], start]), np.concatenate([last[plain], start]),
            np.concatenate([value[plain], keys(single, start)]))


def _window_keys(data, length, anchor, value):
    """Group of a single window: its whole content and the anchor's place in it."""
    up, down = powers(len(data) + 1, 0xD1342543DE82EF95)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return lambda at, start: mixed((prefix[start + length] - prefix[start]) * down[start] ^ mixed((anchor[at] - start).astype(np.uint64)) ^ value[at])


def _nowhere(block: str, shards: int) -> int:
    """A shard below zero, whose messages only keep a block in the flow."""
    return -1 - zlib.crc32(block.encode()) % shards


def _block_contexts(folder: str, shards: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, rows in grouped(batches, "block"):
            block = load(path)
            data, _, anchor, first, last, text, copy = _state(block, length)
            value = _anchor_values(data, anchor, length)
            number, a, b, group = _chosen(rows, value, copy, first, last, shards, _window_keys(data, length, anchor, value))
            owner = (mixed(group) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            number, a, b, group = number[order], a[order], b[order], group[order]
            cut = np.searchsorted(owner[order], np.arange(shards + 1))
            plan = save(folder, a=a, windows=(b - a).astype(np.uint8), cut=cut)
            out = [(f"{path} {plan}", _nowhere(path, shards), message())]
            for shard in range(shards):
                mine = slice(cut[shard], cut[shard + 1])
                if cut[shard] == cut[shard + 1]:
                    continue
                size = b[mine] - a[mine] + length
                ends = np.cumsum(size)
                take = np.arange(int(ends[-1])) + np.repeat(a[mine] - (ends - size), size)
                at = number[mine]
                raw = data[take].tobytes()
                out.append((f"{path} {plan}", shard, message(
                    bytes=pa.Codec("zstd", 1).compress(raw, asbytes=True), length=len(raw), windows=small(b[mine] - a[mine]), group=group[mine],
                    before=small(anchor[at] - a[mine]), ids=block["ids"][text[at]], text=text[at].astype(np.int32), start=a[mine].astype(np.int64))))
            yield sent(out)
    return run


def _answer_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in grouped(batches, "shard"):
            if shard < 0:
                yield sent([(block, shard, message()) for block, _, _ in rows])
                continue
            counts = [len(m["ids"]) for _, _, m in rows]
            windows, before = (np.concatenate([from_small(m[k], c) for c, (_, _, m) in zip(counts, rows, strict=True)]) for k in ("windows", "before"))
            data = np.frombuffer(b"".join(pa.Codec("zstd").decompress(m["bytes"], m["length"], asbytes=True) for _, _, m in rows), np.uint8)
            join = lambda k: np.concatenate([m[k] for _, _, m in rows])  # noqa: B023, E731
            size = windows + length
            first = np.cumsum(size) - size
            source = np.repeat(np.arange(len(rows)), counts)
            order = np.lexsort((join("start"), join("text"), source, join("ids")))
            group = np.unique(join("group"), return_inverse=True)[1]
            mask = np.empty(len(order), np.uint64)
            mask[order] = repeated_windows(data, (first + before)[order], first[order], (first + windows)[order], group[order], length)
            out, at = [], 0
            for (block, _, _), count in zip(rows, counts, strict=True):
                out.append((block, shard, message(mask=zlib.compress(mask[at:at + count].tobytes(), 1))))
                at += count
            yield sent(out)
    return run


# --- last round: what is left -----------------------------------------------------------------------------------------

def _removals(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, rows in grouped(batches, "block"):
            path, plan = paths.split(" ")
            block = load(path)
            data, offsets, _, first, last, _, copy = _state(block, length)
            planned = load(plan)
            a, cut = planned["a"], planned["cut"]
            mask = np.zeros(len(a), np.uint64)
            for _, shard, body in rows:
                if shard >= 0:
                    mask[cut[shard]:cut[shard + 1]] = np.frombuffer(zlib.decompress(body["mask"]), np.uint64)
            edge = np.zeros(len(data) + 1, np.int32)
            for bit in range(SPAN):  # windows found again by the shards
                at = a[np.flatnonzero(mask >> np.uint64(bit) & np.uint64(1))] + bit
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
            np.add.at(edge, first[copy], 1)  # contexts found again in this block: all their windows
            np.add.at(edge, last[copy] + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[heads] = gone[heads]
            spans = np.concatenate([[0], np.cumsum(begins)])
            kept = data[~gone].tobytes()
            left = offsets - total[offsets]
            texts = [kept[i:j] for i, j in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
            columns = [pa.array(block["ids"], pa.int64(), mask=block["null"]), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])),
                       pa.array(np.diff(spans[offsets])), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.binary())], [*names, "kept"]
            yield pa.record_batch(columns, names)
    return run


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Take out every byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier means a smaller doc_id, or the same text and an earlier start; all strings are judged on the input. Returns doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and on request kept (the remaining bytes, which may cut
    characters in two). Null text is empty; texts shorter than ``length`` lose nothing. Rows without id come last; rows that share an
    id count as different texts in one fixed order, so one of several equal rows keeps its bytes. An empty table gives an empty result.
    """
    if length < SPAN:
        raise ValueError(f"strings must have at least {SPAN} bytes")
    spark = docs.sparkSession
    folder = new_folder(spark, "suffix-blocks")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (8 << 20))
    tasks = block_tasks(spark, size, BLOCK_BYTES)
    anchors = written(rows.mapInArrow(_block_anchors(folder, shards, length), MESSAGE), "suffix-anchors")
    kinds = by_shard(anchors, shards).mapInArrow(_answer_anchors, MESSAGE)
    contexts = by_block(kinds, tasks).mapInArrow(_block_contexts(folder, shards, length), MESSAGE)
    masks = by_shard(contexts, shards).mapInArrow(_answer_contexts(length), MESSAGE)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return by_block(masks, tasks).mapInArrow(_removals(length, with_text), schema + (", kept binary" if with_text else ""))


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
pieces AS (SELECT doc_id, h, n, unnest(range(0, n - 99, 256)) AS p FROM d WHERE n >= 100),
cut AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2 * (256 + 99)) AS c, least(256, n - 99 - p) AS m FROM pieces),
places AS (SELECT doc_id, p, c, unnest(range(0, m)) AS i FROM cut),
starts AS (SELECT doc_id, p + i AS s, substr(c, 2 * i + 1, 200) AS w FROM places),
again AS (SELECT doc_id, s FROM starts QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
runs AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER w <= 100 THEN 0 ELSE 1 END AS new FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM runs),
gone AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS z FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER w, 0) AS p, lead(a) OVER w IS NULL AS final FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)) || CASE WHEN final THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS k,
  sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(kept.n_removed, 0) AS n_removed, coalesce(kept.n_spans, 0) AS n_spans,
  sha256(CASE WHEN kept.doc_id IS NULL THEN d.b ELSE unhex(kept.k) END) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
