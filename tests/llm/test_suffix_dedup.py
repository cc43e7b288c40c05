import hashlib
import random

import numpy as np
import pytest

from vitalog.llm import suffix_dedup

from .conftest import frame


def brute(rows, length):
    seen, out = set(), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s:s + length]
            if window in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (rows[i][0], len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=repr)


def test_equals_brute_force(docs, rows):
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == brute(rows, 100)


@pytest.mark.parametrize("crowded", [suffix_dedup.CROWDED, 1])
def test_blocks_and_crowded_anchors(spark, monkeypatch, crowded):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdef ") for _ in range(260))
    rows = []
    for i in range(40):
        own = "".join(rng.choice("uvwxyz ") for _ in range(rng.randint(0, 150)))
        cut = rng.randint(0, 150)
        rows.append((i, own + passage[cut:cut + rng.randint(50, 200)] + own[::-1] + "ab" * rng.randint(0, 90)))
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    got = [tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute(rows, 100)


def test_kept_text_is_what_is_left(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = frame(spark, [(1, text), (2, "before " + text + " after")])
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(rows, with_text=True).collect()}
    assert got == {1: text.encode(), 2: b"before  after"}


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    place = rng.integers(0, 300, 200)
    room = rng.integers(0, 60, 200)
    group = rng.integers(0, 9, 200)
    order, depth = suffix_dedup._sorted_depths(data, place, room, 1, group)
    text = [bytes(data[p:p + r]) for p, r in zip(place, room, strict=True)]
    keys = [(group[i], text[i]) for i in order]
    assert keys == sorted(keys)
    for k in range(1, 200):
        if group[order[k]] == group[order[k - 1]]:
            a, b = text[order[k - 1]], text[order[k]]
            assert depth[k] == next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_collisions_are_noticed():
    data = np.frombuffer(b"abcabd", np.uint8)
    extensions = suffix_dedup.Extensions(data, np.array([0, 3]), np.array([3, 3]), 1, 3)
    one, two = np.array([0]), np.array([1])
    assert extensions.verified(one, two, np.array([2]))
    assert not extensions.verified(one, two, np.array([3]))
    assert not extensions.verified(one, two, np.array([1]))


def test_empty_table(empty):
    assert suffix_dedup.remove_repeats(empty).collect() == []
