import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from vitalog.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, part string, pos string, depth string, ctx string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def rebuilt(rows, group=100, most=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - int(math.fmod(c, group)), [])[:h] + turns[h:]
    return out


def brute(sequences):
    members, children = {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = sum(saved[p] for p in below) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
    out = []
    for path, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(sequences[c]) == len(path))
        out.append((min(held), len(path), min(members[path[:-1]]) if path else None, len(held), len(children.get(path, [])), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n=250, texts="abc", longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(texts) * rng.randint(1, 2)) for _ in range(rng.randint(1, longest))]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(turns)]
    copied = [r for r in rows if r[0] % 7 == 0]
    return rows + [(10_000 + r[0], *r[1:]) for r in copied]


EDGE = [(None, 0, "user", "no conversation"), (5000, None, "user", "x"), (5000, None, None, None), (5000, 0, "user", "x"), (5000, 0, "user", "x"),
        (5100, 3, "user", None), (5101, 3, "user", ""), (5102, 9, None, "日本語 😀"), (-7, 0, "user", "a"), (5103, 1, "user", "long " * 5000)]


@pytest.mark.parametrize(("piece", "block_rows", "block_turns"), [(512, 50_000, 1 << 20), (512, 3, 1 << 20), (512, 50_000, 5), (2, 4, 1 << 20), (1, 1, 1), (3, 7, 40)])
def test_equals_brute_force(spark, monkeypatch, piece, block_rows, block_turns):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block_turns)
    rows = made(piece * 100 + block_rows, 60) + EDGE
    got = prefix_trie.prefix_trie(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rebuilt(rows))


def test_copies_over_many_blocks(spark, monkeypatch):
    """A third of the conversations are equal, a third share a long beginning: their nodes span most blocks, their ids are hashed block by block."""
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 5)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    same = [("user", "the same"), ("assistant", "answer"), ("user", "again"), ("assistant", "bye")]
    sequences = {c: same for c in range(60)} | {100 + c: [*same, ("user", f"more {c % 40}"), ("assistant", "x")] for c in range(60)}
    sequences |= {200 + c: [("user", f"own {c}")] for c in range(60)} | {300: [], 301: []}
    names = [(c, d, bytes.fromhex(digest(r, t))[:16], len(t)) for c, turns in sequences.items() for d, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame([(c, d, bytearray(k), n) for c, d, k, n in names], "conv_id long, pos long, name binary, chars long")
    got = prefix_trie.trie(turns, spark.createDataFrame([(c,) for c in sequences], "conv_id long")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(sequences)


def test_one_conversation_with_most_turns(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(3000)] + made(5, 40)
    got = prefix_trie.prefix_trie(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rebuilt(rows))


def test_positions_of_a_conversation_over_many_tasks(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS conv_id", "5000 - id AS turn")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.numbered(rows, ["turn"], "test").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = sorted((r["turn"], r["pos"]) for r in got if r["conv_id"] == 1)
    assert [p for _, p in hot] == list(range(len(hot))) and len(hot) == 1668
    assert all(r["pos"] == 0 for r in got if r["conv_id"] != 1)


def test_empty(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).collect() == []
    assert prefix_trie.prefix_trie(frame(spark, [(None, 0, "user", "x")])).collect() == []


def test_searches():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 6, 200)
    table = prefix_trie.sparse_table(values)
    at, least = rng.integers(0, 200, 500), rng.integers(0, 7, 500)
    for a, m, r, f in zip(at, least, prefix_trie.reach_right(table, at, least), prefix_trie.reach_left(table, at, least), strict=True):
        right = a
        while right + 1 < 200 and values[right + 1] >= m:
            right += 1
        left = a
        while left > 0 and values[left] >= m:
            left -= 1
        assert (r, f) == (right, left)
