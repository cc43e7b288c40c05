import hashlib
import zlib

import pytest

from vitalog.llm import sharding

from .conftest import frame


def key(value):
    return int(hashlib.md5(value.encode()).hexdigest()[:15], 16)


def brute(rows, shards, tolerance, by="bytes"):
    """Row order and cuts as the docstring says, from running sums; rows that are repeated are alike."""
    ordered = sorted(((key(t or ""), key("" if i is None else str(i))), i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    weights = [r[2] if by == "bytes" else 1 for r in ordered]
    total, cuts = sum(weights), []
    for k in range(1, shards):
        goal, before, at = total * k // shards, 0, 0
        while before + weights[at] < goal:
            before += weights[at]
            at += 1
        lo = hi = at
        while lo and ordered[lo - 1][0][0] == ordered[at][0][0]:
            lo -= 1
        while hi + 1 < len(ordered) and ordered[hi + 1][0][0] == ordered[at][0][0]:
            hi += 1
        left, right = sum(weights[:lo]), sum(weights[:hi + 1])
        if lo == hi or by == "rows" or min(goal - left, right - goal) > tolerance * total / shards:
            left, right, lo, hi = before, before + weights[at], at, at
        cuts.append(lo if goal - left <= right - goal else hi + 1)
    out, slots = [], [0] * shards
    for n, (_, i, size, crc) in enumerate(ordered):
        mine = sum(c <= n for c in cuts)
        out.append((i, size, crc, by, mine, slots[mine], None))
        slots[mine] += 1
    return out


def same(got, want):
    return sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("shards", "tolerance", "by", "probes"), [(16, 0.01, "bytes", 256), (3, 0.5, "bytes", 2), (5, 0.0, "rows", 3)])
def test_equals_brute_force(spark, docs, rows, monkeypatch, shards, tolerance, by, probes):
    monkeypatch.setattr(sharding, "PROBES", probes)
    assert same(sharding.shard(docs, shards, tolerance, by).collect(), brute(rows, shards, tolerance, by))


def test_hot_group_is_cut_and_small_groups_are_not(spark):
    table = [(i, "the same text " * 3) for i in range(300)] + [(1000 + i, f"text number {i // 2}") for i in range(600)]
    got = sharding.shard(frame(spark, table), 16, 0.05).collect()
    assert same(got, brute(table, 16, 0.05))
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(load) - min(load) <= 0.1 * sum(load) / 16 + 43
    held = {}
    for r in got:
        held.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in held.values()) == 1


def test_equal_rows_are_told_apart(spark):
    """Nothing but the place where they are read tells these rows apart."""
    got = sharding.shard(frame(spark, [(None, "x")] * 160 + [(7, None)] * 160), 16, by="rows").collect()
    assert [sum(r["shard"] == s for r in got) for s in range(16)] == [20] * 16
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(20)) for s in range(16))


def test_few_and_no_rows(spark, empty):
    assert sharding.shard(empty).collect() == []
    got = sharding.shard(frame(spark, [(1, "a"), (2, None)])).collect()
    assert same(got, brute([(1, "a"), (2, None)], 16, 0.01))


def test_no_python_on_the_main_path(docs):
    plan = sharding.shard(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_written_shards_hold_the_documents(spark, docs, rows, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/shards")
    got = spark.read.parquet(f"{tmp_path}/shards")
    assert got.select("document.*").columns == docs.columns
    assert sorted(((r["document"]["doc_id"], r["document"]["text"]) for r in got.collect()), key=repr) == sorted(rows, key=repr)
    assert sorted((r["shard"], r["slot"]) for r in got.collect()) == sorted((r[4], r[5]) for r in brute(rows, 16, 0.01))


def test_unknown_law(docs):
    with pytest.raises(ValueError, match="law"):
        sharding.shard(docs, by="weight")
