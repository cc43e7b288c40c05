import random

import numpy as np
import pytest
import xxhash

from vitalog.llm import simhash

from .conftest import words


def fingerprint(text, width=3):
    w = words(text)
    shingles = [" ".join(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(nodes, near):
    """Map of each node to the least one reachable."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_equals_brute_force(docs, rows):
    fps = [(doc_id, fingerprint(text)) for doc_id, text in rows]
    roots = least_reachable(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for doc_id, fp in fps:
        known = [x for x in (least.get(roots[fp]), doc_id) if x is not None]
        least[roots[fp]] = min(known, default=None)
    want = [(doc_id, f"{fp:016x}", least[roots[fp]]) for doc_id, fp in fps]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("parts", [1, 2, 3])
@pytest.mark.parametrize("crowded", [1, 512])
def test_links_join_what_close_pairs_join(spark, parts, crowded):
    rng = random.Random(parts)
    fps = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(8):  # chains of close fingerprints, and far ones
            fps.add(at)
            at ^= sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 1, 2, 3])))
            at &= (1 << 64) - 1
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), parts=parts, crowded=crowded).collect()
    links = {(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in found}
    assert all((a ^ b).bit_count() <= 4 or crowded > 1 for a, b in links)  # stars join over a common neighbour
    want = least_reachable(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert least_reachable(fps, lambda a, b: (a, b) in links or (b, a) in links) == want


def test_buckets_stay_whole_when_joins_change_at_run_time(spark):
    rng = random.Random(9)
    fps = []
    for _ in range(3000):
        at = rng.getrandbits(64)
        fps += [at, at ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(set(fps))]
    names = {"spark.sql.autoBroadcastJoinThreshold": "1k", "spark.sql.shuffle.partitions": "12", "spark.sql.files.maxPartitionBytes": "8k",
             "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        links = simhash.links(spark.createDataFrame(signed, "fp long").repartition(12)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {frozenset((r["u"] % (1 << 64), r["v"] % (1 << 64))) for r in links}
    assert {frozenset(fps[i:i + 2]) for i in range(0, len(fps), 2)} - {frozenset((f,)) for f in fps} <= got


def test_thresholds_add_up_and_cost_least():
    rng = np.random.default_rng(1)
    costs = np.concatenate([np.zeros((50, 3, 1)), rng.random((50, 3, 3)).cumsum(2)], 2)
    got = simhash.allocation(costs, 0)
    assert (got.sum(1) == 0).all()
    for r in range(50):
        spent = sum(costs[r, i, got[r, i] + 1] for i in range(3))
        every = [sum(costs[r, i, t[i] + 1] for i in range(3)) for t in np.ndindex(4, 4, 4) for t in [np.array(t) - 1] if t.sum() == 0]
        assert spent == pytest.approx(min(every))


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 40] = bits[:, 3]
    ones = np.concatenate([bits, np.ones((500, 1))], 1)
    groups = simhash.grouped_bits(ones.T @ ones, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert sorted(map(len, groups)) == [21, 21, 22]
    assert any({3, 40} <= set(g) for g in groups)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []
