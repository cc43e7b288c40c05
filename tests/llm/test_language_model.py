import gc
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vitalog.llm import ngram_lm
from vitalog.llm.blocks import message, sent, small
from vitalog.llm.elias_fano import EliasFano, encode

from .conftest import words


def brute(rows):
    texts = [(i, words(t) + [None], zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0) for i, t in rows]
    one, two, context, after = Counter(), Counter(), Counter(), defaultdict(set)
    for _, w, held in texts:
        if not held:
            one.update(w)
            for u, v in zip(["<s>"] + w[:-1], w, strict=True):
                two[u, v] += 1
                context[u] += 1
                after[u].add(v)
    n, v = sum(one.values()), len(one)
    out = []
    for i, w, held in texts:
        plain = [(one[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        p = [max(two[a, b] - 0.9, 0) / (context[a] + 5) + (0.9 * len(after[a]) + 5) / (context[a] + 5) * q
             for a, b, q in zip(["<s>"] + w[:-1], w, plain, strict=True)]
        out.append((i, held, len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, plain)), sum(map(math.log10, p))))
    return out


@pytest.mark.parametrize("block_bytes", [ngram_lm.BLOCK_BYTES, 3000])
def test_equals_brute_force(docs, rows, monkeypatch, block_bytes):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", block_bytes)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got = sorted((tuple(r) for r in ngram_lm.score(docs).collect()), key=key)
    for a, b in zip(got, sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5])
        assert a[6] == pytest.approx(b[6], abs=0.001 * b[2])  # probabilities are kept in steps of 0.05 %


def test_trie_finds_exactly_the_learned_pairs(tmp_path):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 40, 600, dtype=np.uint64) << np.uint64(32) | rng.integers(0, 90, 600, dtype=np.uint64))
    learned = rng.integers(0, 4, len(keys))
    contexts = np.unique(keys >> np.uint64(32))
    trie = ngram_lm.TrieShard(contexts, np.full(len(contexts), 50), keys, learned, str(tmp_path))
    every = np.array([(c << 32) | w for c in range(45) for w in range(95)], np.uint64)
    codes = dict(zip(every.tolist(), trie.codes_of(every).tolist(), strict=True))
    want = {int(k) for k, n in zip(keys, learned, strict=True) if n > 0}
    assert {k for k, c in codes.items() if c} == want


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (7, 3), (500, 1 << 50), (900, (1 << 64) - 1)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    packed = EliasFano(encode(values))
    assert (packed.all() == values).all()
    keys = np.concatenate([values, rng.integers(0, top, 200, dtype=np.uint64, endpoint=True), np.array([0, top, (1 << 64) - 1], np.uint64)])
    at, equal = packed.successor(keys)
    assert (at == np.searchsorted(values, keys)).all() and (equal == np.isin(keys, values)).all()


@pytest.mark.parametrize("n,top", [(1, 0), (9, 4), (600, 1 << 45), (700, 90)])
def test_search_inside_ranges(n, top):
    """Against the list itself, over borders with equal neighbours, empty ranges and keys beyond all."""
    rng = np.random.default_rng(n + 1)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    packed = EliasFano(encode(values))
    places = rng.integers(0, n, 300)
    assert (packed.at(places) == values[places]).all() and len(packed.at(places[:0])) == 0
    keys = np.concatenate([values[places], rng.integers(0, top, 300, dtype=np.uint64, endpoint=True), np.array([top + 1, (1 << 64) - 1], np.uint64)])
    begin = rng.integers(0, n + 1, len(keys))
    end = np.minimum(begin + rng.integers(0, 40, len(keys)), n)
    at, equal = packed.successor_within(keys, begin, end)
    for k, b, e, a, same in zip(keys, begin, end, at, equal, strict=True):
        want = b + int(np.searchsorted(values[b:e], k))
        assert same == (want < e and values[want] == k)
        if same:
            assert a == want


def test_level_of_successors_is_relative(tmp_path):
    """Two contexts with the same words: the second's numbers begin at the first's last, not at a multiple of the largest word of all."""
    keys = np.array([1 << 32 | 5, 1 << 32 | 9, 3 << 32 | 0, 3 << 32 | 9, 4 << 32 | (1 << 30)], np.uint64)
    trie = ngram_lm.TrieShard(np.array([1, 2, 3, 4], np.uint64), np.full(4, 9), keys, np.array([1, 2, 3, 4, 5]), str(tmp_path))
    assert trie.words.all().tolist() == [5, 9, 9, 18, 18 + (1 << 30)]
    assert trie.pointers.all().tolist() == [0, 2, 2, 4, 5]
    asked = np.concatenate([keys, np.array([1 << 32, 2 << 32 | 9, 3 << 32 | 5, 4 << 32, 5 << 32 | 9], np.uint64)])
    assert (trie.codes_of(asked) > 0).tolist() == [True] * 5 + [False] * 5


def test_empty_table(empty):
    assert ngram_lm.score(empty).collect() == []


def peak_of(work):
    """Bytes that a call takes at most besides what is there when it begins."""
    gc.collect()
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        work()
        return tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()


def some_block(n=400_000):
    """Two texts' tokens as a block has them: places in its list of words, and the words' numbers."""
    rng = np.random.default_rng(5)
    tokens = (rng.zipf(1.3, n) % 50_000).astype(np.uint32)
    return tokens, np.array([n // 2, n - n // 2]), rng.permutation(200_000)[:50_000].astype(np.int64)


def test_pairs_of_a_block_take_little_memory():
    tokens, n_tokens, number = some_block()
    assert peak_of(lambda: ngram_lm._pairs(tokens, n_tokens, number)) < 40 * len(tokens)


def test_a_block_takes_little_memory(tmp_path):
    """The words of one block, with its text, held against the number of its tokens."""
    rng = np.random.default_rng(6)
    n = 400_000
    text = " ".join(map(str, rng.zipf(1.3, n) % 50_000))
    batch = pa.record_batch([pa.array([1], pa.int64()), pa.array([text]), pa.array([False])], ["doc_id", "text", "held_out"])
    run = ngram_lm._block_words(f"file://{tmp_path}", 12)
    assert peak_of(lambda: list(run(iter([batch])))) < 90 * n


def shard_messages(blocks=6, n=100_000):
    rng = np.random.default_rng(7)
    out = []
    for b in range(blocks):
        keys = np.unique(rng.integers(0, 3_000, n, dtype=np.uint64) << np.uint64(32) | rng.integers(0, 60_000, n, dtype=np.uint64))
        contexts = np.unique(keys >> np.uint64(32))
        body = message(contexts=encode(contexts), counts=small(np.full(len(contexts), 500)), n=len(contexts), pairs=encode(keys), learned=small(rng.integers(0, 9, len(keys))))
        out.append((f"block {b}", 0, body))
    return sent(out), blocks * n


def test_a_shard_of_pairs_takes_little_memory():
    batch, n = shard_messages()
    assert peak_of(lambda: list(ngram_lm._answer_pairs(iter([batch])))) < 80 * n


@pytest.mark.parametrize("values", [[], [7], [5, 5, 5], [9, 1, (1 << 64) - 1, 0, 9, 1]])
def test_numbered_is_unique(values):
    values = np.array(values, np.uint64)
    for got, want in zip(ngram_lm._numbered(values), np.unique(values, return_inverse=True), strict=True):
        assert got.tolist() == want.tolist()
