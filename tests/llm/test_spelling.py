import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitalog.llm import spelling

from .conftest import FOLD, frame

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, least_length=5, least_count=3, drop_every=97):
    found = Counter()
    for i, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += len(run) >= least_length
    return {w: n for w, n in found.items() if n >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(n, ratio=2):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def some_words(seed, n=700):
    """Few letters, so that words are crowded with neighbours; runs of equal letters; one long word and its variants."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abß") for _ in range(rng.randint(1, 9))) for _ in range(n)}
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    words |= {"a" * k for k in range(1, 40)} | {long, long[:1500] + "x" + long[1501:], long[1:], long + "z", long[:700] + "q" + long[700:]}
    return {w: rng.choice([1, 2, 3, 5, 8, 20, 100]) for w in words}


@pytest.mark.parametrize(("block", "hot"), [(10_000, 50_000), (2, 50_000), (64, 3)])
def test_variants_equal_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    words = some_words(block)
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == brute(words)


def test_blocks_agree_on_their_nodes():
    """Whatever the blocks, the nodes of all blocks together are those of one block of all words."""
    words = sorted(some_words(1))

    def kept(size):
        blocks = [words[i:i + size] for i in range(0, len(words), size)]
        common_nodes, out = set(), {}
        borders = [spelling.common(a[-1], b[0]) for a, b in zip(blocks, blocks[1:])] + [0]
        rows = [{"words": b, "side": 0, "counts": [1] * len(b), "left": borders[k - 1] if k else 0, "right": borders[k]} for k, b in enumerate(blocks)]
        for row in rows:
            for batch in spelling._shared_nodes([pa.RecordBatch.from_pylist([row])]):
                common_nodes |= set(batch.column("node").to_pylist())
        for row in rows:
            for got in spelling._trie_rows(row, common_nodes).to_pylist():
                if got["kind"] == spelling.WORD_ROW:
                    out[got["text"]] = (got["pos"], got["nodes"])
        return out

    assert kept(1) == kept(5) == kept(len(words))


def test_letters_beyond_the_alphabet(spark):
    words = {"日本語テキスト": 9, "日本語テクスト": 2, "😀abcde": 5, "😁abcde": 1, "abcde": 1}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == brute(words)


@pytest.mark.parametrize("drop_every", [97, 3, 0])
def test_word_counts(spark, docs, rows, drop_every):
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, 4, 2, drop_every).collect()}
    assert got == counted(rows, 4, 2, drop_every)


def test_whole_operator(spark, rows):
    table = rows * 2 + [(5000 + i, "Straßenbahn STRASSENBAHN straßenbahm ÀÉÎÕÜ÷×") for i in range(4)] + [(6000, "straßenbahn " * 30)]
    got = spelling.spelling_variants(frame(spark, table), least_length=3).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == brute(counted(table, 3))


def test_empty(spark, empty):
    assert spelling.spelling_variants(empty).collect() == []
    assert spelling.spelling_variants(frame(spark, [(1, None), (2, ""), (3, "a bc"), (None, "word word")])).collect() == []


def test_a_third_of_all_states_on_one_node(spark, monkeypatch):
    """States of a crowded node are dealt out over copies of its few edges, none of them in one place."""
    monkeypatch.setattr(spelling, "HOT", 100)
    states = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("word"), F.when(F.col("id") < 1000, -1).otherwise(F.col("id")).alias("node"))
    edges = spark.createDataFrame([(-1, "a"), (-1, "b"), (2000, "c")], "node long, label string")
    met = spelling._met(states, edges, ["node"])
    assert met.count() == 2001
    assert spelling._met(states, edges, ["node"], "left").count() == 4000
    assert "copy" in met._jdf.queryExecution().analyzed().toString()
