import random

import corpus_pipeline
import pytest

from .conftest import frame
from .test_language_id import SOUNDS


@pytest.fixture(scope="module")
def sentences():
    rng = random.Random(12)
    return ["".join(rng.choices(SOUNDS["aa"], k=3)) + " " + " ".join("".join(rng.choices(SOUNDS["aa"], k=rng.randint(1, 4))) for _ in range(30))
            for _ in range(40)]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_language_stage_rejects_one_of_two_rows_with_an_id(spark, sentences, doc_id):
    rows = [(100 + i, t, "aa") for i, t in enumerate(sentences)] + [(doc_id, "12 34", "aa"), (doc_id, sentences[0] + " x", "aa")]
    kept = corpus_pipeline.language_stage(spark, frame(spark, rows), "").collect()
    assert [r["text"] for r in kept if r["doc_id"] == doc_id] == [sentences[0] + " x"]
    assert len(kept) == len(rows) - 1


@pytest.mark.parametrize("doc_id", [None, 7])
def test_leak_stage_drops_one_of_two_rows_with_an_id(spark, sentences, tmp_path, doc_id):
    item = "a benchmark passage that must never be part of the training data"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(doc_id, sentences[0] + " " + item), (doc_id, sentences[1]), (8, None)]
    table = frame(spark, rows)
    kept = corpus_pipeline.leak_stage(spark, table, str(tmp_path))
    assert kept.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(rows[1:], key=repr)


CLASHES = ["_row", "row", "document", "chosen_id", "_id", "_sha", "_named", "mix_foo", "mix_id", "mix_epoch", "group", "kept", "less", "n"]


@pytest.mark.parametrize("number", range(5))
def test_clashing_columns_come_back_untouched(spark, sentences, tmp_path, number):
    """Also with ids that are null or repeated, which other routes inside the stages are for."""
    item = "a benchmark passage that must never be part of the training data"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i // 2, t, "aa", "s") for i, t in enumerate(sentences)] + [(None, sentences[0] + " and more", "aa", "s")] * 2 + [(1, sentences[3].upper(), "aa", None)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    table = spark.createDataFrame([(*r, *[f"{c} {n}" for c in CLASHES]) for n, r in enumerate(rows)], schema)
    _, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, table, str(tmp_path))
    assert out.columns == table.columns + (["mix_epoch_", "mix_taken"] if number == 4 else [])
    got = out.collect()
    assert got and all(len({r[c].split(" ")[1] for c in CLASHES}) == 1 and all(r[c].startswith(c + " ") for c in CLASHES) for r in got)
    numbers = [int(r["row"].split(" ")[1]) for r in got]
    assert len(numbers) == len(set(numbers)) or number == 4


def test_exact_stage_keeps_one_of_equal_rows(spark):
    rows = [(1, "one text here"), (5, "ONE text here"), (5, "one text here"), (None, "One text here"), (7, "another"), (None, "nothing has an id"),
            (None, "nothing has an id")]
    got = corpus_pipeline.exact_stage(spark, frame(spark, rows), "").collect()
    assert sorted(((r["doc_id"], r["text"].lower()) for r in got), key=repr) == sorted([(5, "one text here"), (7, "another"), (None, "nothing has an id")], key=repr)


def test_near_stage_keeps_the_smallest_id(spark, sentences):
    long = " ".join(sentences)
    rows = [(9, long + " tail"), (4, long), (None, long.upper()), (12, sentences[0]), (3, None), (2, "")]
    got = corpus_pipeline.near_stage(spark, frame(spark, rows), "").collect()
    assert sorted(r["doc_id"] for r in got) == [2, 4, 12]


def test_many_dropped_rows_are_not_broadcast(spark, monkeypatch):
    """The size of their files says little of what they take on the driver, so they are counted."""
    rows = [(1, "one text here"), (5, "ONE text here"), (7, "another")]
    docs = frame(spark, rows)
    for most, expected in ((0, "SortMergeJoin"), (2, "BroadcastHashJoin")):
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_DROPPED", most)
        kept = corpus_pipeline.exact_stage(spark, docs, "")
        assert sorted(r["doc_id"] for r in kept.collect()) == [5, 7]
        last = next(x for x in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
        assert expected in last
