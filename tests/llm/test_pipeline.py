import random

import corpus_pipeline
import pytest
from vitalog.llm import decontamination, language_id

from .conftest import FOLD, frame, words
from .test_decontamination import least_distance
from .test_language_id import SOUNDS
from .test_mixing import brute as mixed
from .test_simhash import fingerprint, least_reachable


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    rows, item = [], "a benchmark passage that must never be part of the training data, question seven"
    for i in range(120):
        lang = ["aa", "bb", "cc"][i % 3]
        w = ["".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(w), lang, f"s{i % 4}"))
    rows += [(200 + k, rows[k][1].upper() if k % 2 else rows[k][1], rows[k][2], "s1") for k in range(0, 60, 5)]
    rows += [(300, rows[7][1] + " " + item, "bb", "s2"), (301, rows[8][1] + "\n" + item.replace("never", "nevr").upper(), "cc", None)]
    rows += [(302, None, None, None), (303, "", "aa", "s0"), (304, "12 34", "aa", "s0"), (None, rows[9][1] + " etwas", "aa", "s3"),
             (305, rows[10][1] + " tail", "bb", "s3"), (305, rows[10][1] + " tail", "bb", "s3")]
    return rows, item


def test_stages_and_columns():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "mixing"]


def test_equals_brute_force(spark, corpus, tmp_path):
    rows, item = corpus
    folder = str(tmp_path)
    table = frame(spark, rows)
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    told = {(r["doc_id"]): r for r in language_id.languages_of(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    kept = [r for r in rows if told[r[0]]["lang_pred"] != "und" and told[r[0]]["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    assert len(kept) == len(rows) - 3
    groups = {}
    for r in kept:
        groups.setdefault((r[1] or "").translate(FOLD), []).append(r)
    kept = [max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in groups.values()]
    fps = [(r, fingerprint(r[1])) for r in kept]
    roots = least_reachable(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 2)
    near = {}
    for r, f in fps:
        near.setdefault(roots[f], []).append(r)
    kept = [min(g, key=lambda r: float("inf") if r[0] is None else r[0]) for g in near.values()]
    leaks = [r for r in kept if least_distance(decontamination.normalised(item), decontamination.normalised(r[1]))[0] <= len(item) // 10]
    assert {r[0] for r in leaks} == {300, 301}
    kept = [r for r in kept if r not in leaks]
    want = {r[0]: r[-1] for r in mixed(kept) if r[-1]}
    got = {}
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*table.columns, "mix_epoch", "mix_taken"]
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["mix_taken"]
        assert len(words(r["text"])) == r["mix_taken"]
    assert got == want


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
