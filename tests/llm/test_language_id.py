import random

import numpy as np
import pytest

from vitalog.llm import language_id as lid

from .conftest import EDGE, frame

SOUNDS = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "tion", "qu"], "dd": ["ñe", "ción", "ll"], "ee": ["zz", "wy", "prz"], "ff": ["öö", "kk", "ää"]}


def corpus(languages, n=240, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = languages[i % len(languages)]
        out.append((i, " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 30))), lang))
    return out


@pytest.mark.parametrize("languages", [["aa"], ["aa", "bb"], ["aa", "bb", "cc", "dd"], list(SOUNDS)])
def test_held_out_accuracy(spark, languages):
    table = corpus(languages)
    got = {r["doc_id"]: r for r in lid.languages_of(frame(spark, table)).collect()}
    held = [i for i, *_ in table if got[i]["held_out"]]
    assert len(got) == len(table) and held
    assert np.mean([got[i]["lang_pred"] == table[i][2] for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 8, 30):
        codes = lid.codewords(n)
        apart = (codes.shape[1] - codes @ codes.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= max(1, codes.shape[1] // 4)
        assert (np.abs(codes.sum(0)) < n).all()  # every bit tells some languages from others


def test_prediction_uses_the_text_alone(spark):
    table = corpus(["aa", "bb", "cc"])
    model = lid.fit(frame(spark, table))
    other = [(i + 5000, t, None, "elsewhere") for i, t, _ in table]
    want = [(r["lang_pred"], r["score"]) for r in lid.identify(frame(spark, table), model).orderBy("doc_id").collect()]
    assert [(r["lang_pred"], r["score"]) for r in lid.identify(frame(spark, other), model).orderBy("doc_id").collect()] == want


def test_texts_without_letters_are_unknown(spark):
    got = lid.languages_of(frame(spark, corpus(["aa", "bb"]) + [(i, t, None) for i, t in EDGE])).collect()
    told = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] and r["doc_id"] >= 900}
    assert [i for i, x in told.items() if x == "und"] == [900, 901, 902, 907]
    assert len(got) == 240 + len(EDGE)


def test_mixed_text_is_ambiguous(spark):
    model = lid.fit(frame(spark, corpus(["aa", "bb"], 400)))
    pure, both = "kato mika tomi kaka", "kato schung mika einung"
    got = {r["doc_id"]: r for r in lid.identify(frame(spark, [(1, pure), (2, both)]), model).collect()}
    assert got[2]["score"] < got[1]["score"]


def test_nothing_to_learn_from(spark, empty):
    assert lid.languages_of(empty).collect() == []
    got = lid.languages_of(frame(spark, [(1, "words", None), (2, None, "aa")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
