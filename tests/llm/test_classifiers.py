import random

import numpy as np
import pytest

from vitalog.llm import factorization, toxicity

from .conftest import EDGE, frame, made_texts

INSULTS = ["idiotic", "wretch", "scoundrel"]


def labelled(spark, rows):
    return spark.createDataFrame([(i, q, t, "clash") for i, q, t in rows], "doc_id long, quality int, toxic int, text string")


def held_out(got):
    return [r for r in got if r["held_out"]]


@pytest.fixture(scope="module")
def corpus():
    rng, base = random.Random(8), made_texts(8, 400)
    rows, labels = [], []
    for i, text in enumerate(base):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        w = text.split() + ["and", "then", "some", "more"]
        if not good:
            w = [x + rng.choice(["!!", "###", "|"]) for x in w]
        if toxic:
            for _ in range(2):
                term = rng.choice(INSULTS)
                w.insert(rng.randrange(len(w)), term if rng.random() < 0.7 else term[:3] + term[4:])
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_quality_on_held_out_rows(spark, corpus):
    rows, labels = corpus
    got = held_out(factorization.quality(frame(spark, rows), labelled(spark, labels)).collect())
    assert len(got) > 60
    assert np.mean([(r["score"] >= 0.5) == labels[r["doc_id"]][1] for r in got]) >= 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_toxicity_on_held_out_rows(spark, corpus):
    rows, labels = corpus
    got = held_out(toxicity.toxicity(frame(spark, rows), labelled(spark, labels)).collect())
    assert np.mean([r["predicted"] == labels[r["doc_id"]][2] for r in got]) >= 0.9


def test_pairwise_part_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = factorization.FactorizationMachine(0.5, rng.normal(size=20), rng.normal(size=(20, 4)))
    feature, value = np.array([1, 4, 9, 2, 3]), rng.random(5)
    got = model.logits(feature, value, np.array([0, 3, 5]))
    for row, at in ((0, [0, 1, 2]), (1, [3, 4])):
        want = 0.5 + sum(model.weights[feature[i]] * value[i] for i in at) + sum(
            model.factors[feature[i]] @ model.factors[feature[j]] * value[i] * value[j] for i in at for j in at if i < j)
        assert got[row] == pytest.approx(want)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = [(b"abcab", False), (b"abc", False), (b"bbbbba", False), (b"cabbac", True), (b"acca", True)]
    automaton = toxicity.LexiconAutomaton(terms)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = automaton.match(data, ends - [len(w) for w in words], ends)
    for word, code in zip(words, got, strict=True):
        edits = []
        for text, start in terms:
            near = min(distance(text, word[:k]) for k in range(len(word) + 1)) if start else distance(text, word)
            edits.append(near if near == 0 or (near == 1 and len(text) >= toxicity.EDIT_FROM) else 9)
        assert (code >= 0) == (min(edits) < 9), (word, code, edits)
        if code >= 0:
            assert code & 1 == min(edits) and edits[code >> 1] == min(edits)


def test_quotation_marks_are_seen():
    data = 'he said "idiotic" there and idiotic'.encode()
    text, code, context, n = toxicity.hits(np.frombuffer(data, np.uint8), np.array([0, len(data)]), toxicity.LexiconAutomaton([(b"idiotic", False)]))
    assert list(text) == [0, 0] and list(n) == [6] and (context[:, -1] - toxicity.CONTEXT_DIMS).tolist() == [1, 0]


@pytest.mark.parametrize("operator,rest", [(factorization.quality, 0.5), (toxicity.toxicity, 0.0)])
def test_edges(spark, empty, corpus, operator, rest):
    rows, labels = corpus
    nothing = labelled(spark, [])
    assert [r["score"] for r in operator(frame(spark, EDGE), nothing).collect()] == [rest] * len(EDGE)
    some = labelled(spark, [(i, q, t) for i, q, t in labels] + [(None, 1, 1), (5, None, None), (7, 0, 0), (7, 1, 1)])
    got = operator(frame(spark, rows + EDGE), some).collect()
    assert len(got) == len(rows) + len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert operator(empty, some).collect() == []


def test_labels_alone_of_one_kind(spark, corpus):
    rows, labels = corpus
    ones = labelled(spark, [(i, 1, 1) for i, _, _ in labels])
    assert {r["score"] for r in factorization.quality(frame(spark, rows), ones).collect()} == {1.0}
    assert {r["score"] for r in toxicity.toxicity(frame(spark, rows), ones).collect()} == {1.0}
