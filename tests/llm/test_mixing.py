import hashlib

import pytest

from vitalog.llm import mixing

from .conftest import frame, words

SOURCES = ["b", None, "a", "b", "Z", "é"]


def with_sources(rows):
    return [(i, t, "en", SOURCES[n % 6] if n % 3 else "b") for n, (i, t) in enumerate(rows)]


def brute(rows, weights=(1, 2, 3)):
    sized = [(i, len(words(t)), s, hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()) for i, t, _, s in rows]
    sources = sorted({s for _, _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, x, _ in sized if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    full, target = set(), {}
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        total = sum(weight[s] for s in sources if s not in full)
        target = {s: 3.0 * size[s] if s in full else rest * weight[s] / total for s in sources}
        above = {s for s in sources if target[s] > 3 * size[s]}
        if not above:
            break
        full |= above
    out = []
    for s in sources:
        budget, before = int(target[s] + 0.5), 0
        epochs = budget // size[s] if size[s] else 0
        rest = budget - epochs * size[s]
        for _, i, n in sorted(((k, i is not None, i or 0, n), i, n) for i, n, x, k in sized if x == s):
            out.append((i, n, size[s], target[s], epochs * n + max(0, min(n, rest - before))))
            before += n
    return out


@pytest.mark.parametrize("bucket_rows", [mixing.BUCKET_ROWS, 1])
def test_equals_brute_force(spark, rows, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    table = with_sources(rows)
    got = mixing.mix(frame(spark, table)).select("doc_id", "size", "source_size", "target", "taken").collect()
    for a, b in zip(sorted(map(tuple, got), key=repr), sorted(brute(table), key=repr), strict=True):
        assert a[:3] == b[:3] and a[4] == b[4]
        assert a[3] == pytest.approx(b[3])


def test_sources_get_their_budget_and_documents_their_limit(spark, rows):
    got = mixing.mix(frame(spark, with_sources(rows))).collect()
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.5
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_mixed_documents_hold_the_words_taken(spark):
    table = [(i, f"w{i} x{i}\ty{i} z{i}", "en", "ab"[i % 3 == 0]) for i in range(30)]
    docs = frame(spark, table)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == [*docs.columns, "mix_epoch", "mix_taken"]
    count = dict.fromkeys(taken, 0)
    for r in out.collect():
        assert len(words(r["text"])) == r["mix_taken"] > 0
        assert words(r["text"]) == words(table[r["doc_id"]][1])[:r["mix_taken"]]
        count[r["doc_id"]] += r["mix_taken"]
    assert count == taken


def test_repeated_ids_take_part_row_by_row(spark):
    docs = frame(spark, [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (1, "d", "en", "t"), (None, "e f", "en", None)])
    want = sum(r["taken"] for r in mixing.mix(docs).collect())
    assert sum(r["mix_taken"] for r in mixing.mixed_documents(docs).collect()) == want


def test_no_python_on_the_main_path(spark, rows):
    plan = mixing.mix(frame(spark, with_sources(rows)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_no_words_at_all(spark, empty):
    assert mixing.mix(empty).collect() == []
    got = mixing.mix(frame(spark, [(1, "", "en", "a"), (2, None, "en", "b")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
