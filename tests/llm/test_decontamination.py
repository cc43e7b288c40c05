import random

from vitalog.llm import decontamination as dec

from .conftest import EDGE, frame


def least_distance(p, t):
    row = list(range(len(p) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(t, 1):
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (p[i - 1] != c)))
        row = new
        best = min(best, (row[-1], j))
    return best


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k:k + 1] = rng.choice([[], [out[k], "x"], ["y"]])
    return "".join(out)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, doc_id string")


def test_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(k, "".join(rng.choice("abcde ") for _ in range(rng.randint(20, 60)))) for k in range(6)] + [(6, None), (7, "  "), (8, "ab")]
    docs = []
    for i in range(40):
        text = "".join(rng.choice("abcde \n") for _ in range(80))
        docs.append((i, text[:30] + edited(rng, items[i % 6][1], rng.randint(0, 9)).upper() + text[30:]))
    got = sorted(tuple(r) for r in dec.contaminated(frame(spark, docs + EDGE), items_of(spark, items), rate=0.15).collect())
    want = []
    for i, t in docs + EDGE:
        for k, item in items:
            p, t2 = dec.normalised(item), dec.normalised(t)
            if p and t is not None:
                distance, end = least_distance(p, t2)
                if distance <= int(0.15 * len(p)):
                    want.append((i, k, distance, end, int(0.15 * len(p))))
    assert got == sorted(want) and len(got) > 20


def test_blocks_of_items_give_the_same(spark):
    items = items_of(spark, [(k, f"passage number {k} of the test set, long enough") for k in range(7)])
    docs = frame(spark, [(k, f"before it Passage  number {k} of the\ntest set, long enough and after") for k in range(7)])
    whole = sorted(map(tuple, dec.contaminated(docs, items).collect()))
    assert sorted(map(tuple, dec.contaminated(docs, items, block_chars=60).collect())) == whole
    assert {(r[0], r[1]) for r in whole if r[2] == 0} == {(k, k) for k in range(7)}


def test_empty_tables(spark, docs, empty):
    none = items_of(spark, [(1, None)])
    assert dec.contaminated(docs, none).collect() == []
    assert dec.contaminated(empty, items_of(spark, [(1, "something")])).collect() == []
