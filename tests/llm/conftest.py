import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ["kept", "fp", "size", "bucket", "held_out", "hash", "score", "value", "part", "key", "ids", "taken", "shard", "block", "y"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def made_texts(seed=3, n=60):
    """Invented texts with exact copies, near copies, shared passages and other scripts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [line(rng.randint(1, 120)) for _ in range(n)]
    shared = line(40)
    for i in range(0, n, 7):
        texts[i] = texts[i] + "\n" + shared + "  " + line(5)
    for i in range(3, n, 11):
        texts[i] = texts[i - 1].upper()
    for i in range(5, n, 13):
        texts[i] = texts[i - 2] + " more"
    return texts


EDGE = [(None, "a row without an id"), (None, None), (900, None), (901, ""), (902, " \t\n "), (903, "word"), (904, "Two words"), (905, "two WORDS"),
        (906, "twice the same row"), (906, "twice the same row"), (907, "12345 !!! ..."), (908, "ÄÖÜ naïve ßtraße"), (909, "日本語 テキスト 文字"),
        (910, "x" * 70_000), (911, "lorem ipsum dolor " * 4_000), (912, "for for for for for for for for for for for for for for for for for for for")]


def frame(spark, rows, schema=SCHEMA):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with columns that clash with internal names."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), *["clash"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def rows():
    return [(i, t) for i, t in enumerate(made_texts())] + EDGE


@pytest.fixture(scope="session")
def docs(spark, rows):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return frame(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
