import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest

from vitalog.llm import exact_dedup

from .conftest import FOLD, frame


@pytest.mark.parametrize("table_bytes", [exact_dedup.TABLE_BYTES, 2_000])
def test_equals_grouping_by_whole_text(docs, rows, table_bytes):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(FOLD)].append(doc_id)
    want = []
    for text, ids in groups.items():
        keep = max([i for i in ids if i is not None], default=None)
        open_ = True
        for doc_id in ids:
            kept = open_ and doc_id == keep
            open_ &= not kept
            want.append((doc_id, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_copies(docs, table_bytes=table_bytes).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_row_of_every_group_is_kept(spark):
    same = frame(spark, [(5, "Same")] * 4 + [(None, "nobody"), (None, "NOBODY")])
    kept = [r["doc_id"] for r in exact_dedup.exact_copies(same).filter("kept").collect()]
    assert sorted(kept, key=str) == [5, None]


def test_table_compares_complete_contents():
    table = exact_dedup.OpenTable()
    assert [table.entry(7, c) for c in (b"a", b"b", b"a", b"")] == [0, 1, 0, 2]
    for i in range(5000):
        table.entry(i, b"%d" % i)
    assert [table.entry(i, b"%d" % i) for i in (0, 4999)] == [3, 5002]


def test_equal_hashes_of_different_texts_stay_apart(tmp_path):
    bucket = exact_dedup._Spill(str(tmp_path))
    for i, content in enumerate([b"x" * 50, b"y" * 50, b"x" * 50]):
        bucket.add((1, content, [i]))
    rows = list(exact_dedup._bucket_rows(bucket, 0, 60))
    assert sorted((r[0], r[3]) for r in rows) == [([0], 2), ([1], 1), ([2], 2)]


def test_empty_table(empty):
    assert exact_dedup.exact_copies(empty).collect() == []
    assert list(exact_dedup._fold_batches(iter([pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.string())], ["d", "t"])])))[0].num_rows == 0
