"""The registered queries against their SQL over the smallest tables, and against what their contracts say."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))
import check_queries  # noqa: E402
from vitalog.llm import queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    ok, note = check_queries.compare(spark, check_queries.duck(SF_DIR), queries.QUERIES[name], queries.ORACLES[name], SF_DIR)
    assert ok, note


COLUMNS = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_language_model": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint",
                           "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_per_document(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    ids = [r["doc_id"] for r in df.collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
