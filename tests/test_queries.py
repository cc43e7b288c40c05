"""Every named query against its check query on DuckDB, over the smallest tables."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
import __spark_entry__ as entry  # noqa: E402
import check_queries  # noqa: E402
from vitalog.plans import catalog  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUERIES, CHECKS = catalog.queries(), catalog.oracles()
# Results that come in an order, beside those whose check query ends in ORDER BY: column, whether it descends.
SORTED = {n: ("interval", False) for n in QUERIES if n.startswith("trend_") and "gapfilled" not in n} | {
    "trend_gapfilled": ("date", False), "trend_docs": ("date", False), "summary_docs": ("count", True)}


@pytest.fixture(scope="module")
def con():
    return check_queries.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = check_queries.compare(spark, con, QUERIES[name], CHECKS.get(name), SF_DIR)
    assert ok, note


@pytest.mark.parametrize("name", sorted(n for n in CHECKS if re.search(r"ORDER BY [^()]*$", CHECKS[n])))
def test_rows_come_in_the_order_of_the_check(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    relation = con.execute(CHECKS[name])
    at = [[d[0] for d in relation.description].index(c) for c in df.columns]
    assert got == [tuple(r[i] for i in at) for r in relation.fetchall()]


@pytest.mark.parametrize("name", sorted(SORTED))
def test_rows_are_sorted(spark, name):
    column, descending = SORTED[name]
    rows = QUERIES[name](spark, SF_DIR).collect()
    if name == "trend_gapfilled":
        assert [(r["type"], r[column]) for r in rows] == sorted((r["type"], r[column]) for r in rows)
    else:
        assert [r[column] for r in rows] == sorted((r[column] for r in rows), reverse=descending)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) == set(CHECKS)
