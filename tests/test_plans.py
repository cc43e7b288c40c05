"""What the plans of the named queries must and must not hold."""

import contextlib
import io
import re

import pytest

from vitalog.plans import catalog
from vitalog.plans.export_files import export_elements
from vitalog.operators import rawxml

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
# Queries that only read the tables; the others run jobs that write before they return, and what
# they return is looked at as well.
LAZY = sorted(n for n in QUERIES if not re.match(r"catalog|delete|stored", n))


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval", "BatchEvalPython", "MapInPandas"):
        assert bad not in text, bad


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["trend_month"](spark, SF_DIR))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate", text)
    assert "EqualTo(o_orderpriority,5-LOW)" in text
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "o_orderkey" not in read and "o_custkey" not in read


def test_searches_are_top_k(spark):
    for name in ("search_records", "search_combined", "doc_search", "summary_docs"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SF_DIR)), name


def below(df, node: str) -> str:
    """The part of the physical plan under the first node of a kind."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(re.match(r"[\s:+\-|*()0-9]*", line)[0])
    at = next(i for i, line in enumerate(lines) if re.search(node, line))
    end = next((i for i in range(at + 1, len(lines)) if depth(lines[i]) <= depth(lines[at])), len(lines))
    return "\n".join(lines[at + 1:end])


JOIN = r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)"


def test_pairs_are_reduced_before_they_are_joined(spark):
    for name in ("stats_workout", "trend_workout", "summary_workouts", "join_workout_stats"):
        assert below(QUERIES[name](spark, SF_DIR), JOIN).count("HashAggregate") >= 4, name


def test_keyed_pairs_are_restricted_by_the_workouts_first(spark):
    for name in ("stats_workout_keyed", "trend_workout_keyed"):
        side = below(QUERIES[name](spark, SF_DIR), JOIN)
        assert "HashAggregate" not in side and "EqualTo(o_orderpriority" in side, name


def test_shown_elements_meet_their_tags_without_a_shuffle(spark):
    found = export_elements(spark, SF_DIR)
    shown = rawxml.as_xml(found, rawxml.search_elements(found, "user_3", 50))
    assert "Exchange hashpartitioning" not in below(shown, "BroadcastHashJoin")
    by_type = plan(rawxml.elements_by_type(found, "error", 20))
    assert "EqualTo(name_type,error)" in by_type and "TakeOrderedAndProject" in by_type
