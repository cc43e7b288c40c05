"""Search, statistics and trends over records, edge rows included."""

from datetime import datetime

import pytest

from vitalog import HealthStore, SearchParams, to_rows
from vitalog.operators import insights, search, sized_join, statistics, trend
from vitalog.operators.documents import summary_docs

SCHEMA = ("record_id int, type string, sourceName string, device string, startDate timestamp, unit string, "
          "value double, textValue string")
NOON = datetime(2024, 3, 10, 12)


@pytest.fixture(scope="module")
def records(spark):
    tied = [(i, "steps", "phone", "d1", NOON, "count", 5.0, "5") for i in range(40, 0, -1)]
    return spark.createDataFrame(tied + [
        (100, "steps", "watch", "d2", datetime(2024, 1, 31, 23, 59, 59), "count", 7.0, "7"),
        (101, "steps", "watch", None, datetime(2023, 12, 31), "count", 1.0, "1"),
        (102, "sleep", "it's \"me\"", "d2", NOON, "", 0.0, "Asleep' OR '1'='1"),
        (103, "steps", None, "d1", None, "count", 9.0, "9"),
        (104, None, "phone", "d1", NOON, None, None, None),
    ], SCHEMA).repartition(3)


def test_ties_are_cut_by_id(records):
    hits = search.search_records(records, SearchParams(record_type="steps", limit=5)).collect()
    assert [r.record_id for r in hits] == [1, 2, 3, 4, 5]
    assert search.search_records(records, SearchParams(limit=100)).count() == 45
    assert [r.record_id for r in search.latest_record(records).orderBy("type").collect()] == [102, 1]


def test_values_are_never_part_of_a_statement(records):
    odd = "Asleep' OR '1'='1"
    assert search.search_values(records, odd).count() == 1
    assert search.search_records(records, SearchParams(source_name="it's \"me\"")).count() == 1
    with pytest.raises(ValueError):
        search.search_records(records, SearchParams(value_min="ten"))


def test_dates_are_inclusive_and_a_bare_end_is_midnight(records):
    def count(date_from, date_to):
        return search.search_records(records, SearchParams("steps", date_from=date_from, date_to=date_to,
                                                           limit=100)).count()
    assert count("2023-12-31", "2024-01-31T23:59:59+00:00") == 2
    assert count("2023-12-31", "2024-01-31") == 1
    assert count("2024-03-10T08:00:00-04:00", None) == 40
    assert count(None, None) == 43


def test_text_values_count_as_zero_unless_asked(records):
    assert {(r.type, r.average) for r in statistics.stats_records(records, "sleep").collect()} == {("sleep", 0.0)}
    assert statistics.stats_records(records, "sleep", numeric_only=True).count() == 0
    nothing = statistics.stats_records(records.filter("record_id = 104")).first()
    assert nothing["count"] == 1 and nothing.average is None and nothing["sum"] is None


def test_gaps_are_filled_between_first_and_last(records):
    rows = trend.trend_gapfilled(records, "steps", "month").collect()
    assert [(str(r.date)[:7], r["count"], r.value_sum, r.avg_value) for r in rows] == [
        ("2023-12", 1, 1.0, 1.0), ("2024-01", 1, 7.0, 7.0), ("2024-02", 0, 0.0, None), ("2024-03", 40, 200.0, 5.0)]


def test_extremes_keep_one_row_each(records):
    got = {(r.type, r.extreme): r.record_id for r in search.extreme_records(records).collect()}
    assert got == {("steps", "lowest"): 101, ("steps", "highest"): 103,
                   ("sleep", "lowest"): 102, ("sleep", "highest"): 102}


def test_group_rows_join_the_same_way_broadcast_or_salted(records):
    groups = records.filter("type is not null").groupBy("type").count()
    few = sized_join.join_group_rows(records, groups, ["type"])
    many = sized_join.join_group_rows(records, groups, ["type"], broadcast_rows=0)
    assert sorted(map(repr, few.select(*sorted(few.columns)).collect())) == \
        sorted(map(repr, many.select(*sorted(many.columns)).collect()))
    assert few.count() == 44


def _physical(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_group_rows_are_never_broadcast(records):
    """Spark would take them for as few as before they were repeated for each sub-key."""
    groups = records.filter("type is not null").groupBy("type").count()
    many = sized_join.join_group_rows(records, groups, ["type"], broadcast_rows=0)
    assert "SortMergeJoin" in _physical(many) and "Broadcast" not in _physical(many)


def test_outliers_and_overlap(spark, records):
    usual = [(i, "hr", "phone", "d", NOON, "bpm", 60.0 + i % 3, "") for i in range(200)]
    df = spark.createDataFrame([*usual, (999, "hr", "watch", "d", NOON, "bpm", 190.0, "")], SCHEMA)
    for scale in (None, 1):
        assert [r.record_id for r in insights.outliers(df, 3.0, scale=scale).collect()] == [999]
    assert [(r.n_sources, r.n_records) for r in insights.source_overlap(df).collect()] == [(2, 201)]


def test_top_types_are_cut_at_fifty(spark):
    df = spark.range(0, 600).selectExpr("concat('t', lpad(id % 60, 2, '0')) AS type")
    got = summary_docs(df).collect()
    assert [r.type for r in got] == [f"t{i:02d}" for i in range(50)]


def test_store_without_workouts(records):
    store = HealthStore(records)
    assert {r["type"] for r in to_rows(store.summary())} == {"steps", "sleep", None}
    with pytest.raises(ValueError):
        store.trend("HKWorkoutActivityTypeRunning")
    assert store.trend_by_device("steps", "year").count() == 4
    assert store.sources("steps").count() == 3
