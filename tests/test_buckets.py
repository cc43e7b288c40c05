"""Workouts and statistics stored by workout: same answers, no shuffle under the join, hot workouts apart."""

import random

import pytest
from vitalog import HealthStore
from vitalog.operators import summary, workouts as ops
from vitalog.sinks import buckets
from vitalog.sources import landing

W = "workout_id string, type string, duration double, durationUnit string, sourceName string, startDate timestamp"
S = "workout_id string, type string, startDate timestamp, sum double, unit string"


def tables(spark, n_workouts=300, n_stats=3000):
    """A third of the statistics belong to one workout; some to none, some to workouts that aren't there; ids repeat."""
    rng = random.Random(7)
    w = [(f"w{i // 2 if i % 50 == 1 else i}", f"HKWorkout{rng.choice('AB')}", rng.randint(1, 900) / 100, "min", rng.choice(["phone", None]), None)
         for i in range(n_workouts)] + [(None, "HKWorkoutA", 1.0, "min", None, None)]
    s = [(rng.choice(["w7", f"w{rng.randint(0, n_workouts + 20)}", f"w{rng.randint(0, n_workouts + 20)}", None]), rng.choice("xyz"), None,
          rng.randint(-500, 500) / 100, rng.choice(["kcal", "count"])) for _ in range(n_stats)]
    return spark.createDataFrame(w, W), spark.createDataFrame(s, S)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def parts_of(spark, w, s, folder, n=4):
    hot = buckets.write_pairs(w, s, folder, ("workouts", "stats"), "workout_id", n)
    return buckets.read_pairs(spark, folder, ("workouts", "stats"), (w.schema, s.schema), "workout_id", n, hot)


@pytest.mark.parametrize("hot_rows", [buckets.HOT_ROWS, 50])
def test_same_answers(spark, tmp_path, monkeypatch, hot_rows):
    monkeypatch.setattr(buckets, "HOT_ROWS", hot_rows)
    w, s = tables(spark)
    parts = parts_of(spark, w, s, f"{tmp_path}/p")
    assert rows(summary.summary_workouts_keyed(w, s, parts)) == rows(summary.summary_workouts_keyed(w, s))
    assert rows(ops.stats_workout_keyed(w, s, None, 2, parts)) == rows(ops.stats_workout_keyed(w, s, None, 2))
    assert rows(parts[0][0]) == rows(w)
    assert rows(parts[0][1].unionByName(parts[1][1])) == rows(s)
    hot = {r[0] for r in parts[1][0].collect()}
    assert hot == ({"w7"} if hot_rows == 50 else set())
    largest = parts[0][1].groupBy("workout_id").count().agg({"count": "max"}).first()[0]
    assert (largest <= 3000 // 16) == (hot_rows == 50)


def test_no_shuffle_under_the_join(spark, tmp_path):
    """Beside the final aggregation nothing moves, also without broadcasts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        w, s = tables(spark)
        even, _ = parts_of(spark, w, s, f"{tmp_path}/p")
        joined = even[0].join(even[1].withColumnRenamed("type", "kind").drop("startDate"), "workout_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        counted = summary.summary_workouts_keyed(w, s, [even])._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(workout_id" not in counted
        plain = summary.summary_workouts_keyed(w, s)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(workout_id" in plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_tables(spark, tmp_path):
    w, s = spark.createDataFrame([], W), spark.createDataFrame([], S)
    parts = parts_of(spark, w, s, f"{tmp_path}/p")
    assert rows(ops.stats_workout_keyed(w, s, None, 2, parts)) == []
    assert rows(summary.summary_workouts_keyed(w, s, parts)) == []


def test_number_of_buckets():
    size = buckets.BUCKET_BYTES
    assert [buckets.bucket_count(n) for n in (0, 1, size, size + 1, 2 * size, 2 * size + 1, 5 * size, 900 * size)] == [1, 1, 1, 2, 2, 4, 8, 1024]


def _imported(spark, export, target, layout, **options):
    landing.import_export(spark, export, target, layout=layout, **options)
    return target


@pytest.mark.parametrize("layout", ["plain", "sorted"])
def test_imports(spark, export, tmp_path, layout):
    plain = HealthStore.from_import(spark, _imported(spark, export, f"{tmp_path}/plain", layout))
    cut = HealthStore.from_import(spark, _imported(spark, export, f"{tmp_path}/cut", layout, buckets=4))
    assert not plain.parts and len(cut.parts) == 2
    for ask in (lambda x: x.workouts, lambda x: x.stats, lambda x: x.records, lambda x: x.summary(), lambda x: x.statistics("HKWorkoutActivityTypeRunning"),
                lambda x: x.trend("HKWorkoutActivityTypeRunning", "day")):
        assert rows(ask(cut)) == rows(ask(plain)) != []


def test_many_imports_are_paired_at_once(spark, export, tmp_path):
    target = f"{tmp_path}/t"
    landing.import_export(spark, export, target, name="a")
    landing.import_export(spark, export, target, mode="append", name="b", buckets=2)
    landing.import_export(spark, export, target, mode="append", name="c", layout="sorted")
    before = HealthStore.from_import(spark, target)
    assert not before.parts  # one workout may be in several imports
    want = {name: rows(getattr(before, name)) for name in ("records", "workouts", "stats")}
    answer = rows(before.statistics("HKWorkoutActivityTypeRunning"))
    assert landing.pair_imports(spark, target, buckets=4) == 3
    after = HealthStore.from_import(spark, target)
    assert len(after.parts) == 2 and {name: rows(getattr(after, name)) for name in want} == want
    assert rows(after.statistics("HKWorkoutActivityTypeRunning")) == answer
    assert landing.import_export(spark, export, target, mode="append", name="b")["records"] == 3  # counts already
    assert len(landing.Tables(target).imports(spark)) == 1
    assert landing.pair_imports(spark, f"{tmp_path}/none") == 0


def test_catalog_keeps_no_definitions(spark, tmp_path):
    w, s = tables(spark, 20, 50)
    parts_of(spark, w, s, f"{tmp_path}/p")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("vitalog_")]
