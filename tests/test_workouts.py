"""Aggregates and searches over workout/statistic pairs against the pairs built one by one."""

import random
from datetime import datetime, timedelta

import pytest

from vitalog import SearchParams
from vitalog.operators import summary, workouts as ops

START = datetime(2016, 1, 30)


def tables(spark, seed, n_workouts=60, n_stats=120):
    """Few instants, one of them holding a third of all rows; some values missing."""
    rng = random.Random(seed)

    def instant():
        return START if rng.random() < 0.34 else START + timedelta(days=rng.randint(0, 9))
    w = [(f"w{i}", f"HKWorkout{rng.choice('AB')}", rng.choice([None, rng.randint(1, 900) / 100]),
          rng.choice(["min", "hr"]), rng.choice(["phone", "watch", None]), instant()) for i in range(n_workouts)]
    s = [(rng.choice([f"w{rng.randint(0, n_workouts + 5)}", "w0"]), rng.choice("xyz"), instant(),
          rng.choice([None, rng.randint(-500, 500) / 100]), rng.choice(["kcal", "count"])) for _ in range(n_stats)]
    return w, s, spark.createDataFrame(
        w, "workout_id string, type string, duration double, durationUnit string, sourceName string, "
           "startDate timestamp"), spark.createDataFrame(
        s, "workout_id string, type string, startDate timestamp, sum double, unit string")


def pairs_of(w, s, keyed):
    for a in w:
        for b in s:
            if (a[0] == b[0]) if keyed else (a[5] == b[2]):
                yield a, b


def fold(entries):
    groups = {}
    for key, value in entries:
        groups.setdefault(key, []).append(value)
    out = {}
    for key, values in groups.items():
        known = [v for v in values if v is not None]
        total = round(sum(known), 6) if known else None
        out[key] = (len(values), round(total / len(known), 6) if known else None, total,
                    min(known, default=None), max(known, default=None))
    return out


def result(df, keys):
    def tidy(v):
        return None if v is None else round(v, 6)
    return {tuple(r[k] for k in keys): (r["count"], tidy(r.average), tidy(r["sum"]), r["min"], r["max"])
            for r in df.collect()}


@pytest.mark.parametrize("seed, keyed, scale", [(1, False, None), (2, False, 2), (3, True, None), (4, True, 2)])
def test_statistics_equal_those_of_the_pairs(spark, seed, keyed, scale):
    w, s, workouts, stats = tables(spark, seed)
    build = ops.stats_workout_keyed if keyed else ops.stats_workout
    want = {}
    for m, value, unit in (("duration", lambda a, b: a[2], lambda a, b: a[3]),
                           ("sum", lambda a, b: b[3], lambda a, b: b[4])):
        want |= fold(((a[1], b[1], m, unit(a, b)), value(a, b)) for a, b in pairs_of(w, s, keyed))
    assert result(build(workouts, stats, None, scale), ("type", "stat_type", "measure", "unit")) == want


@pytest.mark.parametrize("by_stat_type", [False, True])
def test_trends_equal_those_of_the_pairs(spark, by_stat_type):
    w, s, workouts, stats = tables(spark, 5)
    want = {}
    for m, value, unit in (("duration", lambda a, b: a[2], lambda a, b: a[3]),
                           ("sum", lambda a, b: b[3], lambda a, b: b[4])):
        want |= fold(((a[5].replace(day=1), a[1], a[4], m, unit(a, b)) + ((b[1],) if by_stat_type else ()),
                      value(a, b)) for a, b in pairs_of(w, s, False))
    keys = ("interval", "type", "sourceName", "measure", "unit") + (("stat_type",) if by_stat_type else ())
    assert result(ops.trend_workout(workouts, stats, None, "month", by_stat_type=by_stat_type), keys) == want


def test_summary_counts_pairs_and_workouts(spark):
    w, s, workouts, stats = tables(spark, 6)
    for keyed, build in ((False, summary.summary_workouts), (True, summary.summary_workouts_keyed)):
        want = {}
        for a, _ in pairs_of(w, s, keyed):
            n, ids = want.get(a[1], (0, set()))
            want[a[1]] = (n + 1, ids | {a[0]})
        got = {r.type: (r["count"], r.count_workouts) for r in build(workouts, stats).collect()}
        assert got == {k: (n, len(ids)) for k, (n, ids) in want.items()}


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("limit", [1, 10, 75, 5000])
def test_search_returns_the_first_pairs(spark, keyed, limit):
    w, s, workouts, stats = tables(spark, 7)
    params = SearchParams(record_type="HKWorkoutA", value_min="-2", max_workout_duration=8.5, limit=limit)
    low = (float("inf"),)

    def last(v):
        return low if v is None else (0, v)
    wanted = [(a, b) for a, b in pairs_of(w, s, keyed)
              if a[1] == "HKWorkoutA" and a[2] is not None and a[2] <= 8.5 and b[3] is not None and b[3] >= -2]
    wanted.sort(key=lambda p: (-p[0][5].timestamp(), p[0][0], p[1][0], p[1][1], p[1][2], last(p[1][3]), p[1][4]))
    build = ops.search_workouts_keyed if keyed else ops.search_workouts
    got = [tuple(r) for r in build(workouts, stats, params).collect()]
    assert got == [(*a, *b) for a, b in wanted[:limit]]
    assert len(got) == min(limit, len(wanted)) > 0
