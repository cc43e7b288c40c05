"""Exact medians and robust outliers against plain Python."""

import random
import statistics

import pytest
from vitalog.operators import quantiles, sized_join


def made(seed, n=400):
    rng = random.Random(seed)
    rows = [("hot", rng.choice([1.0, 2.5, 2.5, 7.0, rng.random() * 10 ** rng.randint(-5, 9)])) for _ in range(n)]
    rows += [("equal", 3.0)] * 11 + [("one", -4.5), ("two", 1.0), ("two", 2.0), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 0.5)]
    rows += [(None, 5.0), (None, 7.0), ("none", None), ("nan", float("nan")), ("nan", float("inf")), ("mixed", float("-inf")), ("mixed", 8.0), ("hot", None)]
    return rows


@pytest.mark.parametrize(("steps", "broadcast_rows"), [(256, 100_000), (2, 100_000), (7, 0)])
def test_medians(spark, monkeypatch, steps, broadcast_rows):
    monkeypatch.setattr(quantiles, "STEPS", steps)
    monkeypatch.setattr(sized_join, "BROADCAST_ROWS", broadcast_rows)
    rows = [r for r in made(steps) if r[0] is not None]
    got = {r["type"]: r["median"] for r in quantiles.exact_medians(spark.createDataFrame(rows, "type string, x double"), ["type"], "x").collect()}
    want = {}
    for kind, x in rows:
        if x is not None and x == x and abs(x) != float("inf"):
            want.setdefault(kind, []).append(x)
    assert got == pytest.approx({k: statistics.median(v) for k, v in want.items()}, rel=1e-15)


def test_extreme_values_do_not_hide_each_other(spark):
    rows = [(i, "t", 10.0 + i % 5) for i in range(20)] + [(100, "t", 1e6), (101, "t", 1.1e6), (102, "u", 5.0), (103, "u", 5.0), (104, "u", 9.0)]
    df = spark.createDataFrame(rows, "record_id long, type string, value double")
    got = quantiles.robust_outliers(df).collect()
    assert sorted(r["record_id"] for r in got) == [100, 101]
    assert {(r["median_value"], r["mad_value"]) for r in got} == {(12.0, 1.0)}


def test_empty(spark):
    df = spark.createDataFrame([], "record_id long, type string, value double")
    assert quantiles.robust_outliers(df).collect() == [] and quantiles.exact_medians(df, ["type"], "value").collect() == []
