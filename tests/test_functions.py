import math
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vitalog.functions import (bucket, lenient_iso_text, matched_tokens, parse_date_strict,
                               query_tokens, safe_float, text_matches)
from vitalog.params import SearchParams, is_workout, parse_instant


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def as_python(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return 0.0


NUMBERS = ["1", " 1.5\t", "-2e3", "+.5", "5.", "1_000", "1__0", "_1", "1_", "1e5_0", "0x10", "3d", "4f", "1L",
           "", " ", None, "abc", "nan", "-nan", "+NaN", "inf", "-Infinity", "infinit", "1e999", "--1", "1 2", ".",
           "e5", "1e", "١", "HKCategoryValueSleepAnalysisAsleepDeep"]


def test_safe_float_follows_python(spark):
    got = column(spark, NUMBERS, safe_float)
    for text, value in zip(NUMBERS, got):
        want = as_python(text) if text is None or text.isascii() else 0.0
        assert (math.isnan(value) and math.isnan(want)) or value == want, text


@settings(max_examples=2, deadline=None)
@given(st.lists(st.text(alphabet="0123456789+-_.eEinfa dDfF", max_size=8), min_size=300, max_size=300))
def test_safe_float_follows_python_on_any_text(spark, texts):
    for text, value in zip(texts, column(spark, texts, safe_float)):
        want = as_python(text)
        assert (math.isnan(value) and math.isnan(want)) or value == want, text


def test_strict_dates(spark):
    texts = ["2022-04-29 05:49:44 -0400", "2022-4-9 5:49:44 -04:00", "2022-04-29 05:49:44 Z", None]
    assert column(spark, texts, lambda c: parse_date_strict(c).cast("string")) == [
        "2022-04-29 09:49:44", "2022-04-09 09:49:44", "2022-04-29 05:49:44", None]
    with pytest.raises(PySparkException, match="malformed date: 29 April"):
        column(spark, ["29 April"], parse_date_strict)


def test_lenient_dates(spark):
    texts = ["2022-04-29 05:49:44 -0400", "2022-4-9 5:49:44 +05:30", "2022-04-29 05:49:44 Z", "29 April", None]
    assert column(spark, texts, lenient_iso_text) == [
        "2022-04-29T05:49:44-04:00", "2022-04-09T05:49:44+05:30", "2022-04-29T05:49:44+00:00", "29 April", None]


def test_buckets(spark):
    at = ["2024-02-29 23:59:59", "2023-01-01 00:00:00"]

    def starts(interval, tz=None):
        return column(spark, at, lambda c: bucket(c.cast("timestamp"), interval, tz).cast("date").cast("string"))
    assert starts("day") == ["2024-02-29", "2023-01-01"]
    assert starts("week") == ["2024-02-26", "2022-12-26"]
    assert starts("month") == ["2024-02-01", "2023-01-01"]
    assert starts("year") == ["2024-01-01", "2023-01-01"]
    assert starts("day", "America/New_York") == ["2024-02-29", "2022-12-31"]
    with pytest.raises(ValueError):
        starts("quarter")


def test_tokens(spark):
    texts = ["The cat", "these", "no-THE-no", "the_end", "été", None, ""]
    assert column(spark, texts, lambda c: text_matches(c, "THE, ÉTÉ!")) == [
        True, False, True, False, True, False, False]
    assert column(spark, texts, lambda c: matched_tokens(c, "the cat the")) == [2, 0, 1, 0, 0, 0, 0]
    assert query_tokens("A b, a") == ["a", "b"]
    assert column(spark, texts, lambda c: text_matches(c, " ,;")) == [False] * 7


def test_parameters():
    assert parse_instant("2020-01-01") == parse_instant("2020-01-01T00:00:00+00:00")
    assert parse_instant("2020-01-01T00:00:00-05:00") == parse_instant(datetime(2020, 1, 1, 5))
    assert parse_instant("") is None
    assert is_workout("HKWorkoutActivityTypeRunning") and not is_workout(None) and not is_workout("Running")
    assert SearchParams(record_type="HKWorkoutX").wants_workouts
