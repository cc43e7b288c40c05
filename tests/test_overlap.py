"""Time covered by several sources, second by second."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from vitalog.operators import overlap

START = datetime(2022, 3, 1, tzinfo=timezone.utc)
SCHEMA = "type string, sourceName string, startDate timestamp, endDate timestamp, value double"


def made(seed, n=150, days=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rng.choice([rng.randint(0, days * 86400), 86400 - 30, 2 * 86400])
        rows.append((rng.choice("tu"), rng.choice(["a", "b", "c", None]), s, s + rng.choice([0, 0, 1, 600, 4000, 90000]), float(rng.randint(1, 50))))
    return rows + rows[:20]


def frame(spark, rows):
    at = lambda s: None if s is None else START + timedelta(seconds=s)
    return spark.createDataFrame([(t, src, at(s), at(e), v) for t, src, s, e, v in rows], SCHEMA)


def brute(rows):
    rows = [(t, src or "", s, e, v or 0.0) for t, src, s, e, v in rows if s is not None and e is not None and e >= s]
    covered = {}
    for t, src, s, e, _ in rows:
        covered.setdefault((t, src), set()).update(range(s, e))
    out = []
    for t, a in sorted(covered):
        for b in sorted(src for kind, src in covered if kind == t and src > a):
            time, value, instants = len(covered[t, a] & covered[t, b]), {a: 0.0, b: 0.0}, 0
            for kind, src, s, e, v in rows:
                if kind == t and src in value:
                    other = covered[t, b if src == a else a]
                    value[src] += v * (len(other.intersection(range(s, e))) / (e - s) if e > s else s in other)
                    instants += e == s and s in other
            if time or instants:
                out.append((t, a, b, time, value[a], value[b], instants, min(value.values())))
    return out


@pytest.mark.parametrize("cell_rows", [100_000, 40, 3])
def test_equals_a_count_by_seconds(spark, cell_rows):
    rows = made(cell_rows) + [("t", "a", None, 5, 1.0), ("t", "b", 9, 5, 1.0), ("t", "a", 0, 400000, 7.0), ("u", "b", 50, 60, None)]
    got = sorted(tuple(r) for r in overlap.source_overlap_time(frame(spark, rows), cell_rows=cell_rows).select(
        "type", "first_source", "second_source", "overlap_seconds", "first_value", "second_value", "instants", "double_counted").collect())
    want = brute(rows)
    assert [r[:4] + r[6:7] for r in got] == [r[:4] + r[6:7] for r in want]
    for a, b in zip(got, want):
        assert a[4:6] + a[7:] == pytest.approx(b[4:6] + b[7:], abs=1e-6)


def test_sources_that_never_meet(spark):
    rows = [("t", "a", 0, 10, 1.0), ("t", "b", 10, 20, 1.0), ("u", "b", 0, 10, 1.0), ("t", "c", 20, 20, 1.0)]
    assert overlap.source_overlap_time(frame(spark, rows)).collect() == []
    assert overlap.source_overlap_time(frame(spark, [])).collect() == []


def test_a_third_of_the_records_in_one_hour(spark):
    """A busy day is cut into smaller cells: no window holds more than a small part of its rows."""
    rows = [("t", "ab"[i % 2], 3600 + i * 3, 3600 + i * 3 + 5, 1.0) for i in range(1000)] + [("t", "a", 86400 * k, 86400 * k + 60, 1.0) for k in range(1, 50)]
    pieces = overlap._pieces(frame(spark, rows), 20)
    largest = pieces.groupBy(*overlap.CELL).count().agg({"count": "max"}).first()[0]
    assert largest <= 40 * 8 and pieces.select("cell").distinct().count() > 2
    got = overlap.source_overlap_time(frame(spark, rows), cell_rows=20).collect()
    assert [r["overlap_seconds"] for r in got] == [r[3] for r in brute(rows)]


def test_long_records_are_not_multiplied_by_small_cells(spark):
    """As many records at every instant as fill a cell: halving doesn't help, and must not multiply them."""
    rows = [("t", "abc"[i % 3], 1000 * i, 1000 * i + 43_200, 1.0) for i in range(400)]
    pieces = overlap._pieces(frame(spark, rows), 20)
    assert pieces.count() <= 8 * len(rows)
    got = overlap.source_overlap_time(frame(spark, rows), cell_rows=20).collect()
    want = brute(rows)
    assert [r["overlap_seconds"] for r in got] == [r[3] for r in want]
    assert [r["first_value"] for r in got] == pytest.approx([r[4] for r in want], abs=1e-6)
