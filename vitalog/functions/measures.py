"""The five statistics, and an order-independent sum.

A double sum depends on the order partial results arrive in, which changes when tasks are retried
or re-partitioned. When a measure has a known number of decimals (``scale``) it is summed as a
whole number of its smallest unit instead, so reruns agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# A whole number is summed in two parts, so that BIGINT holds the sums of any number of rows.
_LOW_BITS = 20


def _has_units(measure: Column, scale: int) -> Column:
    """Whether a value is finite and, in whole units, fits a BIGINT."""
    return ~F.isnan(measure) & (F.abs(measure) < F.lit(float(2 ** 62) / 10 ** scale))


def whole_units(measure: Column, scale: int) -> Column:
    """A value in its smallest unit as a BIGINT; NULL for ``nan``, ``inf`` and what is too large."""
    return F.when(_has_units(measure, scale), F.rint(measure * F.lit(float(10 ** scale))).cast("bigint"))


def other_values(measure: Column, scale: int | None) -> Column:
    """What :func:`exact_total` leaves out: ``nan``, ``inf`` and values too large for whole units."""
    if scale is None:
        return F.lit(None).cast("double")
    return F.when(~_has_units(measure, scale), measure)


def with_others(total: Column, others: Column) -> Column:
    """A total and the sum of :func:`other_values`, as one double."""
    return F.when(others.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + others)


def exact_total(measure: Column, scale: int | None) -> Column:
    """Sum in the smallest unit, as a DECIMAL, when ``scale`` is given; else a plain double sum."""
    if scale is None:
        return F.sum(measure)
    units = whole_units(measure, scale)
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(units.bitwiseAND(F.lit(2 ** _LOW_BITS - 1))).cast("decimal(20,0)")
    return high * F.lit(2 ** _LOW_BITS).cast("decimal(7,0)") + low


def from_units(total: Column, scale: int | None) -> Column:
    """A total of :func:`exact_total` back in the measure's own unit."""
    if scale is None:
        return total
    return total.cast("double") / F.lit(float(10 ** scale))


def full_total(measure: Column, scale: int | None) -> Column:
    """The sum of all values as a double, exact as far as the values have whole units."""
    return with_others(from_units(exact_total(measure, scale), scale), F.sum(other_values(measure, scale)))


def measure_summary(measure: Column, scale: int | None = None,
                    names: dict[str, str] | None = None) -> list[Column]:
    """count(*), average, sum, min and max as aggregate columns; ``names`` renames them."""
    label = {"count": "count", "average": "average", "sum": "sum", "min": "min", "max": "max"}
    label.update(names or {})
    total = full_total(measure, scale)
    return [
        F.count(F.lit(1)).alias(label["count"]),
        (total / F.nullif(F.count(measure), F.lit(0))).alias(label["average"]),
        total.alias(label["sum"]),
        F.min(measure).alias(label["min"]),
        F.max(measure).alias(label["max"]),
    ]
