"""Fixed schemas of the stored tables and of the raw XML elements they come from."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# Table columns, in stored order.
RECORDS = _struct(
    ("type", _S), ("sourceVersion", _S), ("sourceName", _S), ("device", _S),
    ("startDate", _TS), ("endDate", _TS), ("creationDate", _TS),
    ("unit", _S), ("value", _D), ("textValue", _S),
)
WORKOUTS = _struct(
    ("type", _S), ("duration", _D), ("durationUnit", _S), ("sourceName", _S),
    ("startDate", _TS), ("endDate", _TS), ("creationDate", _TS),
)
STATS = _struct(
    ("type", _S), ("startDate", _TS), ("endDate", _TS),
    ("sum", _D), ("average", _D), ("maximum", _D), ("minimum", _D), ("unit", _S),
)

# The engine keeps the parent link that the timestamp-only layout loses.
KEYED_WORKOUTS = T.StructType([T.StructField("workout_id", _S), *WORKOUTS.fields])
KEYED_STATS = T.StructType([T.StructField("workout_id", _S), *STATS.fields])

TABLES = {"records": RECORDS, "workouts": WORKOUTS, "stats": STATS}

# Attributes as they are written in the export.
RECORD_ATTRIBUTES = ("type", "sourceName", "sourceVersion", "device", "unit",
                     "creationDate", "startDate", "endDate", "value")
WORKOUT_ATTRIBUTES = ("workoutActivityType", "duration", "durationUnit", "sourceName",
                      "creationDate", "startDate", "endDate")
STAT_ATTRIBUTES = ("type", "startDate", "endDate", "sum", "average", "maximum", "minimum", "unit")


def raw_attributes(names: tuple[str, ...], prefix: str = "_") -> T.StructType:
    """All-text schema of an element's attributes for the XML reader (never inferred)."""
    return _struct(*((prefix + n, _S) for n in names))


RAW_RECORD = raw_attributes(RECORD_ATTRIBUTES)
RAW_STAT = raw_attributes(STAT_ATTRIBUTES)
RAW_WORKOUT = T.StructType([
    *raw_attributes(WORKOUT_ATTRIBUTES).fields,
    T.StructField("WorkoutStatistics", T.ArrayType(RAW_STAT), True),
])
