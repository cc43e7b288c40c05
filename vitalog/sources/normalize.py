"""Raw attribute text to the typed tables; shared by batch and streaming imports.

Input columns are named like the attributes in the export and hold text, NULL when absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.dates import parse_date_strict
from ..functions.numeric import safe_float

# What an absent attribute is stored as; all other absent ones are NULL.
RECORD_DEFAULTS = {"unit": "", "sourceVersion": "", "device": "", "value": ""}
STAT_DEFAULTS = {"sum": 0.0, "average": 0.0, "maximum": 0.0, "minimum": 0.0}
DATE_COLUMNS = ("startDate", "endDate", "creationDate")


def fill_record_defaults(raw: DataFrame) -> DataFrame:
    return raw.fillna({k: v for k, v in RECORD_DEFAULTS.items() if k in raw.columns})


def keep_value_text(raw: DataFrame) -> DataFrame:
    """``textValue`` is the value as written; ``value`` the number it holds, or 0.0."""
    return raw.withColumn("textValue", F.col("value")).withColumn("value", safe_float(F.col("value")))


def parse_dates(raw: DataFrame) -> DataFrame:
    return raw.withColumns({c: parse_date_strict(F.col(c)) for c in DATE_COLUMNS if c in raw.columns})


def fit(df: DataFrame, schema, kept: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the schema's columns in its order, behind those ``kept``: others are dropped, absent ones are NULL."""
    return df.select(*kept, *[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def narrowed(df: DataFrame) -> DataFrame:
    """The smaller types of a compact store: values in single precision, times in whole seconds."""
    return df.withColumns({
        **{c: F.col(c).cast("float") for c in ("value",) if c in df.columns},
        **{c: F.date_trunc("second", F.col(c)) for c in DATE_COLUMNS if c in df.columns},
    })


def records(raw: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    return fit(keep_value_text(fill_record_defaults(parse_dates(raw))), schemas.RECORDS, kept)


def workouts(raw: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Workout attributes to ``workouts`` rows; a missing or non-numeric duration is 0.0."""
    typed = (parse_dates(raw).withColumn("type", F.col("workoutActivityType"))
             .withColumn("duration", safe_float(F.col("duration"))))
    return fit(typed, schemas.KEYED_WORKOUTS if "workout_id" in raw.columns else schemas.WORKOUTS, kept)


def stats(raw: DataFrame, absent: float | None = 0.0, kept: tuple[str, ...] = ()) -> DataFrame:
    """Statistic attributes to ``stats`` rows.

    Absent numbers become ``absent`` (NULL keeps them apart from a true 0.0); text that is no
    number is an error.
    """
    def number(name: str, default: float | None) -> Column:
        wrong = F.raise_error(F.concat(F.lit(f"{name} is no number: "), F.col(name))).cast("double")
        return (F.when(F.col(name).isNull(), F.lit(default).cast("double"))
                .otherwise(F.coalesce(safe_float(F.col(name), None), wrong)))

    numbers = {c: number(c, None if absent is None else default) for c, default in STAT_DEFAULTS.items()}
    keyed = "workout_id" in raw.columns
    return fit(parse_dates(raw).withColumns(numbers), schemas.KEYED_STATS if keyed else schemas.STATS, kept)
