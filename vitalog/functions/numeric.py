"""Text to number, with the rules of the export's own tooling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms that count as a number (digits may be grouped by single "_").
_DIGITS = r"[0-9](?:_?[0-9])*"
_NUMBER = rf"(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
_SPECIAL = r"(?i:inf|infinity|nan)"
NUMBER_PATTERN = rf"^[+-]?(?:{_NUMBER}|{_SPECIAL})$"
# Plain decimals, which need no other treatment than a cast.
_PLAIN = r"^-?[0-9]{1,18}(?:\.[0-9]{1,18})?$"
_BLANKS = " \t\n\r\f\u000b"


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def is_python_float(text: Column) -> Column:
    """True when the text is a number; rejects forms only the JVM accepts, such as "3d"."""
    return F.coalesce(_bare(text).rlike(NUMBER_PATTERN), F.lit(False))


def safe_float(text: Column, default: float | None = 0.0) -> Column:
    """The number a text holds, or ``default`` when it is missing or no number."""
    bare = _bare(text)
    unsigned_nan = F.regexp_replace(bare, r"^[+-](?=[nN])", "")
    number = F.replace(unsigned_nan, F.lit("_"), F.lit("")).try_cast("double")
    return F.when(text.rlike(_PLAIN), text.try_cast("double")).when(is_python_float(text), number).otherwise(F.lit(default).cast("double"))
