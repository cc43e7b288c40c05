"""Date parsing and calendar buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import check_interval

# The export writes "2022-04-29 05:49:44 -0400"; one-digit fields, "-04:00" and "Z"
# are accepted too.
EXPORT_DATE_FORMAT = "yyyy-M-d H:m:s [XXX][Z]"
_ISO_WALL_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
_WALL_FORMAT = "yyyy-M-d H:m:s"


# The format makes both zones optional; exactly one must be there.
_ONE_ZONE = r"^\S+ \S+ (?:Z|[+-][0-9]{2}:?[0-9]{2})$"


# The form exports write. It is cut at fixed places, which costs a fraction of a formatter; what doesn't name an instant so is left to that.
_USUAL = r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-](?:0[0-9]|1[0-4])[0-5][0-9]$"


def _usual_iso(text: Column) -> Column:
    """A text of the usual form as ISO 8601."""
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.substring(text, 21, 3), F.lit(":"), F.substring(text, 24, 2))


def parse_date(text: Column) -> Column:
    """The instant a text names, NULL when it is malformed."""
    usual = F.when(text.rlike(_USUAL), _usual_iso(text).try_cast("timestamp"))
    return F.coalesce(usual, F.when(text.rlike(_ONE_ZONE), F.try_to_timestamp(text, F.lit(EXPORT_DATE_FORMAT))))


def parse_date_strict(text: Column) -> Column:
    """As :func:`parse_date`, but a malformed text fails the job; a missing one stays NULL."""
    complaint = F.concat(F.lit("malformed date: "), text)
    return F.coalesce(
        parse_date(text),
        F.when(text.isNotNull(), F.raise_error(complaint).cast("timestamp")),
    )


def lenient_iso_text(text: Column) -> Column:
    """ISO 8601 text with the offset that was written; a malformed text is kept as it is."""
    wall = F.try_to_timestamp(F.regexp_extract(text, r"^(\S+\s+\S+)", 1), F.lit(_WALL_FORMAT))
    zone = F.regexp_extract(text, r"(\S+)$", 1)
    offset = F.when(zone == "Z", F.lit("+00:00")).otherwise(
        F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    iso = F.concat(F.date_format(wall, _ISO_WALL_FORMAT), offset)
    usual = text.rlike(_USUAL) & _usual_iso(text).try_cast("timestamp").isNotNull()
    return F.when(usual, _usual_iso(text)).when(parse_date(text).isNotNull(), F.coalesce(iso, text)).otherwise(text)


def bucket(at: Column, interval: str, tz: str | None = None) -> Column:
    """Start of the calendar day, Monday week, month or year an instant falls in.

    With ``tz`` the calendar of that zone is used and the result is its wall-clock time.
    """
    check_interval(interval)
    local = F.from_utc_timestamp(at, tz) if tz else at
    return F.date_trunc(interval, local)


def one_bucket(interval: str) -> Column:
    """The length of a bucket as a calendar interval."""
    return F.expr("INTERVAL '7' DAY" if check_interval(interval) == "week"
                  else f"INTERVAL '1' {interval.upper()}")


def bucket_range(first: Column, last: Column, interval: str) -> Column:
    """Array of all bucket starts from ``first`` to ``last``, both included."""
    return F.sequence(first, last, one_bucket(interval))
