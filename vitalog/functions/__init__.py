"""Column functions: everything here is built from JVM-side Spark expressions."""

from .dates import bucket, bucket_range, lenient_iso_text, parse_date, parse_date_strict
from .measures import exact_total, measure_summary
from .numeric import is_python_float, safe_float
from .text import attribute_contains, matched_tokens, query_tokens, text_matches

__all__ = [
    "attribute_contains", "bucket", "bucket_range", "exact_total", "is_python_float", "lenient_iso_text",
    "matched_tokens", "measure_summary", "parse_date", "parse_date_strict",
    "query_tokens", "safe_float", "text_matches",
]
