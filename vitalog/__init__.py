"""Personal-health analytics on Spark DataFrames."""

from .params import INTERVALS, RECORD_TYPES, WORKOUT_TYPES, SearchParams
from .session import configure, local_session
from .store import DocumentStore, ExportFiles, HealthStore, to_rows

__all__ = [
    "DocumentStore", "ExportFiles", "HealthStore", "INTERVALS", "RECORD_TYPES", "SearchParams", "WORKOUT_TYPES",
    "configure", "local_session", "to_rows",
]
