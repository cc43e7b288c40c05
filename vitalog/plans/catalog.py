"""All named queries and their check queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import document_queries, export_queries, record_queries, workout_queries
from .views import without_zone

_MODULES = (record_queries, workout_queries, document_queries, export_queries)


def _runner(build: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return without_zone(build(configure(spark), sf_dir))
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(build) for m in _MODULES for name, build in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.ORACLES.items()}
