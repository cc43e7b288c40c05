"""One object per data set with the questions users ask of it; every answer is a DataFrame.

Most are lazy. ``latest``, ``extremes``, ``outliers`` and the questions to export files run a first pass when called, whose small
result decides how the rest is joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import documents as docs
from .operators import insights, overlap, quantiles, rawxml, search, statistics, summary, trend, workouts
from .params import DEFAULT_LIMIT, SearchParams, is_workout
from .session import configure
from .sources import export_xml, landing, markup
from .sources.landing import Tables
from .streaming import ingest


def to_rows(result: DataFrame) -> list[dict]:
    """A small result (a search, a summary, a trend) as plain dictionaries on the driver."""
    return result.toPandas().to_dict("records")


@dataclass(frozen=True)
class HealthStore:
    """Records, and workouts with their statistics.

    ``keyed`` pairs a workout with the statistics that were recorded in it. Without it they
    are paired when they start at the same instant, for tables that carry no ``workout_id``.
    ``scale`` is the number of decimals of the measures where it is known; sums are then exact.
    ``parts`` are workouts and statistics once more, cut so that keyed pairing needs no shuffle, where the tables are stored so.
    """

    records: DataFrame
    workouts: DataFrame | None = None
    stats: DataFrame | None = None
    keyed: bool = True
    scale: int | None = None
    parts: workouts.Parts | None = None

    @classmethod
    def from_import(cls, spark: SparkSession, root: str, **options) -> HealthStore:
        """The tables an import wrote under ``root``."""
        tables = Tables(root)
        read = {name: tables.read(configure(spark), name) for name in ("records", "workouts", "stats")}
        return cls(**read, **{"parts": tables.pairs(spark)} | options)

    @classmethod
    def from_parquet(cls, spark: SparkSession, records: str, **options) -> HealthStore:
        """Records alone, from a Parquet file or folder."""
        return cls(records=configure(spark).read.parquet(records), **options)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None, **options) -> HealthStore:
        """``records``, ``workouts`` and ``stats`` of the catalog."""
        prefix = f"{database}." if database else ""
        configure(spark)
        options.setdefault("keyed", "workout_id" in spark.table(f"{prefix}stats").columns)
        return cls(*(spark.table(prefix + name) for name in ("records", "workouts", "stats")), **options)

    def _has_workouts(self) -> bool:
        return self.workouts is not None and self.stats is not None

    def _need_workouts(self) -> None:
        if not self._has_workouts():
            raise ValueError("this store was opened without workouts and statistics")

    def summary(self) -> DataFrame:
        """How many rows of each type there are."""
        if not self._has_workouts():
            return summary.summary_records(self.records)
        if not self.keyed:
            return summary.summary(self.records, self.workouts, self.stats)
        return summary.united(summary.summary_records(self.records),
                              summary.summary_workouts_keyed(self.workouts, self.stats, self.parts))

    def total(self) -> DataFrame:
        """Number of all records."""
        return summary.summary_total(self.records)

    def date_range(self) -> DataFrame:
        """First and last start of the records."""
        return summary.summary_range(self.records)

    def downsample(self, interval: str = "day") -> DataFrame:
        """One sample per type, source, unit and bucket."""
        return insights.downsample(self.records, interval, self.scale)

    def search(self, params: SearchParams) -> DataFrame:
        """The most recent rows that meet ``params``."""
        if not params.wants_workouts:
            return search.search_records(self.records, params)
        self._need_workouts()
        find = workouts.search_workouts_keyed if self.keyed else workouts.search_workouts
        return find(self.workouts, self.stats, params)

    def latest(self, record_type: str | None = None) -> DataFrame:
        if is_workout(record_type):
            self._need_workouts()
            return search.latest_record(self.workouts, record_type)
        return search.latest_record(self.records, record_type)

    def statistics(self, record_type: str | None, numeric_only: bool = False) -> DataFrame:
        """count, average, sum, min and max of a type's values."""
        if not is_workout(record_type):
            return statistics.stats_records(self.records, record_type, self.scale, numeric_only)
        self._need_workouts()
        if self.keyed:
            return workouts.stats_workout_keyed(self.workouts, self.stats, record_type, self.scale, self.parts)
        return workouts.stats_workout(self.workouts, self.stats, record_type, self.scale)

    def trend(self, record_type: str | None, interval: str = "month", date_from=None, date_to=None,
              tz: str | None = None, numeric_only: bool = False) -> DataFrame:
        """A type's values per day, week, month or year."""
        if not is_workout(record_type):
            records = statistics.numeric_rows(self.records) if numeric_only else self.records
            return trend.trend(records, record_type, interval, date_from, date_to, self.scale, tz)
        self._need_workouts()
        if self.keyed:
            return workouts.trend_workout_keyed(self.workouts, self.stats, record_type, interval, date_from, date_to, self.scale, tz, self.parts)
        return workouts.trend_workout(self.workouts, self.stats, record_type, interval, date_from, date_to,
                                      scale=self.scale, tz=tz)

    def trend_by_device(self, record_type: str | None, interval: str = "month", date_from=None,
                        date_to=None) -> DataFrame:
        return trend.trend_device(self.records, record_type, interval, date_from, date_to, self.scale)

    def search_values(self, record_type: str | None, value: str, date_from=None, date_to=None) -> DataFrame:
        """Records whose text value is exactly ``value``."""
        return search.search_values(self.records, value, record_type, date_from, date_to)

    def sources(self, record_type: str | None = None) -> DataFrame:
        return statistics.stats_sources(self.records, record_type)

    def extremes(self, record_type: str | None = None) -> DataFrame:
        """The rows with the lowest and highest value, or the shortest and longest workout."""
        if is_workout(record_type):
            self._need_workouts()
            return search.extreme_records(self.workouts, "duration", record_type)
        return search.extreme_records(self.records, "value", record_type)

    def overlaps(self, interval: str = "day", record_type: str | None = None) -> DataFrame:
        return insights.source_overlap(self.records, interval, record_type)

    def overlap_time(self, record_type: str | None = None) -> DataFrame:
        return overlap.source_overlap_time(self.records, record_type)

    def last_week(self, record_type: str | None = None) -> DataFrame:
        return insights.last_week_daily(self.records, record_type, scale=self.scale)

    def robust_outliers(self, z: float = 3.5, record_type: str | None = None) -> DataFrame:
        return quantiles.robust_outliers(self.records, z, record_type)

    def outliers(self, record_type: str | None = None, z: float = 3.0) -> DataFrame:
        return insights.outliers(self.records, z, record_type, self.scale)


@dataclass(frozen=True)
class DocumentStore:
    """Every child of the export's root as a document, searched by tokens."""

    documents: DataFrame
    scale: int | None = None

    def summary(self) -> DataFrame:
        return docs.summary_docs(self.documents)

    def total(self) -> DataFrame:
        return docs.total_docs(self.documents)

    def search(self, params: SearchParams) -> DataFrame:
        return docs.doc_search(self.documents, params)

    def statistics(self, record_type: str) -> DataFrame:
        return docs.stats_docs(self.documents, record_type, self.scale)

    def trend(self, record_type: str, interval: str = "month", date_from=None, date_to=None) -> DataFrame:
        return docs.trend_docs(self.documents, record_type, interval, date_from, date_to, self.scale)

    def search_values(self, record_type: str | None, value: str, date_from=None, date_to=None,
                      limit: int = DEFAULT_LIMIT) -> DataFrame:
        return docs.doc_search_values(self.documents, value, record_type, date_from, date_to, limit)


class ExportFiles:
    """The export files themselves, asked without an import.

    The markup is scanned once, on first use, and kept in the shared folder.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = configure(spark), path
        self._elements: DataFrame | None = None

    @property
    def elements(self) -> DataFrame:
        if self._elements is None:
            self._elements = landing.land_elements(self.spark, self.path)
        return self._elements

    def structure(self) -> DataFrame:
        return rawxml.structure(self.elements)

    def size_mb(self) -> DataFrame:
        return export_xml.file_size_mb(self.spark, self.path)

    def search(self, query: str = "", max_results: int = 50) -> DataFrame:
        """The first records and workouts with the query in an attribute, as XML text."""
        return rawxml.as_xml(self.elements, rawxml.search_elements(self.elements, query, max_results))

    def by_type(self, record_type: str = "", limit: int = 20) -> DataFrame:
        """The first records of a type, as XML text."""
        return rawxml.as_xml(self.elements, rawxml.elements_by_type(self.elements, record_type, limit))

    def documents(self) -> DocumentStore:
        return DocumentStore(markup.documents(self.elements))

    def import_to(self, target: str, mode: str = "overwrite", layout: str = "plain", **options) -> HealthStore:
        """Import into ``target`` and open the result; ``absent`` and ``narrow`` as in :func:`landing.import_export`."""
        landing.import_export(self.spark, self.path, target, mode, layout, **options)
        return HealthStore.from_import(self.spark, target)

    def import_new_to(self, target: str, checkpoints: str, max_files: int | None = None, **options) -> dict[str, int]:
        """Add the files that are new since the last call to the tables under ``target``; returns the rows added."""
        return ingest.import_new_files(self.spark, self.path, target, checkpoints, max_files, **options)
