"""Search and statistics over documents: any element, with analysed text matching.

A document has ``type, sourceName, textvalue, value`` and ``dateComponents`` (its start time).
A text matches when it shares a token with the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import measure_summary
from ..functions.text import matched_tokens, text_matches, token_scores
from ..params import DEFAULT_LIMIT, SearchParams
from .filters import all_of, in_dates, in_values, no_duration
from .ordering import tie_break
from .trend import trend_gapfilled

TOP_TYPES = 50


def _match(column: str, query: str | None) -> Column | None:
    return text_matches(F.col(column), query) if query else None


def match_all(documents: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Any document matches; the ``limit`` most recent ones are returned."""
    return _top(documents.withColumn("score", F.lit(0)), limit).drop("score")


def doc_conditions(params: SearchParams) -> Column:
    """All given conditions must hold; a duration, which documents don't have, is an error."""
    no_duration(params)
    return all_of([
        _match("type", params.record_type),
        _match("sourceName", params.source_name),
        in_dates(F.col("dateComponents"), params.date_from, params.date_to),
        in_values(F.col("value"), params.value_min, params.value_max),
    ])


def doc_search(documents: DataFrame, params: SearchParams) -> DataFrame:
    """The best ``params.limit`` documents: most shared tokens first, then most recent."""
    score = (matched_tokens(F.col("type"), params.record_type or "")
             + matched_tokens(F.col("sourceName"), params.source_name or ""))
    return _top(documents.filter(doc_conditions(params)).withColumn("score", score), params.limit)


def doc_search_values(documents: DataFrame, value: str, record_type: str | None = None,
                      date_from=None, date_to=None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Documents whose text shares a token with ``value``, best ``limit`` first."""
    hits = documents.filter(all_of([
        text_matches(F.col("textvalue"), value),
        _match("type", record_type),
        in_dates(F.col("dateComponents"), date_from, date_to),
    ]))
    score = matched_tokens(F.col("textvalue"), value) + matched_tokens(F.col("type"), record_type or "")
    return _top(hits.withColumn("score", score), limit)


def token_match(documents: DataFrame, query: str, column: str = "textvalue") -> DataFrame:
    """All documents that share a token with the query, with the number of tokens shared."""
    # The score comes out of a generator, so the filter uses it instead of computing it again.
    return (documents.select("*", F.explode(token_scores(F.col(column), query)).alias("score"))
            .filter(F.col("score") > 0))


def doc_range(documents: DataFrame, date_from=None, date_to=None, value_min=None,
              value_max=None) -> DataFrame:
    """Documents inside the given inclusive ranges; a bound that is missing does not cut."""
    return documents.filter(all_of([
        in_dates(F.col("dateComponents"), date_from, date_to),
        in_values(F.col("value"), value_min, value_max),
    ]))


def _top(scored: DataFrame, limit: int) -> DataFrame:
    order = [F.col("score").desc()]
    if "dateComponents" in scored.columns:
        order.append(F.col("dateComponents").desc_nulls_last())
    order += tie_break(scored, ("record_id", "doc_id"), skip=("score", "dateComponents"))
    return scored.orderBy(*order).limit(limit)


def total_docs(documents: DataFrame) -> DataFrame:
    """Number of documents that have a type."""
    return documents.agg(F.count("type").alias("total_records"))


def summary_docs(documents: DataFrame, top: int = TOP_TYPES) -> DataFrame:
    """The ``top`` most frequent types and their document counts; untyped documents are left out."""
    return (documents.filter(F.col("type").isNotNull())
            .groupBy("type").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("type")).limit(top))


def stats_docs(documents: DataFrame, record_type: str, scale: int | None = None) -> DataFrame:
    """Number of matching documents, and statistics over those that have a value."""
    hits = documents.filter(text_matches(F.col("type"), record_type))
    names = {"count": "total_count", "average": "avg"}
    return (hits.agg(*measure_summary(F.col("value"), scale, names), F.count("value").alias("count"))
            .withColumn("record_type", F.lit(record_type))
            .select("record_type", "total_count", "count", "min", "max", "avg", "sum"))


def trend_docs(documents: DataFrame, record_type: str, interval: str = "month", date_from=None,
               date_to=None, scale: int | None = None) -> DataFrame:
    """Calendar histogram over all documents whose type matches, empty buckets included."""
    hits = documents.filter(text_matches(F.col("type"), record_type)).select(
        F.lit(record_type).alias("type"), F.col("dateComponents").alias("startDate"), "value")
    return trend_gapfilled(hits, None, interval, date_from, date_to, scale)
