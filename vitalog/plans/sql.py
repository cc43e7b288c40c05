"""Building blocks of the check queries: the same views and aggregates, written in SQL."""

from __future__ import annotations

EVENT_RECORDS = """records AS (
  SELECT event_id AS record_id, event_type AS type, '' AS "sourceVersion",
         'user_' || CAST(user_id % 10 AS VARCHAR) AS "sourceName",
         'dev_' || CAST(user_id % 3 AS VARCHAR) AS device,
         ts AS "startDate", ts AS "endDate", ts AS "creationDate",
         'u' AS unit, value, props AS "textValue"
  FROM events)"""

ORDER_RECORDS = """records AS (
  SELECT o_orderkey AS record_id, o_orderpriority AS type, o_orderstatus AS "sourceName",
         'dev' AS device, o_orderdate AS "startDate", 'usd' AS unit, o_totalprice AS value,
         CAST(o_totalprice AS VARCHAR) AS "textValue"
  FROM orders)"""

WORKOUTS = """workouts AS (
  SELECT o_orderkey AS workout_id, o_orderpriority AS type,
         o_totalprice AS duration, 'min' AS "durationUnit", o_orderstatus AS "sourceName",
         o_orderdate AS "startDate"
  FROM orders)"""

STATS = """stats AS (
  SELECT l_orderkey AS workout_id, l_returnflag AS type, l_shipdate AS "startDate",
         l_quantity AS "sum", l_extendedprice AS maximum, l_linestatus AS unit
  FROM lineitem)"""

EVENT_DOCUMENTS = """documents_view AS (
  SELECT event_id AS record_id, event_type AS type,
         'user ' || CAST(user_id % 10 AS VARCHAR) AS "sourceName",
         props AS textvalue, value, ts AS "dateComponents"
  FROM events)"""

TEXT_DOCUMENTS = """documents_view AS (
  SELECT doc_id, lang || '/' || source AS type, source AS "sourceName", text AS textvalue,
         CAST(n_chars AS DOUBLE) AS value
  FROM documents)"""


def total(measure: str) -> str:
    """An exact sum of a two-decimal measure."""
    return f"CAST(SUM(CAST({measure} AS DECIMAL(18,2))) AS DOUBLE)"


def mean(measure: str) -> str:
    return f"{total(measure)} / NULLIF(COUNT({measure}), 0)"


def summary(measure: str) -> str:
    return (f'COUNT(*) AS "count", {mean(measure)} AS average, {total(measure)} AS "sum", '
            f'MIN({measure}) AS "min", MAX({measure}) AS "max"')


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def tokens(column: str) -> str:
    """The distinct lower-case tokens of a text."""
    return rf"regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{N}}_]+')"


def shared(column: str, query: list[str]) -> str:
    """How many of the query's tokens a text holds."""
    listed = ", ".join(f"'{t}'" for t in query)
    return f"CAST(len(list_intersect({tokens(column)}, [{listed}])) AS INTEGER)"
