"""Queries over records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights, overlap, quantiles, search, statistics, summary, trend
from ..params import SearchParams
from . import sql
from .views import SCALE, event_records, order_records

EVENTS, ORDERS = sql.with_views(sql.EVENT_RECORDS), sql.with_views(sql.ORDER_RECORDS)
NEWEST = 'ORDER BY "startDate" DESC, record_id'

QUERIES = {}
ORACLES = {}


def query(name: str, view, build, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(view(spark, sf_dir))
    ORACLES[name] = oracle


# --- summaries -----------------------------------------------------------------------------
query("summary_records", event_records, summary.summary_records,
      EVENTS + 'SELECT type, COUNT(*) AS "count" FROM records GROUP BY type')
query("summary_total", event_records, summary.summary_total,
      EVENTS + """SELECT COUNT(*) AS total_records, COUNT(DISTINCT type) AS record_types
      FROM records""")
query("summary_range", order_records, summary.summary_range,
      ORDERS + """SELECT type, MIN("startDate") AS first_date, MAX("startDate") AS last_date,
      COUNT(*) AS "count" FROM records GROUP BY type""")

# --- search --------------------------------------------------------------------------------
query("search_records", event_records,
      lambda r: search.search_records(r, SearchParams(record_type="click")),
      EVENTS + f"SELECT * FROM records WHERE type = 'click' {NEWEST} LIMIT 10")
query("search_source", event_records,
      lambda r: search.search_records(r, SearchParams(source_name="user_3", limit=20)),
      EVENTS + f"""SELECT * FROM records WHERE "sourceName" = 'user_3' {NEWEST} LIMIT 20""")
query("search_dates", order_records,
      lambda r: search.search_records(r, SearchParams(
          record_type="5-LOW", date_from="1996-01-01T00:00:00+00:00",
          date_to="1996-12-31T23:59:59+00:00", limit=20)),
      ORDERS + f"""SELECT * FROM records WHERE type = '5-LOW'
      AND "startDate" >= TIMESTAMP '1996-01-01 00:00:00'
      AND "startDate" <= TIMESTAMP '1996-12-31 23:59:59' {NEWEST} LIMIT 20""")
query("search_values_range", event_records,
      lambda r: search.search_records(r, SearchParams(
          record_type="purchase", value_min="10", value_max="100.5", limit=25)),
      EVENTS + f"""SELECT * FROM records WHERE type = 'purchase' AND value >= 10
      AND value <= 100.5 {NEWEST} LIMIT 25""")
query("search_combined", event_records,
      lambda r: search.search_records(r, SearchParams(
          record_type="view", source_name="user_7", date_from="2024-01-05T00:00:00+00:00",
          date_to="2024-01-25", value_min="1.5", value_max="75", limit=15)),
      EVENTS + f"""SELECT * FROM records WHERE type = 'view' AND "sourceName" = 'user_7'
      AND "startDate" >= TIMESTAMP '2024-01-05 00:00:00'
      AND "startDate" <= TIMESTAMP '2024-01-25 00:00:00'
      AND value >= 1.5 AND value <= 75 {NEWEST} LIMIT 15""")
query("latest_record", order_records, search.latest_record,
      ORDERS + """SELECT * FROM records QUALIFY ROW_NUMBER() OVER
      (PARTITION BY type ORDER BY "startDate" DESC, record_id) = 1""")
query("latest_record_of_type", event_records, lambda r: search.latest_record(r, "signup"),
      EVENTS + f"SELECT * FROM records WHERE type = 'signup' {NEWEST} LIMIT 1")
query("text_exact", event_records,
      lambda r: search.search_values(r, '{"k": 69}', "click", "2024-01-03", "2024-01-28T12:00:00+00:00"),
      EVENTS + """SELECT * FROM records WHERE "textValue" = '{"k": 69}' AND type = 'click'
      AND "startDate" >= TIMESTAMP '2024-01-03 00:00:00'
      AND "startDate" <= TIMESTAMP '2024-01-28 12:00:00'""")
query("text_exact_any_type", event_records, lambda r: search.search_values(r, '{"k": 7}'),
      EVENTS + """SELECT * FROM records WHERE "textValue" = '{"k": 7}'""")

# --- statistics ----------------------------------------------------------------------------
query("stats_records", event_records, lambda r: statistics.stats_records(r, "click", SCALE),
      EVENTS + f"""SELECT type, type AS stat_type, {sql.summary("value")}, unit FROM records
      WHERE type = 'click' GROUP BY type, unit""")
query("stats_records_numeric_only", order_records,
      lambda r: statistics.stats_records(r, None, SCALE, numeric_only=True),
      ORDERS + f"""SELECT type, type AS stat_type, {sql.summary("value")}, unit FROM records
      WHERE TRY_CAST("textValue" AS DOUBLE) IS NOT NULL GROUP BY type, unit""")
query("stats_by_type", order_records, lambda r: statistics.stats_by_type(r, "2-HIGH", SCALE),
      ORDERS + f"""SELECT type, {sql.summary("value")} FROM records WHERE type = '2-HIGH'
      GROUP BY type""")
query("stats_sources", event_records, statistics.stats_sources,
      EVENTS + """SELECT type, "sourceName", COUNT(*) AS "count" FROM records
      GROUP BY type, "sourceName" """)


# --- trends --------------------------------------------------------------------------------
def trend_sql(views: str, interval: str, where: str) -> str:
    return views + f"""SELECT type, "sourceName", CAST(date_trunc('{interval}', "startDate") AS TIMESTAMP)
      AS "interval", {sql.summary("value")}, unit FROM records WHERE {where}
      GROUP BY date_trunc('{interval}', "startDate"), type, "sourceName", unit"""


query("trend_day", event_records, lambda r: trend.trend(r, "click", "day", scale=SCALE),
      trend_sql(EVENTS, "day", "type = 'click'"))
query("trend_week", event_records,
      lambda r: trend.trend(r, "purchase", "week", "2024-01-04T00:00:00+00:00", "2024-01-27", SCALE),
      trend_sql(EVENTS, "week", """type = 'purchase' AND "startDate" >= TIMESTAMP '2024-01-04 00:00:00'
      AND "startDate" <= TIMESTAMP '2024-01-27 00:00:00'"""))
query("trend_month", order_records,
      lambda r: trend.trend(r, "5-LOW", "month", "1996-01-01T00:00:00+00:00",
                            "1999-12-31T23:59:59+00:00", SCALE),
      trend_sql(ORDERS, "month", """type = '5-LOW' AND "startDate" >= TIMESTAMP '1996-01-01 00:00:00'
      AND "startDate" <= TIMESTAMP '1999-12-31 23:59:59'"""))
query("trend_year", order_records, lambda r: trend.trend(r, "1-URGENT", "year", scale=SCALE),
      trend_sql(ORDERS, "year", "type = '1-URGENT'"))
query("trend_device", event_records,
      lambda r: trend.trend_device(r, "view", "day", scale=SCALE),
      EVENTS + f"""SELECT device, CAST(date_trunc('day', "startDate") AS TIMESTAMP) AS "interval",
      {sql.summary("value")} FROM records WHERE type = 'view'
      GROUP BY device, date_trunc('day', "startDate")""")
query("trend_local_day", event_records,
      lambda r: trend.trend(r, "error", "day", scale=SCALE, tz="America/New_York"),
      # The table's dates lie outside daylight saving time, so the zone is five hours behind.
      EVENTS + f"""SELECT type, "sourceName",
      CAST(date_trunc('day', "startDate" - INTERVAL 5 HOUR) AS TIMESTAMP) AS "interval",
      {sql.summary("value")}, unit FROM records WHERE type = 'error'
      GROUP BY date_trunc('day', "startDate" - INTERVAL 5 HOUR), type, "sourceName", unit""")


def gap_sql(views: str, interval: str, step: str, where: str = "TRUE") -> str:
    return views + f""", filled AS (
      SELECT type, CAST(date_trunc('{interval}', "startDate") AS TIMESTAMP) AS date,
             {sql.mean("value")} AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value,
             {sql.total("value")} AS value_sum, COUNT(value) AS n
      FROM records WHERE {where} GROUP BY type, date_trunc('{interval}', "startDate")),
    spine AS (
      SELECT type, CAST(unnest(generate_series(MIN(date), MAX(date), {step})) AS TIMESTAMP) AS date
      FROM filled GROUP BY type)
    SELECT s.type, s.date, f.avg_value, f.min_value, f.max_value,
           COALESCE(f.value_sum, 0.0) AS value_sum, CAST(COALESCE(f.n, 0) AS BIGINT) AS "count"
    FROM spine s LEFT JOIN filled f ON s.type = f.type AND s.date = f.date"""


query("trend_gapfilled", order_records,
      lambda r: trend.trend_gapfilled(r, None, "day", scale=SCALE),
      gap_sql(ORDERS, "day", "INTERVAL 1 DAY"))
query("trend_gapfilled_week", order_records,
      lambda r: trend.trend_gapfilled(r, "3-MEDIUM", "week", "1996-02-10T00:00:00+00:00", scale=SCALE),
      gap_sql(ORDERS, "week", "INTERVAL 7 DAY", "type = '3-MEDIUM' AND \"startDate\" >= TIMESTAMP '1996-02-10'"))
query("trend_gapfilled_month", order_records,
      lambda r: trend.trend_gapfilled(r, None, "month", scale=SCALE),
      gap_sql(ORDERS, "month", "INTERVAL 1 MONTH"))

# --- insights ------------------------------------------------------------------------------
query("extreme_records", event_records, search.extreme_records,
      EVENTS + """SELECT *, 'lowest' AS extreme FROM records QUALIFY ROW_NUMBER() OVER
      (PARTITION BY type ORDER BY value, record_id) = 1
      UNION ALL SELECT *, 'highest' AS extreme FROM records QUALIFY ROW_NUMBER() OVER
      (PARTITION BY type ORDER BY value DESC, record_id) = 1""")
query("source_overlap", order_records, lambda r: insights.source_overlap(r, "week"),
      ORDERS + """SELECT CAST(date_trunc('week', "startDate") AS TIMESTAMP) AS "interval", type,
      COUNT(DISTINCT "sourceName") AS n_sources, COUNT(*) AS n_records FROM records
      GROUP BY date_trunc('week', "startDate"), type HAVING COUNT(DISTINCT "sourceName") > 1""")
query("last_week_daily", event_records,
      lambda r: insights.last_week_daily(r, "purchase", scale=SCALE),
      trend_sql(EVENTS, "day", """type = 'purchase' AND "startDate" >=
      (SELECT MAX("startDate") - INTERVAL 7 DAY FROM records WHERE type = 'purchase')"""))


def _lasting(spark, sf_dir):
    """Events as records that last up to two hours, one in seven without length."""
    minutes = F.when(F.col("record_id") % 7 == 0, 0).otherwise(F.col("record_id") * 37 % 121)
    rows = event_records(spark, sf_dir)
    return rows.withColumn("endDate", F.timestamp_micros(F.unix_micros("startDate") + minutes * 60_000_000))


def _overlap_time(records):
    found = overlap.source_overlap_time(records, cell_rows=200)
    return found.withColumns({c: F.round(c, 4) for c in ("first_value", "second_value", "double_counted")})


query("source_overlap_time", _lasting, _overlap_time,
      EVENTS + """SELECT * REPLACE (round(first_value, 4) AS first_value, round(second_value, 4) AS second_value), round(least(first_value, second_value), 4) AS double_counted
      FROM (WITH r AS (SELECT type, "sourceName" AS src, epoch_us("startDate") AS s,
        epoch_us("startDate") + 60000000 * CASE WHEN record_id % 7 = 0 THEN 0 ELSE record_id * 37 % 121 END AS e, coalesce(value, 0) AS v FROM records),
      marked AS (SELECT *, s > coalesce(max(e) OVER (PARTITION BY type, src ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh
        FROM r WHERE e > s),
      numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY type, src ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked),
      isle AS (SELECT type, src, min(s) AS s, max(e) AS e FROM numbered GROUP BY type, src, k),
      lengths AS (SELECT a.type, a.src AS x, b.src AS y, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS time
        FROM isle a JOIN isle b ON a.type = b.type AND a.src <> b.src AND a.s < b.e AND b.s < a.e GROUP BY ALL),
      parts AS (SELECT r.type, r.src AS x, i.src AS y,
          sum(CASE WHEN r.e > r.s THEN v * (least(r.e, i.e) - greatest(r.s, i.s)) / (r.e - r.s) ELSE v END) AS value,
          sum((r.e = r.s)::INT) AS instants
        FROM r JOIN isle i ON r.type = i.type AND r.src <> i.src AND ((r.e > r.s AND r.s < i.e AND i.s < r.e) OR (r.e = r.s AND r.s >= i.s AND r.s < i.e))
        GROUP BY ALL),
      pairs AS (SELECT coalesce(p.type, l.type) AS type, coalesce(p.x, l.x) AS x, coalesce(p.y, l.y) AS y, time, value, instants
        FROM parts p FULL JOIN lengths l ON p.type = l.type AND p.x = l.x AND p.y = l.y)
      SELECT type, least(x, y) AS first_source, greatest(x, y) AS second_source, coalesce(max(time), 0) / 1e6 AS overlap_seconds,
        coalesce(sum(value) FILTER (WHERE x < y), 0.0) AS first_value, coalesce(sum(value) FILTER (WHERE x > y), 0.0) AS second_value,
        coalesce(sum(instants), 0)::BIGINT AS instants FROM pairs GROUP BY ALL)""")
query("downsample", event_records, lambda r: insights.downsample(r, "day", SCALE),
      EVENTS + f"""SELECT type, "sourceName", unit,
      CAST(date_trunc('day', "startDate") AS TIMESTAMP) AS "startDate", {sql.mean("value")} AS value,
      MIN(value) AS min_value, MAX(value) AS max_value, COUNT(value) AS n_values
      FROM records GROUP BY type, "sourceName", unit, date_trunc('day', "startDate")""")
query("outliers", event_records,
      lambda r: insights.outliers(r, 3.0, scale=SCALE).select("record_id", "type", "value", "startDate"),
      EVENTS + """, moments AS (
        SELECT type, AVG(value) AS m, STDDEV_SAMP(value) AS sd FROM records GROUP BY type)
      SELECT record_id, r.type, value, "startDate" FROM records r JOIN moments USING (type)
      WHERE sd > 0 AND ABS((value - m) / sd) > 3.0""")

_ROBUST = ["record_id", "type", "value", "median_value", "mad_value"]


def _robust(z: float):
    return lambda r: quantiles.robust_outliers(r, z).select(*_ROBUST, F.round("robust_z", 6).alias("robust_z"))


def _robust_sql(views: str, z: float) -> str:
    return views + f"""SELECT record_id, type, value, m AS median_value, d AS mad_value, round((value - m) / (d * 1.4826), 6) AS robust_z
    FROM records JOIN (SELECT type, median(value) AS m, mad(value) AS d FROM records GROUP BY type) USING (type)
    WHERE d > 0 AND abs((value - m) / (d * 1.4826)) > {z}"""


query("outliers_robust", event_records, _robust(3.5), _robust_sql(EVENTS, 3.5))
query("outliers_robust_orders", order_records, _robust(1.2), _robust_sql(ORDERS, 1.2))
