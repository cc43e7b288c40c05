"""Queries over workouts and their statistics."""

from __future__ import annotations

from ..operators import search, summary, workouts as ops
from ..params import SearchParams
from ..session import scratch_dir
from ..sinks import buckets
from . import sql
from .views import SCALE, event_records, stats, workouts

VIEWS = sql.with_views(sql.WORKOUTS, sql.STATS)
PAIRS = 'FROM workouts w INNER JOIN stats s ON w."startDate" = s."startDate"'
KEYED = "FROM workouts w INNER JOIN stats s ON w.workout_id = s.workout_id"
COLUMNS = """w.workout_id, w.type, w.duration, w."durationUnit", w."sourceName", w."startDate",
  s.workout_id AS stat_workout_id, s.type AS stat_type, s."startDate" AS "stat_startDate",
  s."sum", s.maximum, s.unit"""
STAT_ORDER = 's.workout_id, s.type, s."sum", s.maximum, s.unit'

QUERIES = {}
ORACLES = {}


def query(name: str, build, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(workouts(spark, sf_dir), stats(spark, sf_dir))
    ORACLES[name] = oracle


def per_measure(pairs: str, head: str, keys: str, where: str, duration_unit: str) -> str:
    """Both measures of the pairs, one SELECT each."""
    parts = []
    for label, measure, unit in (("duration", "w.duration", duration_unit), ("sum", 's."sum"', "s.unit")):
        parts.append(f"""SELECT {head}, '{label}' AS measure, {sql.summary(measure)}, {unit} AS unit
          {pairs} WHERE {where} GROUP BY {keys}, {unit}""")
    return VIEWS + "\nUNION ALL\n".join(parts)


# --- joins ---------------------------------------------------------------------------------
query("join_workout_stats", ops.workout_stat_pairs, VIEWS + f"""
  SELECT w."startDate", w.type, w."sourceName", w."durationUnit", s.type AS stat_type, s.unit,
         COUNT(DISTINCT w.workout_id) AS n_workouts,
         CAST(COUNT(*) / COUNT(DISTINCT w.workout_id) AS BIGINT) AS n_stats,
         MIN(w.duration) AS min_duration, MAX(w.duration) AS max_duration,
         MIN(s."sum") AS min_sum, MAX(s."sum") AS max_sum, COUNT(*) AS pairs
  {PAIRS} GROUP BY w."startDate", w.type, w."sourceName", w."durationUnit", s.type, s.unit""")
query("join_workout_stats_keyed", ops.keyed_pairs, VIEWS + f"""
  SELECT w.workout_id, w.type, w.duration, w."durationUnit", w."sourceName", w."startDate",
         s.type AS stat_type, s."startDate" AS "stat_startDate", s."sum", s.maximum, s.unit {KEYED}""")

# --- summaries -----------------------------------------------------------------------------
OF_WORKOUTS = f"""SELECT w.type, COUNT(*) AS "count", COUNT(DISTINCT w.workout_id) AS count_workouts
  {PAIRS} GROUP BY w.type"""
query("summary_workouts", summary.summary_workouts, VIEWS + OF_WORKOUTS)
query("summary_workouts_keyed", summary.summary_workouts_keyed,
      VIEWS + OF_WORKOUTS.replace(PAIRS, KEYED))
QUERIES["summary"] = lambda spark, sf_dir: summary.summary(
    event_records(spark, sf_dir), workouts(spark, sf_dir), stats(spark, sf_dir))
ORACLES["summary"] = sql.with_views(sql.EVENT_RECORDS, sql.WORKOUTS, sql.STATS) + f"""
  SELECT type, COUNT(*) AS "count", 'records' AS source_table, CAST(NULL AS BIGINT) AS count_workouts
  FROM records GROUP BY type
  UNION ALL SELECT type, "count", 'workouts' AS source_table, count_workouts FROM ({OF_WORKOUTS})"""

# --- search --------------------------------------------------------------------------------
query("search_workouts",
      lambda w, s: ops.search_workouts(w, s, SearchParams(record_type="5-LOW")),
      VIEWS + f"""SELECT {COLUMNS} {PAIRS} WHERE w.type = '5-LOW'
      ORDER BY w."startDate" DESC, w.workout_id, {STAT_ORDER} LIMIT 10""")
query("search_workouts_in_year",
      lambda w, s: ops.search_workouts(w, s, SearchParams(
          record_type="2-HIGH", source_name="P", date_from="1996-01-01T00:00:00+00:00",
          date_to="1996-12-31T23:59:59+00:00", value_min="10", value_max="45.5", limit=200)),
      VIEWS + f"""SELECT {COLUMNS} {PAIRS} WHERE w.type = '2-HIGH' AND w."sourceName" = 'P'
      AND w."startDate" >= TIMESTAMP '1996-01-01 00:00:00'
      AND w."startDate" <= TIMESTAMP '1996-12-31 23:59:59' AND s."sum" >= 10 AND s."sum" <= 45.5
      ORDER BY w."startDate" DESC, w.workout_id, {STAT_ORDER} LIMIT 200""")
query("search_duration",
      lambda w, s: ops.search_workouts(w, s, SearchParams(
          record_type="1-URGENT", min_workout_duration="100000",
          max_workout_duration="250000.5", limit=40)),
      VIEWS + f"""SELECT {COLUMNS} {PAIRS} WHERE w.type = '1-URGENT'
      AND w.duration >= 100000 AND w.duration <= 250000.5
      ORDER BY w."startDate" DESC, w.workout_id, {STAT_ORDER} LIMIT 40""")
query("search_workouts_keyed",
      lambda w, s: ops.search_workouts_keyed(w, s, SearchParams(record_type="3-MEDIUM", limit=30)),
      VIEWS + f"""SELECT {COLUMNS} {KEYED} WHERE w.type = '3-MEDIUM'
      ORDER BY w."startDate" DESC, w.workout_id, s.type, s."startDate", s."sum", s.maximum, s.unit
      LIMIT 30""")
query("extreme_workouts", lambda w, s: search.extreme_records(w, "duration"), VIEWS + """
  SELECT *, 'lowest' AS extreme FROM workouts QUALIFY ROW_NUMBER() OVER
  (PARTITION BY type ORDER BY duration, workout_id) = 1
  UNION ALL SELECT *, 'highest' AS extreme FROM workouts QUALIFY ROW_NUMBER() OVER
  (PARTITION BY type ORDER BY duration DESC, workout_id) = 1""")

# --- statistics and trends -----------------------------------------------------------------
TYPED, TYPED_KEYS = "w.type, s.type AS stat_type", "w.type, s.type"
query("stats_workout", lambda w, s: ops.stats_workout(w, s, "5-LOW", SCALE),
      per_measure(PAIRS, TYPED, TYPED_KEYS, "w.type = '5-LOW'", 'w."durationUnit"'))
query("stats_workout_stat_unit",
      lambda w, s: ops.stats_workout(w, s, None, SCALE, own_unit=False),
      per_measure(PAIRS, TYPED, TYPED_KEYS, "TRUE", "s.unit"))
query("stats_workout_keyed", lambda w, s: ops.stats_workout_keyed(w, s, "5-LOW", SCALE),
      per_measure(KEYED, TYPED, TYPED_KEYS, "w.type = '5-LOW'", 'w."durationUnit"'))


def trend_sql(pairs: str, interval: str, where: str, duration_unit: str, stat_type: bool) -> str:
    at = f"""date_trunc('{interval}', w."startDate")"""
    extra = ", s.type AS stat_type" if stat_type else ""
    return per_measure(
        pairs, f"""CAST({at} AS TIMESTAMP) AS "interval", w.type, w."sourceName"{extra}""",
        f"""{at}, w.type, w."sourceName"{", s.type" if stat_type else ""}""", where, duration_unit)


IN_1996 = """w.type = '1-URGENT' AND w."startDate" >= TIMESTAMP '1996-01-01 00:00:00'
  AND w."startDate" <= TIMESTAMP '1996-12-31 23:59:59'"""
YEAR_1996 = ("1996-01-01T00:00:00+00:00", "1996-12-31T23:59:59+00:00")
query("trend_workout",
      lambda w, s: ops.trend_workout(w, s, "1-URGENT", "month", *YEAR_1996, scale=SCALE),
      trend_sql(PAIRS, "month", IN_1996, 'w."durationUnit"', False))
query("trend_workout_stat_unit",
      lambda w, s: ops.trend_workout(w, s, None, "year", scale=SCALE, own_unit=False),
      trend_sql(PAIRS, "year", "TRUE", "s.unit", False))
query("trend_workout_by_stat",
      lambda w, s: ops.trend_workout(w, s, "1-URGENT", "week", *YEAR_1996, scale=SCALE,
                                     by_stat_type=True),
      trend_sql(PAIRS, "week", IN_1996, 'w."durationUnit"', True))
query("trend_workout_keyed",
      lambda w, s: ops.trend_workout_keyed(w, s, "1-URGENT", "month", scale=SCALE),
      trend_sql(KEYED, "month", "w.type = '1-URGENT'", 'w."durationUnit"', True))

# --- pairs that are stored cut by workout ----------------------------------------------------
PAIR_BUCKETS = 8
_CUT: dict[tuple, tuple[str, int]] = {}


def stored_pairs(spark, sf_dir: str) -> ops.Parts:
    """All workouts and statistics, cut by workout; written once per application."""
    frames, names = (workouts(spark, sf_dir), stats(spark, sf_dir)), ("workouts", "stats")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CUT:
        folder = scratch_dir(spark, "pairs")
        _CUT[key] = folder, buckets.write_pairs(*frames, folder, names, "workout_id", PAIR_BUCKETS)
    folder, hot = _CUT[key]
    return buckets.read_pairs(spark, folder, names, tuple(f.schema for f in frames), "workout_id", PAIR_BUCKETS, hot)


def paired_query(name: str, like: str, build) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(
        workouts(spark, sf_dir), stats(spark, sf_dir), stored_pairs(spark, sf_dir))
    ORACLES[name] = ORACLES[like]


paired_query("summary_workouts_paired", "summary_workouts_keyed", summary.summary_workouts_keyed)
paired_query("stats_workout_paired", "stats_workout_keyed",
             lambda w, s, parts: ops.stats_workout_keyed(w, s, "5-LOW", SCALE, parts))
paired_query("trend_workout_paired", "trend_workout_keyed",
             lambda w, s, parts: ops.trend_workout_keyed(w, s, "1-URGENT", "month", scale=SCALE, parts=parts))
