"""Queries over documents."""

from __future__ import annotations

from ..operators import documents as ops
from ..params import SearchParams
from . import sql
from .record_queries import gap_sql
from .views import SCALE, event_documents, text_documents

EVENTS, TEXTS = sql.with_views(sql.EVENT_DOCUMENTS), sql.with_views(sql.TEXT_DOCUMENTS)
BEST = 'ORDER BY score DESC, "dateComponents" DESC, record_id'

QUERIES = {}
ORACLES = {}


def query(name: str, view, build, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(view(spark, sf_dir))
    ORACLES[name] = oracle


query("search_all", event_documents, ops.match_all,
      EVENTS + 'SELECT * FROM documents_view ORDER BY "dateComponents" DESC, record_id LIMIT 10')

WORDS = ["the", "une", "sind", "of_the", "und", "42"]
query("token_match", text_documents,
      lambda d: ops.token_match(d, " ".join(WORDS)).select("doc_id", "type", "score"),
      TEXTS + f"""SELECT doc_id, type, {sql.shared("textvalue", WORDS)} AS score FROM documents_view
      WHERE {sql.shared("textvalue", WORDS)} > 0""")
query("token_match_best", text_documents,
      lambda d: ops.doc_search_values(d, "Reference, mentions; THAT", "fr", limit=20)
      .select("doc_id", "type", "score"),
      TEXTS + f"""SELECT doc_id, type, {sql.shared("textvalue", ["reference", "mentions", "that"])}
      + {sql.shared("type", ["fr"])} AS score FROM documents_view
      WHERE {sql.shared("textvalue", ["reference", "mentions", "that"])} > 0
      AND {sql.shared("type", ["fr"])} > 0 ORDER BY score DESC, doc_id LIMIT 20""")
query("doc_range", event_documents,
      lambda d: ops.doc_range(d, "2024-01-10T00:00:00+00:00", "2024-01-12", None, "50"),
      EVENTS + """SELECT * FROM documents_view
      WHERE "dateComponents" >= TIMESTAMP '2024-01-10 00:00:00'
      AND "dateComponents" <= TIMESTAMP '2024-01-12 00:00:00' AND value <= 50""")
query("doc_search", event_documents,
      lambda d: ops.doc_search(d, SearchParams(
          record_type="Click or SIGNUP", source_name="user 4", date_from="2024-01-02",
          date_to="2024-01-20", value_min="5", value_max="200", limit=30)),
      EVENTS + f"""SELECT *, {sql.shared("type", ["click", "or", "signup"])}
      + {sql.shared('"sourceName"', ["user", "4"])} AS score FROM documents_view
      WHERE {sql.shared("type", ["click", "or", "signup"])} > 0
      AND {sql.shared('"sourceName"', ["user", "4"])} > 0
      AND "dateComponents" >= TIMESTAMP '2024-01-02 00:00:00'
      AND "dateComponents" <= TIMESTAMP '2024-01-20 00:00:00'
      AND value >= 5 AND value <= 200 {BEST} LIMIT 30""")
query("doc_search_values", event_documents,
      lambda d: ops.doc_search_values(d, "69 12", "purchase", "2024-01-02", None, 25),
      EVENTS + f"""SELECT *, {sql.shared("textvalue", ["69", "12"])}
      + {sql.shared("type", ["purchase"])} AS score FROM documents_view
      WHERE {sql.shared("textvalue", ["69", "12"])} > 0 AND {sql.shared("type", ["purchase"])} > 0
      AND "dateComponents" >= TIMESTAMP '2024-01-02 00:00:00' {BEST} LIMIT 25""")
query("total_docs", text_documents, ops.total_docs,
      TEXTS + "SELECT COUNT(type) AS total_records FROM documents_view")
query("summary_docs", text_documents, ops.summary_docs,
      TEXTS + """SELECT type, COUNT(*) AS "count" FROM documents_view WHERE type IS NOT NULL
      GROUP BY type ORDER BY "count" DESC, type LIMIT 50""")
query("stats_docs", event_documents, lambda d: ops.stats_docs(d, "Signup", SCALE),
      EVENTS + f"""SELECT 'Signup' AS record_type, COUNT(*) AS total_count, COUNT(value) AS "count",
      MIN(value) AS "min", MAX(value) AS "max", {sql.mean("value")} AS avg, {sql.total("value")} AS "sum"
      FROM documents_view WHERE {sql.shared("type", ["signup"])} > 0""")
query("trend_docs", event_documents,
      lambda d: ops.trend_docs(d, "VIEW", "day", "2024-01-02", "2024-01-29", SCALE),
      gap_sql(EVENTS + f""", records AS (SELECT 'VIEW' AS type, "dateComponents" AS "startDate", value
      FROM documents_view WHERE {sql.shared("type", ["view"])} > 0)""", "day", "INTERVAL 1 DAY",
              """"startDate" >= TIMESTAMP '2024-01-02 00:00:00'
              AND "startDate" <= TIMESTAMP '2024-01-29 00:00:00'"""))
