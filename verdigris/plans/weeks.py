"""Queries over weeks of sessions and events, and over a catalogue of local books made of the documents, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions as S
from ..sources import catalogue, sinks
from ..sources.shared import shared_folder
from . import records

_FROM, _TO = "2024-01-08T00:00:00+08:00", "2024-01-20T12:00:00+08:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _told(s: SparkSession, d: str) -> DataFrame:
    """Every turn's whole text as an item of its session's summary; some actions speak of a chapter to read, some insights say nothing."""
    keys = ("author_explicit", "user_confirmed", "author_inference", "ai_application", "candidate_insights", "unresolved", "actions")
    k = (F.col("turn") + F.col("conv_id")) % 7
    text = F.coalesce("text", F.lit(""))
    said = F.when((k == 6) & (F.col("turn") % 2 == 0), F.concat(F.lit("阅读 ch-"), F.col("turn"), F.lit(" "), text)).when((k == 4) & (F.col("conv_id") % 5 == 1), F.lit("无")).otherwise(text)
    return _table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.element_at(F.array(*map(F.lit, keys)), (k + 1).cast("int")).alias("key"), said.alias("text"))


def _reports(s: SparkSession, d: str) -> DataFrame:
    """A report for each week from the first session to ten weeks after the last: some have nothing."""
    first = records._sessions(s, d).agg(F.min("started_at").alias("a"), F.max("started_at").alias("b"))
    days = F.sequence(F.to_date("a"), F.date_add(F.to_date("b"), 70))
    weeks = first.select(F.explode(days).alias("day")).select(S.X.week_of(F.col("day").cast("timestamp")).alias("week")).distinct()
    return S.week_reports(weeks, records._records(s, d), records._notes(s, d), records._catalog(s, d), _told(s, d), 480)


def _window(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "events-by-week")
    sinks.write_by_week(_table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", path, 480)
    return sinks.read_window(s, path, "ts", _FROM, _TO, 480).select("event_id", "user_id", "event_type")


def _catalogue(s: SparkSession, d: str) -> DataFrame:
    """Each document is a book: some have no header, a bad id or status, a broken analysis state, or none."""
    docs, k = _table(s, d, "documents"), F.col("doc_id")
    book = F.concat(F.lit("Book-"), k).alias("book_dir")
    status = F.element_at(F.array(*map(F.lit, (*catalogue.TEXT_STATES, "lost"))), (k % 8 + 1).cast("int"))
    id_ = F.when(k % 11 == 0, F.lit("short")).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256))
    head = F.concat(F.lit("stable_book_id: "), id_, F.lit("\nstatus: "), status, F.when(k % 3 != 0, F.concat(F.lit('\ntitle: "T '), k, F.lit('"'))).otherwise(F.lit("")), F.lit("\nauthors:\n  - "), "lang", F.lit("\n  - "), "source", F.lit("\nlink:\n  book_id: "), k, F.when(k % 2 == 0, "\n  mapping_status: confirmed").otherwise(""), F.lit("\n"))
    state = F.when(k % 7 == 0, F.lit('{"status":"other"}')).when(k % 7 == 1, F.lit("broken")).otherwise(F.concat(F.lit('{"status":"partial","chapters":{"coverage":0.'), k % 9, F.lit("}}")))
    return catalogue.local_books(docs.select(book), docs.where("doc_id % 13 <> 0").select(book, head.alias("text")), docs.where("doc_id % 5 <> 0").select(book, state.alias("text"))).withColumn("authors", F.array_join("authors", "|"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"week_reports": _reports, "window_events": _window, "local_catalogue": _catalogue}

_W = "strftime({} + INTERVAL 480 MINUTE, '%G-W%V')"
ORACLE_SQL: dict[str, str] = {
    "week_reports": f"""WITH {records._SESS}, {records._NOTES}, every AS (SELECT DISTINCT strftime(day, '%G-W%V') AS week FROM (SELECT unnest(generate_series(CAST(min(s) AS DATE), CAST(max(s) AS DATE) + 70, INTERVAL 1 DAY)) AS day FROM (SELECT TIMESTAMP '2023-12-30' + to_hours(CAST(conv_id * 7 AS INTEGER)) AS s FROM conversations))),
it AS (SELECT conv_id AS session_id, (turn + conv_id) % 7 AS k, turn, conv_id, coalesce(text, '') AS text FROM conversations),
tier AS (SELECT {_W.format("started_at")} AS week, CASE WHEN status = 'completed' THEN 'cd' ELSE 'sd' END AS t FROM rec UNION ALL SELECT {_W.format("occurred_at")}, 'no' FROM notes UNION ALL SELECT {_W.format("ts")}, 'bi' FROM events WHERE event_type = 'signup' AND event_id % 2 = 0
  UNION ALL SELECT {_W.format("started_at")}, CASE k WHEN 0 THEN CASE WHEN status = 'completed' THEN 'cf' END WHEN 1 THEN 'uc' WHEN 2 THEN CASE WHEN status = 'completed' THEN 'ai' END WHEN 3 THEN CASE WHEN status = 'completed' THEN 'ai' END WHEN 4 THEN CASE WHEN conv_id % 5 <> 1 AND trim(text) <> '' AND trim(text) <> '无' THEN 'cb' END WHEN 5 THEN 'un' WHEN 6 THEN CASE WHEN turn % 2 = 0 THEN 'nc' END END FROM it JOIN rec USING (session_id)),
c AS (SELECT e.week, count(*) FILTER (t = 'bi') AS book_imports, count(*) FILTER (t = 'no') AS notes, count(*) FILTER (t = 'cd') AS completed_discussions, count(*) FILTER (t = 'sd') AS skipped_discussions, count(*) FILTER (t = 'cf') AS content_facts, count(*) FILTER (t = 'uc') AS user_confirmed, count(*) FILTER (t = 'ai') AS ai_inferences, count(*) FILTER (t = 'cb') AS candidate_beliefs, count(*) FILTER (t = 'un') AS unresolved, count(*) FILTER (t = 'nc') AS next_chapters FROM every e LEFT JOIN tier USING (week) GROUP BY e.week)
SELECT *, concat_ws(',', CASE WHEN notes = 0 THEN 'no-notes' END, CASE WHEN completed_discussions + skipped_discussions = 0 THEN 'no-sessions' END, CASE WHEN content_facts = 0 THEN 'no-content-facts' END, CASE WHEN candidate_beliefs = 0 THEN 'no-candidates' END, CASE WHEN next_chapters = 0 THEN 'no-next-chapters' END) AS evidence_gaps FROM c""",
    "window_events": "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-07 16:00:00' AND ts < TIMESTAMP '2024-01-20 04:00:00'",
    "local_catalogue": """WITH b AS (SELECT doc_id AS k, doc_id % 13 = 0 AS gone, doc_id % 11 = 0 AS bad_id, doc_id % 8 = 7 AS bad_st, doc_id % 5 <> 0 AND doc_id % 13 <> 0 AS has, doc_id % 7 < 2 AS broken, * FROM documents)
SELECT 'Book-' || k AS book_dir, CASE WHEN gone THEN NULL WHEN bad_id THEN 'short' ELSE sha256(coalesce(text, '')) END AS stable_id, CASE WHEN gone OR k % 3 = 0 THEN 'Book-' || k ELSE 'T ' || k END AS title, CASE WHEN gone THEN '' ELSE lang || '|' || source END AS authors,
CASE WHEN gone OR bad_id OR bad_st THEN 'error' ELSE ['registered', 'source-missing', 'source-imported', 'needs-confirmation', 'text-ready', 'mismatch', 'error'][k % 8 + 1] END AS text_status, CASE WHEN gone OR (has AND broken) THEN 'failed' WHEN has THEN 'partial' ELSE 'not-started' END AS analysis_status,
CASE WHEN gone OR (has AND broken) THEN NULL WHEN has THEN (k % 9) / 10 ELSE 0.0 END AS coverage, CASE WHEN NOT gone THEN CAST(k AS VARCHAR) END AS provider_id, CASE WHEN NOT gone AND k % 2 = 0 THEN 'confirmed' ELSE 'unlinked' END AS mapping_status, 'unknown' AS edition_status,
CASE WHEN gone THEN 'header-missing' WHEN bad_st THEN 'invalid-text-status' WHEN bad_id THEN 'invalid-stable-id' WHEN has AND broken THEN 'invalid-analysis-state' END AS local_error FROM b""",
}
