"""Reading sessions, notes and weeks: which records a report may use, and what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Summaries that count, the mark of a skipped discussion, lists a summary must have, and what stands for no insight.
FINAL = ("generated", "confirmed")
SKIPPED = "discussion-skipped-by-user"
REQUIRED = ("question", "sources", "author_explicit", "author_inference", "ai_application", "user_confirmed", "disagreements", "candidate_insights", "unresolved", "actions")
NOTHING = "无"


def session_records(sessions: DataFrame, transcript: DataFrame) -> DataFrame:
    """``session_id, started_at, status``: finished sessions with a final summary; skipped if any of their events says so."""
    done = sessions.where(F.col("started_at").isNotNull() & F.col("ended_at").isNotNull() & F.col("summary_status").isin(*FINAL))
    skips = transcript.groupBy("session_id").agg(F.bool_or(F.col("event_type") == SKIPPED).alias("skipped"))
    return done.join(skips, "session_id", "left").select("session_id", "started_at", F.when(F.col("skipped"), "skipped-by-user").otherwise("completed").alias("status"))


def in_window(ts: Column, start: Column, end: Column) -> Column:
    """From the start on, before the end."""
    return (ts >= start) & (ts < end)


def week_bounds(week: str, minutes: int = 0) -> tuple[str, str]:
    """Start and end (exclusive) in UTC of an ISO week ``YYYY-Www`` that begins on Monday in an offset of so many minutes."""
    import datetime as dt
    import re

    if not re.fullmatch(r"\d{4}-W\d{2}", week) or abs(minutes) >= 24 * 60:
        raise ValueError("a week is YYYY-Www, an offset less than a day")
    monday = dt.datetime.combine(dt.date.fromisocalendar(int(week[:4]), int(week[6:]), 1), dt.time()) - dt.timedelta(minutes=minutes)
    return tuple(f"{x:%Y-%m-%dT%H:%M:%S}Z" for x in (monday, monday + dt.timedelta(days=7)))


def items(values: Column) -> Column:
    """Summary items (structs of ``text, claim, locator, source``) as ``text, locator``: empty strings count as missing, an item with neither text nor claim shows itself as JSON."""
    filled = lambda x, *names: F.coalesce(*[F.nullif(x[n], F.lit("")) for n in names])
    return F.transform(F.coalesce(values, F.expr("array()").cast("array<struct<text:string,claim:string,locator:string,source:string>>")), lambda x: F.struct(F.coalesce(filled(x, "text", "claim"), F.to_json(x)).alias("text"), filled(x, "locator", "source").alias("locator")))


def flattened(summaries: DataFrame, key: str, titles: DataFrame) -> DataFrame:
    """``session_id, position, text, locator, books, evidence``: the items of one list, with book titles (the id where there is none) and the locators of the session's sources."""
    sources = F.filter(F.transform(items(F.col("sources")), lambda x: x["locator"]), lambda x: x.isNotNull())
    rows = summaries.select("session_id", "book_ids", sources.alias("evidence"), F.posexplode(items(F.col(key))).alias("position", "x"))
    named = summaries.select("session_id", F.posexplode("book_ids").alias("at", "book_id")).join(titles, "book_id", "left").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("title", "book_id").alias("name")))).alias("named"))
    return rows.join(named, "session_id", "left").select("session_id", "position", "x.text", "x.locator", F.transform(F.coalesce("named", F.expr("array()").cast("array<struct<at:int,name:string>>")), lambda n: n["name"]).alias("books"), "evidence")


def summary_problems(summaries: DataFrame, most_candidates: int = 3) -> DataFrame:
    """``session_id, problem``: required lists that are missing, and too many profile candidates (a missing list of those is an empty one)."""
    problems = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in REQUIRED if c in summaries.columns]
    problems.append(F.when(F.coalesce(F.size("profile_candidates"), F.lit(0)) > most_candidates, "too-many-profile-candidates"))
    return summaries.select("session_id", F.explode(F.filter(F.array(*problems), lambda x: x.isNotNull())).alias("problem"))


def insight_candidates(insights: DataFrame) -> DataFrame:
    """``candidate_id, belief_id, session_id, content``: insights (``session_id, position`` from 0, ``text``) that say something, with ids that follow from them."""
    content = F.trim("text")
    rows = insights.where((content != "") & (content != NOTHING)).select("session_id", (F.col("position") + 1).alias("n"), content.alias("content"))
    rows = rows.withColumn("candidate_id", X.short_id("candidate", F.col("session_id"), F.col("n"), F.col("content")))
    return rows.select("candidate_id", X.short_id("belief", F.col("candidate_id")).alias("belief_id"), "session_id", "content")


def note_events(marks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Highlights of the provider (``book_id, bookmarkId, chapterUid, markText, range, createTime``) as note events; one without an id is named by the hash of its canonical JSON."""
    fields = ("bookmarkId", "chapterUid", "createTime", "markText", "range")
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(fields)]), {"ignoreNullFields": "false"})
    key = F.concat(F.lit("highlight:"), F.coalesce(F.nullif(F.col("bookmarkId"), F.lit("")), F.concat(F.lit("sha256:"), F.sha2(body, 256))))
    known = chapters.select("book_id", F.col("chapterUid").alias("chapterUid"), F.col("chapterIdx").alias("chapter_idx"), F.col("title").alias("chapter_title"))
    return marks.join(known, ["book_id", "chapterUid"], "left").select(key.alias("event_id"), F.lit("highlight").alias("event"), "book_id", F.col("chapterUid").alias("chapter_uid"), "chapter_idx", "chapter_title", F.col("markText").alias("mark_text"), "range", F.col("createTime").alias("create_time"))


def dated_notes(notes: DataFrame) -> DataFrame:
    """Notes with ``occurred_at``; those without any time are left out."""
    return notes.withColumn("occurred_at", X.event_time(F.col("create_time"), F.col("synced_at"))).where("occurred_at is not null")


def weekly_tiers(sessions: DataFrame, notes: DataFrame, catalog: DataFrame, insights: DataFrame, minutes: int = 0) -> DataFrame:
    """One row per week that has anything: notes, imports, sessions by status, insights, and the gaps of the evidence."""
    week = lambda c: X.week_of(F.col(c), minutes).alias("week")
    rows = [
        sessions.select(week("started_at"), F.when(F.col("status") == "completed", "completed_discussions").otherwise("skipped_discussions").alias("tier")),
        notes.select(week("occurred_at"), F.lit("notes").alias("tier")),
        catalog.where("event = 'book-imported'").select(week("at"), F.lit("book_imports").alias("tier")),
        insights.join(sessions.select("session_id", "started_at"), "session_id").select(week("started_at"), F.lit("candidate_beliefs").alias("tier")),
    ]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    tiers = ("book_imports", "notes", "completed_discussions", "skipped_discussions", "candidate_beliefs")
    counted = every.groupBy("week").agg(*[F.count_if(F.col("tier") == t).alias(t) for t in tiers])
    gaps = [F.when(F.col("notes") == 0, "no-notes"), F.when(F.col("completed_discussions") + F.col("skipped_discussions") == 0, "no-sessions"), F.when(F.col("candidate_beliefs") == 0, "no-candidates")]
    return counted.select("*", F.array_join(F.filter(F.array(*gaps), lambda x: x.isNotNull()), ",").alias("evidence_gaps"))


#: What a week's report counts, and what it says is missing where nothing was.
TIERS = ("book_imports", "notes", "completed_discussions", "skipped_discussions", "content_facts", "user_confirmed", "ai_inferences", "candidate_beliefs", "unresolved", "next_chapters")


def week_reports(weeks: DataFrame, sessions: DataFrame, notes: DataFrame, catalog: DataFrame, told: DataFrame, minutes: int = 0) -> DataFrame:
    """One row for each of ``weeks`` (``week``), also where nothing happened: ten tiers and the gaps of the evidence.

    ``sessions`` has ``session_id, started_at, status``; ``told`` has ``session_id, key, text``, the items of all
    summaries. What an author says and what is inferred counts only from completed discussions; an action is a next
    chapter if it speaks of reading one; an insight that says nothing is none.
    """
    week = lambda c: X.week_of(F.col(c), minutes).alias("week")
    done, key, text = F.col("status") == "completed", F.col("key"), F.trim("text")
    tier = (
        F.when(key == "author_explicit", F.when(done, "content_facts")).when(key == "user_confirmed", "user_confirmed").when(key.isin("author_inference", "ai_application"), F.when(done, "ai_inferences"))
        .when(key == "candidate_insights", F.when((text != "") & (text != NOTHING), "candidate_beliefs")).when(key == "unresolved", "unresolved").when((key == "actions") & X.is_next_reading(F.col("text")), "next_chapters")
    )
    rows = sessions.select(week("started_at"), F.when(done, "completed_discussions").otherwise("skipped_discussions").alias("tier"))
    rows = rows.unionByName(notes.select(week("occurred_at"), F.lit("notes").alias("tier"))).unionByName(catalog.where("event = 'book-imported'").select(week("at"), F.lit("book_imports").alias("tier")))
    rows = rows.unionByName(told.join(sessions, "session_id").select(week("started_at"), tier.alias("tier")).where("tier is not null"))
    counted = rows.groupBy("week").agg(*[F.count_if(F.col("tier") == t).alias(t) for t in TIERS])
    every = weeks.select("week").distinct().join(counted, "week", "left").select("week", *[F.coalesce(t, F.lit(0).cast("bigint")).alias(t) for t in TIERS])
    none = lambda *names: sum((F.col(n) for n in names), F.lit(0)) == 0
    gaps = F.array(F.when(none("notes"), "no-notes"), F.when(none("completed_discussions", "skipped_discussions"), "no-sessions"), F.when(none("content_facts"), "no-content-facts"), F.when(none("candidate_beliefs"), "no-candidates"), F.when(none("next_chapters"), "no-next-chapters"))
    return every.select("*", F.array_join(F.filter(gaps, lambda g: g.isNotNull()), ",").alias("evidence_gaps"))


def live_messages(references: DataFrame, transcript: DataFrame) -> DataFrame:
    """References (``session_id, event_id``, ...) to messages that the user really wrote."""
    said = transcript.where("role = 'user' and event_type = 'message'").select("session_id", "event_id")
    return references.join(said, ["session_id", "event_id"], "left_semi")
