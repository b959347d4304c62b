"""Strict event streams with ids that follow from what they say: profile items and beliefs.

An event is checked against the one before it in its item and, where that decides, against what its ids must be. All
rules are column expressions over an event and ``prev``, the event before: in a batch ``prev`` comes from a window, on a
stream from state, so both tell the same states and violations. A violation refuses the item's stream; other items
are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.objects import json_object, json_string
from .events import BELIEF_STEPS, PROFILE_STEPS

#: Kinds of events, what a profile item can be about, be used for and rest on, and the prefixes of ids.
CANDIDATE, DECISION, SCHEMA_VERSION = "candidate", "decision", 1
CATEGORIES = ("background", "occupation", "goals", "interests", "reading_preferences", "communication_preferences", "constraints", "traits")
SENSITIVITIES = ("normal", "sensitive")
CANDIDATE_BASES, DECISION_BASIS, BELIEF_BASIS = ("session-summary-profile-candidate", "explicit-user-request"), "explicit-user-decision", "session-summary-candidate"
EVIDENCE, SOURCE = "explicit-user-statement", "session-user-message"
PROFILE, PROFILE_EVENT, BELIEF, BELIEF_EVENT, BELIEF_CANDIDATE = "profile-", "profile-event-", "belief-", "belief-event-", "candidate-"
#: Events of profile items and of beliefs. ``seq`` is their order in the log.
PROFILE_EVENTS = "item string, seq bigint, event_id string, schema_version int, kind string, at string, from_status string, to_status string, decision string, category string, content string, content_sha256 string, evidence_type string, usage_scopes array<string>, sensitivity string, expires_at string, source struct<event_id:string,path:string,session_id:string,type:string>, user_statement string, decision_basis string"
BELIEF_EVENTS = "item string, seq bigint, event_id string, schema_version int, kind string, at string, belief_id string, from_status string, to_status string, decision string, content string, content_sha256 string, source struct<candidate_index:bigint,locator:string,session_id:string,summary_path:string>, user_statement string, decision_basis string"


def _stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


def _said(x: Column) -> Column:
    return F.coalesce(_stripped(x) != "", F.lit(False))


def _safe(x: Column) -> Column:
    return _said(x) & ~X.contains_secret(x)


def _target(status: Column, decision: Column, steps: tuple[tuple[str, str, str], ...]) -> Column:
    return F.coalesce(*[F.when((status == s) & (decision == d), to) for s, d, to in steps])


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _first(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds; a rule that is unknown holds."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), name) for broken, name in rules])


def profile_identity(source: Column, category: Column, content: Column) -> Column:
    """The canonical text of what makes a profile item one."""
    fields = {n: json_string(source[n]) for n in ("event_id", "path", "session_id", "type")}
    return json_object(source=json_object(**fields), category=json_string(category), content=json_string(_stripped(content)))


def profile_decision_id(item: Column, previous: Column, decision: Column, statement: Column, content: Column) -> Column:
    said = json_object(profile_item_id=json_string(item), previous_event_id=json_string(previous), decision=json_string(decision), user_statement=json_string(_stripped(statement)), content=json_string(_stripped(content)))
    return F.concat(F.lit(PROFILE_EVENT), _sha(F.concat(F.lit("decision\0"), said)))


def belief_decision_id(item: Column, status: Column, decision: Column, statement: Column, content: Column) -> Column:
    said = json_object(candidate_id=json_string(item), from_status=json_string(status), decision=json_string(decision), user_statement=json_string(_stripped(statement)), content=json_string(content))
    return F.concat(F.lit(BELIEF_EVENT), _sha(said))


def profile_problem(e: dict[str, Column] | Column, prev: Column, again: Column) -> Column:
    """What is wrong with a profile event; null if nothing. ``again``: an event of the item before has its id."""
    start, none_before = e["kind"] == CANDIDATE, prev.isNull()
    identity = profile_identity(e["source"], e["category"], e["content"])
    scopes, path = e["usage_scopes"], F.split(F.replace(e["source"]["path"], F.lit("\\"), F.lit("/")), "/")
    place = (F.size(path) == 4) & (path[0] == "sessions") & F.rlike(path[1], F.lit("^[0-9]{4}$")) & (path[2] == e["source"]["session_id"]) & (path[3] == "transcript.jsonl")
    sourced = (e["source"]["type"] == SOURCE) & _safe(e["source"]["session_id"]) & _safe(e["source"]["event_id"]) & _safe(e["source"]["path"]) & F.coalesce(place, F.lit(False))
    candidate = _first(
        (~_safe(e["content"]), "content"), (~e["category"].isin(*CATEGORIES), "category"),
        (~((F.size(scopes) > 0) & _same(scopes, X.canonical_scopes(scopes))), "usage-scopes"), (~e["sensitivity"].isin(*SENSITIVITIES), "sensitivity"),
        (e["expires_at"].isNotNull() & X.strict_timestamp(e["expires_at"]).isNull(), "expiry"), (~sourced, "source"), (~e["decision_basis"].isin(*CANDIDATE_BASES), "decision-basis"), (X.strict_timestamp(e["at"]).isNull(), "time"),
        (e["event_id"] != F.concat(F.lit(PROFILE_EVENT), _sha(F.concat(F.lit("candidate\0"), identity))), "event-id-not-derived"), (e["item"] != F.concat(F.lit(PROFILE), _sha(identity)), "item-id-not-derived"),
        (e["from_status"].isNotNull() | ~_same(e["to_status"], F.lit(CANDIDATE)), "transition"), (e["content_sha256"] != _sha(_stripped(e["content"])), "content-hash"), (e["evidence_type"] != EVIDENCE, "evidence"), (~none_before, "second-candidate"),
    )
    decision = _first(
        (none_before, "decision-without-candidate"), (~_same(e["from_status"], prev["to_status"]) | _target(prev["to_status"], e["decision"], PROFILE_STEPS).isNull(), "transition"), (~_safe(e["content"]), "content"),
        (~_safe(e["user_statement"]), "statement"), (~_same(e["to_status"], _target(prev["to_status"], e["decision"], PROFILE_STEPS)), "transition"), (e["decision_basis"] != DECISION_BASIS, "decision-basis"), (e["content_sha256"] != _sha(_stripped(e["content"])), "content-hash"),
        (e["event_id"] != profile_decision_id(e["item"], prev["event_id"], e["decision"], e["user_statement"], e["content"]), "event-id-not-derived"), (X.strict_timestamp(e["at"]).isNull(), "time"),
    )
    own = _first((e["event_id"].isNull() | again, "event-id-not-unique"), (~_same(e["schema_version"], F.lit(SCHEMA_VERSION)) | ~e["kind"].isin(CANDIDATE, DECISION), "schema"))
    return F.coalesce(own, F.when(start, candidate).otherwise(decision))


def belief_problem(e: dict[str, Column] | Column, prev: Column, again: Column) -> Column:
    """What is wrong with a belief event; null if nothing."""
    start, none_before, source = e["kind"] == CANDIDATE, prev.isNull(), e["source"]
    belief = F.concat(F.lit(BELIEF), F.regexp_replace(e["item"], f"^{BELIEF_CANDIDATE}", ""))
    target = _target(prev["to_status"], e["decision"], BELIEF_STEPS)
    candidate = _first(
        (~_same(e["belief_id"], belief), "belief-id"), (e["from_status"].isNotNull() | ~_same(e["to_status"], F.lit(CANDIDATE)), "transition"), (~_said(e["content"]), "content"), (e["content_sha256"] != _sha(e["content"]), "content-hash"),
        ((source["session_id"] == "") | (source["summary_path"] == "") | (source["candidate_index"] < 1), "source"), (e["decision_basis"] != BELIEF_BASIS, "decision-basis"),
        (e["event_id"] != F.concat(F.lit(BELIEF_EVENT), _sha(F.concat(F.lit("candidate-recorded\0"), e["item"]))), "event-id-not-derived"), (X.strict_timestamp(e["at"]).isNull(), "time"), (~none_before, "second-candidate"),
    )
    decision = _first(
        (none_before, "decision-without-candidate"), (~_same(e["belief_id"], prev["belief_id"]), "belief-id"), (~_same(e["from_status"], prev["to_status"]), "transition"), (~_said(e["user_statement"]), "statement"), (~_said(e["content"]), "content"),
        (e["content_sha256"] != _sha(e["content"]), "content-hash"), (e["decision_basis"] != DECISION_BASIS, "decision-basis"), (~_same(source, prev["source"]), "source"), (target.isNull() | ~_same(e["to_status"], target), "transition"),
        (F.when(e["decision"] == "revise", e["content"] != _stripped(e["content"])).otherwise(e["content"] != prev["content"]), "content-changed"),
        (e["event_id"] != belief_decision_id(e["item"], prev["to_status"], e["decision"], e["user_statement"], e["content"]), "event-id-not-derived"), (X.strict_timestamp(e["at"]).isNull(), "time"),
    )
    own = _first((~_said(e["event_id"]) | again, "event-id-not-unique"), (~_said(e["item"]), "no-item"), (~_same(e["schema_version"], F.lit(SCHEMA_VERSION)) | ~e["kind"].isin(CANDIDATE, DECISION), "schema"))
    return F.coalesce(own, F.when(start, candidate).otherwise(decision))


RULES = {"profile": profile_problem, "belief": belief_problem}


def with_previous(events: DataFrame) -> DataFrame:
    """Each event with ``prev``, the one before it in its item, and ``again``, whether one before it there has its id: two windows, nothing is gathered."""
    whole = F.struct(*[F.col(c) for c in events.columns])
    rows = events.withColumn("again", F.row_number().over(Window.partitionBy("item", "event_id").orderBy("seq")) > 1)
    return rows.withColumn("prev", F.lag(whole).over(Window.partitionBy("item").orderBy("seq")))


def checked(rows: DataFrame, kind: str) -> DataFrame:
    """``item, seq, event_id, problem, to_status, content`` of events with ``prev`` and ``again``, batch or stream."""
    return rows.select("item", "seq", "event_id", RULES[kind]({c: F.col(c) for c in rows.columns}, F.col("prev"), F.col("again")).alias("problem"), "to_status", "content")


def violations(events: DataFrame, kind: str) -> DataFrame:
    """``item, seq, problem`` of all events that something is wrong with."""
    return checked(with_previous(events), kind).where("problem is not null").select("item", "seq", "problem")


def states(events: DataFrame, kind: str) -> DataFrame:
    """``item, refused, status, content, event_id, events``: each item's last event; what it says counts only if the item is not refused."""
    return folded(checked(with_previous(events), kind))


def folded(rows: DataFrame) -> DataFrame:
    """The states of checked events: one aggregation, combined before the shuffle."""
    out = rows.groupBy("item").agg(F.max(F.col("problem").isNotNull()).alias("refused"), F.max_by(F.struct("to_status", "content", "event_id"), "seq").alias("last"), F.count("*").alias("events"))
    sure = lambda c: F.when(~F.col("refused"), F.col(f"last.{c}"))
    return out.select("item", "refused", sure("to_status").alias("status"), sure("content").alias("content"), sure("event_id").alias("event_id"), "events")


def lenient_states(events: DataFrame) -> DataFrame:
    """``item, status, content, event_id``: what a reader of damaged logs takes for an item's state: its last registration, and the last decision after it, without checking either. Items that were never registered have none."""
    registered = events.where(F.col("kind") == CANDIDATE).groupBy("item").agg(F.max("seq").alias("since"))
    after = events.join(registered, "item").where("seq >= since")
    status = F.max_by("to_status", F.when((F.col("kind") != CANDIDATE) & (F.coalesce("to_status", F.lit("")) != ""), F.col("seq")))
    return after.groupBy("item").agg(F.coalesce(status, F.lit(CANDIDATE)).alias("status"), F.max_by(F.struct("content", "event_id"), "seq").alias("last")).select("item", "status", "last.content", "last.event_id")


#: What an audit of a stream names, in the order of the rules.
CHECKS = {
    "profile": ("event-id-not-unique", "schema", "content", "category", "usage-scopes", "sensitivity", "expiry", "source", "decision-basis", "time", "event-id-not-derived", "item-id-not-derived", "transition", "content-hash", "evidence", "second-candidate", "decision-without-candidate", "statement"),
    "belief": ("event-id-not-unique", "no-item", "schema", "belief-id", "transition", "content", "content-hash", "source", "decision-basis", "event-id-not-derived", "time", "second-candidate", "decision-without-candidate", "statement", "content-changed"),
}


def audit(events: DataFrame, kind: str) -> DataFrame:
    """``check, violations, ok``: every rule of a stream by name, all of them counted in one pass."""
    names = CHECKS[kind]
    counted = checked(with_previous(events), kind).agg(*[F.count_if(F.col("problem") == n).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("violations"), (F.col(f"`{n}`") == 0).alias("ok")) for n in names])
    return counted.select(F.explode(rows).alias("x")).select("x.*")
