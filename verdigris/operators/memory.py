"""Strict event streams: each event checked against the one before it, decisions appended, and what may be used of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .events import PROFILE_STEPS

START = "candidate"


def _target(status: Column, decision: Column, steps: tuple[tuple[str, str, str], ...]) -> Column:
    return reduce(lambda out, s: F.when((status == s[0]) & (decision == s[1]), s[2]).otherwise(out), steps, F.lit(None).cast("string"))


def identity(prefix: str, *parts: Column) -> Column:
    """The full hash of the parts under a prefix: the same facts have the same id."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def violations(events: DataFrame, steps: tuple[tuple[str, str, str], ...] = PROFILE_STEPS) -> DataFrame:
    """``item, seq, problem``: the first thing wrong with each event of a stream (``item, seq, event_id, kind, decision, from_status, to_status, content, content_sha256``).

    An event is checked against the one before it in its item, by one window; nothing is gathered.
    """
    order = Window.partitionBy("item").orderBy("seq")
    rows = events.withColumns({"n": F.row_number().over(order), "was": F.lag("to_status").over(order), "same": F.count("*").over(Window.partitionBy("event_id"))})
    is_start = F.col("kind") == "candidate"
    problem = (
        F.when(F.col("event_id").isNull() | (F.col("same") > 1), "event-id-not-unique").when(is_start & (F.col("n") > 1), "second-candidate").when(~is_start & (F.col("n") == 1), "decision-without-candidate")
        .when(F.sha2("content", 256) != F.col("content_sha256"), "content-hash").when(is_start & (F.col("to_status") != START), "bad-start").when(~is_start & ~F.col("from_status").eqNullSafe(F.col("was")), "from-status")
        .when(~is_start & ~_target(F.col("from_status"), F.col("decision"), steps).eqNullSafe(F.col("to_status")), "transition")
    )
    return rows.select("item", "seq", problem.alias("problem")).where("problem is not null")


def states(events: DataFrame, steps: tuple[tuple[str, str, str], ...] = PROFILE_STEPS) -> DataFrame:
    """``item, status, content, event_id``: the last event of every item without a violation."""
    bad = violations(events, steps).select("item").distinct()
    last = events.groupBy("item").agg(F.max_by(F.struct(F.col("to_status").alias("status"), "content", "event_id"), "seq").alias("x"))
    return last.join(bad, "item", "left_anti").select("item", "x.*")


def recorded(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidate events for requests (``category, content, source``) that are not stored yet; repeats change nothing."""
    item = identity("item-", F.col("source"), F.col("category"), F.col("content"))
    rows = requests.select(item.alias("item"), identity("event-", F.lit("candidate"), item).alias("event_id"), F.lit("candidate").alias("kind"), F.lit(START).alias("to_status"), "category", "content", F.sha2("content", 256).alias("content_sha256"))
    return rows.dropDuplicates(["event_id"]).join(stored.select("event_id"), "event_id", "left_anti").select(*rows.columns)


def decided(current: DataFrame, requests: DataFrame, steps: tuple[tuple[str, str, str], ...] = PROFILE_STEPS) -> DataFrame:
    """What becomes of decisions (``item, decision, statement, revised``) on current states (``item, status, content, event_id, last_decision, last_statement``).

    ``outcome`` is ``appended`` with the new event, ``duplicate`` for what the last event already says, or ``rejected``.
    A decision on nothing is rejected, and so is a revision without a text.
    """
    rows = requests.join(current, "item", "left")
    content = F.when(F.col("decision") == "revise", F.nullif(F.trim("revised"), F.lit(""))).otherwise(F.col("content"))
    rows = rows.withColumns({"target": _target(F.col("status"), F.col("decision"), steps), "text": content})
    again = F.coalesce((F.col("last_decision") == F.col("decision")) & (F.col("last_statement") == F.col("statement")) & (F.col("text") == F.col("content")), F.lit(False))
    outcome = F.when(again, "duplicate").when(F.col("target").isNull() | F.col("text").isNull() | (F.trim(F.coalesce("statement", F.lit(""))) == ""), "rejected").otherwise("appended")
    rows = rows.withColumn("outcome", outcome)
    done = F.col("outcome") == "appended"
    new = identity("event-", F.lit("decision"), F.col("item"), F.col("event_id"), F.col("decision"), F.col("statement"), F.col("text"))
    return rows.select("item", "decision", "outcome", F.when(done, new).alias("event_id"), F.when(done, F.col("status")).alias("from_status"), F.when(done, F.col("target")).alias("to_status"), F.when(done, F.sha2("text", 256)).alias("content_sha256"))


def remembered(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Two events for each new request with a ``statement``: its candidate, and the confirmation of that."""
    with_text = requests.where(F.trim(F.coalesce("statement", F.lit(""))) != "")
    first = recorded(with_text, stored)
    said = with_text.select(identity("item-", F.col("source"), F.col("category"), F.col("content")).alias("item"), "statement").groupBy("item").agg(F.min("statement").alias("statement"))
    both = first.join(said, "item")
    confirm = both.select("item", identity("event-", F.lit("decision"), F.col("item"), F.col("event_id"), F.lit("confirm"), F.col("statement"), F.col("content")).alias("event_id"), F.lit("decision").alias("kind"), F.lit("confirmed").alias("to_status"), "category", "content", "content_sha256")
    return first.unionByName(confirm)


def counts(current: DataFrame) -> DataFrame:
    """One row: active and pending items, and all."""
    return current.agg(F.count_if(F.col("status").isin("confirmed", "revised")).alias("active"), F.count_if(F.col("status") == START).alias("pending"), F.count("*").alias("items"))


def memory_mode(settings: DataFrame, users: DataFrame) -> DataFrame:
    """``user_id, mode, configured``: each user's latest setting (by ``seq``); without one, ``explicit-only``."""
    latest = settings.groupBy("user_id").agg(F.max_by("mode", "seq").alias("mode"))
    return users.select("user_id").join(latest, "user_id", "left").select("user_id", F.coalesce("mode", F.lit("explicit-only")).alias("mode"), F.col("mode").isNotNull().alias("configured"))


def mode_changes(settings: DataFrame) -> DataFrame:
    """Settings that change something: a repeat of the mode before is none."""
    before = F.lag("mode").over(Window.partitionBy("user_id").orderBy("seq"))
    return settings.withColumn("was", before).where("was is null or was <> mode").drop("was")


def belief_sources(beliefs: DataFrame) -> DataFrame:
    """``source_id, content, exclusion_basis, selected_by_default, requires_explicit_selection`` of ``item, status, content``: the first rule that holds decides."""
    text = F.trim(F.coalesce("content", F.lit("")))
    unsafe = (text == "") | F.rlike(text, F.lit(X.SENSITIVE))
    default, choice = F.col("status").isin("confirmed", "revised"), F.col("status").isin("candidate", "provisional")
    basis = F.when(unsafe, "belief-content-not-safe").when(~default & ~choice, "belief-status-not-usable")
    return beliefs.select(F.concat(F.lit("belief:"), "item").alias("source_id"), F.when(~unsafe, text).alias("content"), basis.alias("exclusion_basis"), (basis.isNull() & default).alias("selected_by_default"), (basis.isNull() & choice).alias("requires_explicit_selection"))


def lifecycle(events: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """``task, state, failed``: how far each task came: the last step that all steps before it have too; ``failed`` if its latest event (by ``seq``) is a failure."""
    seen = events.groupBy("task").agg(F.collect_set(F.when(F.col("event").isin(*steps), F.col("event"))).alias("seen"), F.max_by("event", "seq").alias("last"))
    state = F.lit(None).cast("string")
    for i in range(len(steps), 0, -1):
        state = F.when(state.isNotNull(), state).when(F.size(F.array_intersect(F.col("seen"), F.array(*map(F.lit, steps[:i])))) == i, steps[i - 1])
    return seen.select("task", F.coalesce(state, F.lit("new")).alias("state"), (F.col("last") == "failed").alias("failed"))
