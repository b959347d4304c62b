"""Append-only event logs: idempotent ingestion, folds, weeks and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lifecycle transitions as (state, decision, next state).
PROFILE_STEPS = (("candidate", "confirm", "confirmed"), ("candidate", "revise", "revised"), ("candidate", "reject", "rejected"), ("confirmed", "revise", "revised"), ("confirmed", "retire", "retired"), ("revised", "revise", "revised"), ("revised", "retire", "retired"))
BELIEF_STEPS = (
    ("candidate", "confirm", "provisional"), ("provisional", "confirm", "confirmed"), ("candidate", "revise", "provisional"), ("provisional", "revise", "revised"), ("confirmed", "revise", "revised"),
    ("revised", "revise", "revised"), ("candidate", "reject", "rejected"), ("provisional", "retire", "retired"), ("confirmed", "retire", "retired"), ("revised", "retire", "retired"),
)


def new_events_only(incoming: DataFrame, stored: DataFrame, key: str = "event_id") -> DataFrame:
    """Incoming rows whose id is not stored yet, each id once."""
    return incoming.join(stored.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def latest(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key in append order: one aggregation, combined before the shuffle."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("x")).select(key, "x.*")


def fold(events: DataFrame, key: str, seq: str, decision: str, steps: tuple[tuple[str, str, str], ...], start: str = "candidate", block: int = 4096) -> DataFrame:
    """State after all decisions of a key in order; illegal ones leave it and are counted.

    A key of up to ``block`` events is folded in one row. The events of a larger one are dealt out by ranges of their
    numbers, each range folded for every state it could begin in; the outcomes of the ranges, a few numbers each, are
    then composed in order. So a key with most of all events is many tasks' work.
    """
    names = sorted({x for s, _, t in steps for x in (s, t)} | {start})
    table = F.create_map(*[F.lit(x) for s, d, t in steps for x in (f"{s}+{d}", t)])
    result = lambda state, applied, illegal: F.struct(state.alias("state"), applied.alias("applied"), illegal.alias("illegal"))

    def step(acc, e):
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("+"), e["d"]))
        return result(F.coalesce(to, acc["state"]), acc["applied"] + F.when(to.isNotNull(), 1).otherwise(0), acc["illegal"] + F.when(to.isNull(), 1).otherwise(0))

    ordered = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(decision).alias("d"))))
    whole = lambda rows: rows.groupBy(key).agg(F.aggregate(ordered, result(F.lit(start), F.lit(0), F.lit(0)), step).alias("x"))
    hot = events.groupBy(key).agg(F.count("*").alias("__n"), F.min(seq).alias("__from"), F.max(seq).alias("__to")).where(F.col("__n") > block)
    if hot.isEmpty():
        return whole(events).select(key, "x.state", "x.applied", "x.illegal")

    # As many ranges as blocks are needed, over the numbers that the key has; null is a key like any other.
    width = F.greatest(F.lit(1), F.ceil((F.col("__to") - F.col("__from") + 1) / F.ceil(F.col("__n") / block)))
    known_hot = hot.select(F.col(key).alias("__key"), "__from", width.alias("__width"))
    told = events.join(known_hot, F.col(key).eqNullSafe(F.col("__key")), "left")
    blocks = told.where("__width is not null").groupBy(key, F.floor((F.col(seq) - F.col("__from")) / F.col("__width")).alias("block")).agg(ordered.alias("e"))
    from_each = F.array(*[F.aggregate("e", result(F.lit(n), F.lit(0), F.lit(0)), step) for n in names])
    composed = blocks.select(key, F.struct("block", from_each.alias("to")).alias("b"))
    known = F.array(*map(F.lit, names))

    def then(acc, b):
        to = F.get(b["to"], F.array_position(known, acc["state"]).cast("int") - 1)
        return result(to["state"], acc["applied"] + to["applied"], acc["illegal"] + to["illegal"])

    large = composed.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list("b")), result(F.lit(start), F.lit(0), F.lit(0)), then).alias("x"))
    return whole(told.where("__width is null").select(*events.columns)).unionByName(large).select(key, "x.state", "x.applied", "x.illegal")


def weekly_report(events: DataFrame, hours: int = 8) -> DataFrame:
    """Counts and distinct users by ISO week (Monday, in a fixed offset) and type."""
    week = F.expr(f"cast(date_trunc('week', ts + interval {hours} hours) as date)")
    return events.groupBy(week.alias("week"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


def weekly_gaps(report: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Weeks that lack events of a kind."""
    weeks = report.groupBy("week").agg(F.collect_set("event_type").alias("seen"))
    return weeks.select("week", F.explode(F.array_except(F.array(*map(F.lit, kinds)), F.col("seen"))).alias("missing"))


def delta_report(events: DataFrame) -> DataFrame:
    """Each user's value by day beside the day before, and whether it changed (null-safe)."""
    daily = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("fetched"))
    before = F.lag("fetched").over(Window.partitionBy("user_id").orderBy("day"))
    return daily.select("user_id", "day", "fetched", before.alias("previous"), F.greatest(F.lit(0), F.col("fetched") - F.coalesce(before, F.lit(0))).alias("added"), (~F.col("fetched").eqNullSafe(before)).alias("changed"))
