"""Personal context: what a task may use, what it was given, and whether that still holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("source_id", "source_type", "content", "exclusion_basis", "selected_by_default", "requires_explicit_selection")


def history_sources(statements: DataFrame) -> DataFrame:
    """Statements of former sessions (``source_id, content``): always a choice, never a default."""
    return statements.select("source_id", F.lit("historical-statement").alias("source_type"), "content", F.lit(None).cast("string").alias("exclusion_basis"), F.lit(False).alias("selected_by_default"), F.lit(True).alias("requires_explicit_selection"))


def current_sources(lines: DataFrame) -> DataFrame:
    """What the task itself says (``task, position, content``): on by default."""
    return lines.select(F.concat(F.lit("current:"), F.col("task").cast("string"), F.lit(":"), F.col("position").cast("string")).alias("source_id"), F.lit("current-request").alias("source_type"), "content", F.lit(None).cast("string").alias("exclusion_basis"), F.lit(True).alias("selected_by_default"), F.lit(False).alias("requires_explicit_selection"))


def assembled(parts: list[DataFrame]) -> DataFrame:
    """All sources in one table; ``duplicate`` marks those whose id another has too, with which no packet may be built."""
    every = reduce(DataFrame.unionByName, [p.select(*FIELDS) for p in parts])
    twice = every.groupBy("source_id").agg((F.count("*") > 1).alias("duplicate"))
    return every.join(twice, "source_id")


def bundle_hash(sources: DataFrame, buckets: int = 256) -> DataFrame:
    """One row: the sources and a digest that changes with any of them and not with their order or the time; digests of buckets are combined, so no task sees all."""
    line = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in FIELDS]), 256)
    rows = sources.select(line.alias("h")).withColumn("bucket", F.substring("h", 1, 2))
    parts = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h"))
    return parts.agg(F.sum("n").alias("sources"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "\n"), 256).alias("bundle_sha256"))


def selected(sources: DataFrame, choices: DataFrame, confirm_defaults: bool = True) -> DataFrame:
    """``source_id, selected, basis``: an exclusion beats an inclusion, that a confirmed default. ``choices`` has ``source_id, choice`` (include, exclude)."""
    made = choices.groupBy("source_id").agg(F.bool_or(F.col("choice") == "exclude").alias("out"), F.bool_or(F.col("choice") == "include").alias("in"))
    rows = sources.where("exclusion_basis is null").select("source_id", "selected_by_default").join(made, "source_id", "left")
    basis = F.when(F.col("out"), "excluded").when(F.col("in"), "explicit-user-context-confirmation").when(F.lit(confirm_defaults) & F.col("selected_by_default"), "confirmed-default")
    return rows.select("source_id", (basis.isNotNull() & (basis != "excluded")).alias("selected"), basis.alias("basis"))


def choice_problems(sources: DataFrame, choices: DataFrame) -> DataFrame:
    """``source_id, problem``: choices of sources that are not there, and sources both included and excluded."""
    made = choices.groupBy("source_id").agg(F.countDistinct("choice").alias("n"))
    known = sources.where("exclusion_basis is null").select("source_id", F.lit(True).alias("known"))
    rows = made.join(known, "source_id", "left")
    return rows.select("source_id", F.when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "included-and-excluded").alias("problem")).where("problem is not null")


def reviewed(before: DataFrame, sources: DataFrame, choices: DataFrame) -> DataFrame:
    """A task's review: earlier explicit inclusions stay, its own request rows are on even without confirmation, exclusions win. ``before`` has ``source_id, basis``."""
    kept = before.where("basis = 'explicit-user-context-confirmation'").select("source_id", F.lit("include").alias("choice"))
    own = sources.where("source_type = 'current-request'").select("source_id", F.lit("include").alias("choice"))
    return selected(sources, choices.select("source_id", "choice").unionByName(kept).unionByName(own), confirm_defaults=False)


def frozen(packet: DataFrame) -> DataFrame:
    """The selected rows of a packet with the hash of each, to be stored beside the digest of all."""
    return packet.where("selected").select("source_id", "basis", F.sha2(F.concat_ws("\x00", "source_id", F.coalesce("content", F.lit(""))), 256).alias("content_sha256"))


def frozen_problems(stored: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_id, problem`` of a stored packet: sources that are gone, changed, or need a choice that nobody made."""
    now = sources.select("source_id", "exclusion_basis", "requires_explicit_selection", F.sha2(F.concat_ws("\x00", "source_id", F.coalesce("content", F.lit(""))), 256).alias("is"))
    rows = stored.join(now, "source_id", "left")
    explicit = F.col("basis") == "explicit-user-context-confirmation"
    problem = F.when(F.col("is").isNull() | F.col("exclusion_basis").isNotNull(), "not-available").when(F.col("is") != F.col("content_sha256"), "changed").when(F.col("requires_explicit_selection") & ~explicit, "not-chosen")
    return rows.select("source_id", problem.alias("problem")).where("problem is not null")


def scope_filter(route: Column, scopes: Column) -> Column:
    return F.array_contains(scopes, route)
