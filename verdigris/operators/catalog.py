"""Linking provider records to local ones, candidates, contexts and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def reconcile(shelf: DataFrame, local: DataFrame) -> DataFrame:
    """Linked, shelf-only and local-only entries with link status and next action; ``local`` has ``edition`` and ``ready``."""
    both = shelf.select("doc_id", F.lit(True).alias("on_shelf")).join(local.select("doc_id", "edition", "ready", F.lit(True).alias("is_local")), "doc_id", "full_outer")
    status = F.when(F.col("is_local").isNull(), "unlinked").when(F.col("on_shelf").isNull(), "local-only").when(F.col("edition") == "mismatch", "mismatch").when(F.col("edition") == "confirmed", "confirmed").otherwise("needs-confirmation")
    rows = both.withColumn("link_status", status)
    action = F.when(F.col("link_status") == "needs-confirmation", "confirm-edition").when(F.col("link_status") == "mismatch", "review-mismatch").when(F.col("link_status") == "unlinked", "import-source").when(~F.coalesce("ready", F.lit(False)), "analyse").when(F.col("link_status") == "confirmed", "discuss").otherwise("open-local")
    return rows.select("doc_id", "link_status", action.alias("next_action"))


def status_distribution(entries: DataFrame) -> DataFrame:
    return entries.groupBy("link_status").agg(F.count("*").alias("n"), F.count_if(F.col("next_action") == "discuss").alias("discussable"))


def unique_link(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote titles that exactly one local shares a title form with."""
    r = remote.select("remote_id", F.explode(X.title_forms(F.col("title"))).alias("form"))
    p = local.select("local_id", F.explode(X.title_forms(F.col("title"))).alias("form"))
    return r.join(p, "form").groupBy("remote_id").agg(F.min("local_id").alias("local_id"), F.max("local_id").alias("other")).where("local_id = other").select("remote_id", "local_id")


def merge_candidates(rows: DataFrame) -> DataFrame:
    """One row per id: first non-empty name by rank, sources united, sold out if any says so."""
    name = F.min_by(F.nullif(F.col("name"), F.lit("")), F.when(F.coalesce("name", F.lit("")) != "", F.col("rank")))
    return rows.groupBy("candidate_id").agg(name.alias("name"), F.array_join(F.sort_array(F.collect_set(F.col("source_id").cast("string"))), ",").alias("sources"), F.bool_or("sold_out").alias("sold_out"), F.sum("ratings").alias("ratings"))


def rank_candidates(merged: DataFrame, k: int = 50) -> DataFrame:
    """Eligible first, then rating count, title key and id; the top ``k``."""
    return merged.select("candidate_id", (~F.col("sold_out")).alias("eligible"), "ratings", X.normalize_key(F.col("name")).alias("title_key")).orderBy(F.desc("eligible"), F.desc("ratings"), "title_key", "candidate_id").limit(k)


def eligibility(profile: DataFrame, route: str) -> DataFrame:
    """Why a source is left out (the first reason that holds), and whether it is on by default or by choice."""
    reason = F.when(~F.col("state").isin("confirmed", "revised"), "profile-status-not-active").when(F.col("route") != route, "profile-scope-mismatch").when(F.col("expired"), "profile-expired")
    return profile.select("source_id", reason.alias("exclusion_basis"), (reason.isNull() & ~F.col("sensitive")).alias("selected_by_default"), (reason.isNull() & F.col("sensitive")).alias("requires_explicit_selection"))


def citation_integrity(citations: DataFrame, allowed: DataFrame) -> DataFrame:
    """Citations of what is not allowed."""
    return citations.join(allowed, "locator", "left_anti")


def user_statements(turns: DataFrame) -> DataFrame:
    """Lines of user messages with their source id; blank, sensitive and process lines are left out."""
    lines = turns.where("role = 'user'").select("conv_id", "turn", F.posexplode(F.split("text", "[\r\n]+")).alias("pos", "line"))
    kept = lines.where((F.trim("line") != "") & ~F.rlike("line", F.lit(X.SENSITIVE)) & ~F.rlike("line", F.lit(X.PROCESS_TALK)))
    return kept.select(F.concat(F.lit("session:"), "conv_id", F.lit("-"), "turn", F.lit(":"), F.col("pos") + 1).alias("source_id"), F.trim("line").alias("content"))


def session_flags(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("has_system"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last_turn"))


def neighbours_by_order(paras: DataFrame) -> DataFrame:
    """The paragraph before and after each in its chapter, by locator: relative order."""
    w = Window.partitionBy("doc_id", "chapter").orderBy("paragraph_index")
    return paras.select("locator", F.lag("locator").over(w).alias("before"), F.lead("locator").over(w).alias("after"))
