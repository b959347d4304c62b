"""Evidence between notes, paragraphs and results: narrowing of ambiguous places, anchors, records, gates and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def narrow_by_associated(candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """``candidates`` (``note_id, locator, text``) whose paragraph also has the note's ``associated`` text.

    Applies only to notes with several candidates, and only where it leaves any; all others stay as they are.
    """
    wanted = notes.select("note_id", X.normalize_search(F.col("associated")).alias("__wanted"))
    has = F.coalesce((F.col("__wanted") != "") & F.contains(X.normalize_search(F.col("text")), F.col("__wanted")), F.lit(False))
    of_note = Window.partitionBy("note_id")
    rows = candidates.join(wanted, "note_id", "left").withColumn("__has", has)
    rows = rows.withColumns({"__n": F.count("*").over(of_note), "__any": F.max("__has").over(of_note)})
    return rows.where("__n = 1 or not __any or __has").select(*candidates.columns)


def narrow_by_order(candidates: DataFrame, notes: DataFrame, anchors: DataFrame) -> DataFrame:
    """``note_id, locator``: candidates on the side of the note's anchor that provider ranges put them.

    ``candidates`` and ``anchors`` have ``note_id, doc_id, chapter, paragraph_index, locator``; ``notes`` has
    ``note_id, note_start, anchor_start``. Offsets are compared with one another, never with paragraphs. A note
    with several anchors, or without a start, is left out, and so is one of which nothing is left.
    """
    one = anchors.groupBy("note_id").agg(F.count("*").alias("n"), *[F.first(c).alias(f"a_{c}") for c in ("doc_id", "chapter", "paragraph_index", "locator")]).where("n = 1")
    side = F.signum(F.col("note_start") - F.col("anchor_start"))
    same = (F.col("doc_id") == F.col("a_doc_id")) & (F.col("chapter") == F.col("a_chapter"))
    there = F.when(side == 0, F.col("locator") == F.col("a_locator")).otherwise(same & (F.signum(F.col("paragraph_index") - F.col("a_paragraph_index")) == side))
    return candidates.join(notes.select("note_id", "note_start", "anchor_start"), "note_id").join(one, "note_id").where(there).select("note_id", "locator")


def nearest_anchor(notes: DataFrame, anchors: DataFrame) -> DataFrame:
    """``note_id, anchor_id, distance``: the anchor of the note's chapter that starts nearest, of two as near the smaller id.

    ``notes`` has ``note_id, chapter, start`` and ``anchors`` ``anchor_id, chapter, start``. Both are put in one
    order by chapter and start, in which the nearest on each side is carried along: no pairs are made.
    """
    # Of anchors that start together the smallest id stands for all.
    spots = anchors.where("start is not null").groupBy("chapter", "start").agg(F.min("anchor_id").alias("anchor_id"))
    rows = notes.where("start is not null").select("chapter", "start", "note_id", F.lit(None).alias("anchor")).unionByName(
        spots.select("chapter", "start", F.lit(None).alias("note_id"), F.struct("start", "anchor_id").alias("anchor"))
    )
    order = Window.partitionBy("chapter").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("chapter").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"low": F.last("anchor", ignorenulls=True).over(order), "high": F.last("anchor", ignorenulls=True).over(back)}).where("anchor is null")
    found = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("start") - F.col(f"{c}.start")).alias("distance"), F.col(f"{c}.anchor_id").alias("anchor_id")))
    best = rows.withColumns({"low": found("low"), "high": found("high")}).withColumn("best", F.least("low", "high"))
    return best.where("best is not null").select("note_id", "best.anchor_id", "best.distance")


def evidence_records(citations: DataFrame, paras: DataFrame, limit: int = 2000) -> DataFrame:
    """One row per cited locator: digest, excerpt, whether it was cut, and whether the paragraph exists."""
    cited = citations.select("locator").distinct()
    found = paras.select("locator", X.sha256(F.col("text")).alias("text_sha256"), F.substring("text", 1, limit).alias("excerpt"), (F.length("text") > limit).alias("truncated"), F.lit(True).alias("__there"))
    return cited.join(found, "locator", "left").select("locator", "text_sha256", "excerpt", "truncated", F.coalesce("__there", F.lit(False)).alias("resolved"))


def missing_results(requested: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """What was requested and has no result."""
    return requested.select(*keys).distinct().join(results.select(*keys), keys, "left_anti")


def search_copy_problems(paras: DataFrame, search: DataFrame) -> DataFrame:
    """Locators at which paragraphs and their search copy differ: ``missing``, ``extra`` or ``stale``."""
    own = paras.select("locator", X.normalize_search(F.col("text")).alias("own"))
    both = own.join(search.select("locator", F.col("normalized_text").alias("copy")), "locator", "full_outer")
    problem = F.when(F.col("copy").isNull(), "missing").when(F.col("own").isNull(), "extra").when(F.col("own") != F.col("copy"), "stale")
    return both.select("locator", problem.alias("problem")).where("problem is not null")


def cleaning_summary(registry: DataFrame) -> DataFrame:
    """One row: paragraphs affected, usable and skipped, and the rules that took part."""
    rules = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.split("rules", "\\+"))))), ",")
    return registry.agg(F.count("*").alias("affected"), F.count_if(F.col("clean_status") == "usable").alias("usable"), F.count_if(F.col("clean_status") == "skipped").alias("skipped"), rules.alias("rules"))


def status_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("status").agg(F.count("*").alias("n"))


def edition_mapping(pairs: DataFrame) -> DataFrame:
    """``pair_id, mapping_status, edition_status`` of a local book (``title, authors, identifiers, confirmed``) and its remote one (``remote_title, remote_author, remote_isbn``)."""
    title = X.normalize_key(F.col("title")) == X.normalize_key(F.col("remote_title"))
    known = X.authors_match(F.col("remote_author"), F.col("authors"))
    rows = pairs.withColumns({"own": X.isbn_digits(F.col("identifiers")), "other": F.nullif(F.regexp_replace("remote_isbn", "\\D", ""), F.lit("")), "alike": title & known})
    both = F.col("own").isNotNull() & F.col("other").isNotNull()
    confirmed = F.coalesce("confirmed", F.lit(False))
    mapping = F.when(~F.col("alike"), "mismatch").when(both, F.when(F.col("own") == F.col("other"), "confirmed").otherwise("candidate")).when(confirmed, "confirmed").otherwise("candidate")
    edition = F.when(~F.col("alike"), "mismatch").when(both, F.when(F.col("own") == F.col("other"), "confirmed").otherwise("mismatch")).when(confirmed, "confirmed").otherwise("needs-confirmation")
    return rows.select("pair_id", mapping.alias("mapping_status"), edition.alias("edition_status"))


def decision_queue(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """``candidate_id, decision, queue``: each entry with its latest decision (by ``seq``), ``pending`` without one."""
    latest = decisions.groupBy("candidate_id").agg(F.max_by("decision", "seq").alias("decision"))
    return entries.select("candidate_id").join(latest, "candidate_id", "left").withColumn("queue", F.when(F.col("decision").isNull(), "pending").otherwise("resolved"))
