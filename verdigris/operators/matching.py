"""The cascade that says where a highlight stands: containment, then containment without punctuation, then similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import stored
from . import quotes as Q

#: The least length that decides by itself, the scores of the tiers, and how many candidates are told.
LEAST, LOOSE, RANGED, KEPT = 6, 0.97, 0.99, 10
VERSION = "1"


def cascade(notes: DataFrame, paras: DataFrame, most_chars: int = Q.MOST_CHARS) -> DataFrame:
    """``item_id, status, tier, candidate_count, locator, score``: one row per note.

    ``notes`` has ``item_id, text`` and optionally ``chapter_title, associated, note_range, associated_range, edition``;
    ``paras`` has ``locator, doc_id, chapter, paragraph_index, text`` and optionally ``chapter_title``. Each tier sees
    only the notes that the tiers before it found nowhere. A note of another edition is not searched at all. Repeated
    ids are one note; null texts are empty.
    """
    for name in ("chapter_title", "associated", "note_range", "associated_range", "edition"):
        if name not in notes.columns:
            notes = notes.withColumn(name, F.lit(None).cast("string"))
    if "chapter_title" not in paras.columns:
        paras = paras.withColumn("chapter_title", F.lit(None).cast("string"))
    notes = notes.dropDuplicates(["item_id"]).withColumn("norm", X.normalize_search(F.coalesce("text", F.lit(""))))
    searched = notes.where("norm <> '' and coalesce(edition, '') <> 'mismatch'")
    place = paras.select("locator", "text", "doc_id", "chapter", "paragraph_index", F.col("chapter_title").alias("in_title"))

    # A row for each note at most: stored, since the tiers after it ask for it several times, each time by a scan of all paragraphs.
    exact = stored(_exact(searched, place, most_chars), "exact-notes")
    left = searched.join(exact.select("item_id"), "item_id", "left_anti")
    loose = stored(_loose(left, place, most_chars), "loose-notes")
    left = left.join(loose.select("item_id"), "item_id", "left_anti")
    fuzzy = _fuzzy(left, paras, most_chars)
    found = exact.unionByName(loose).unionByName(fuzzy)
    status = F.when(F.col("edition") == "mismatch", "edition-mismatch").otherwise(F.coalesce("status", F.lit("not-found")))
    return notes.join(found, "item_id", "left").select("item_id", status.alias("status"), "tier", F.coalesce("candidate_count", F.lit(0)).cast("bigint").alias("candidate_count"), "locator", "score")


def _preferred(hits: DataFrame, *flags: str) -> DataFrame:
    """``item_id, candidate_count, first`` and the flags: of each note's hits those with the first flag where it has any, of these those with the second, and so on.

    So all that are left have the same flags: places are counted for each combination, and the best combination is taken.
    """
    rows = hits.groupBy("item_id", *flags).agg(F.countDistinct("locator").alias("candidate_count"), F.min("locator").alias("first"))
    best = rows.groupBy("item_id").agg(F.max_by(F.struct("candidate_count", "first", *flags), F.struct(*flags)).alias("x"))
    return best.select("item_id", "x.*")


def _exact(notes: DataFrame, place: DataFrame, most_chars: int) -> DataFrame:
    """Containment, narrowed by chapter title, by the associated text, and by the order of provider ranges around a unique anchor."""
    where = ("doc_id", "chapter", "paragraph_index")
    start, at = X.range_start(F.col("note_range")), X.range_start(F.col("associated_range"))
    ranged = notes.select("item_id", F.signum(start - at).alias("side"), "associated").where("side is not null and associated is not null")
    some = not ranged.isEmpty()
    hits = Q.places(notes.select("item_id", "text", F.col("chapter_title").alias("title"), F.col("associated").alias("beside")), place, most_chars, where if some else ())
    there = F.lit(False)
    if some:
        anchors = Q.places(ranged.select("item_id", F.col("associated").alias("text")), place, most_chars, where).groupBy("item_id")
        anchors = anchors.agg(F.countDistinct("locator").alias("n"), F.min(F.struct("locator", *where)).alias("a")).where("n = 1").select("item_id", F.col("a.locator").alias("a_locator"), F.col("a.doc_id").alias("a_doc"), F.col("a.chapter").alias("a_chapter"), F.col("a.paragraph_index").alias("a_index"))
        hits = hits.join(ranged.select("item_id", "side"), "item_id", "left").join(anchors, "item_id", "left")
        same = (F.col("doc_id") == F.col("a_doc")) & (F.col("chapter") == F.col("a_chapter"))
        there = F.when(F.col("side") == 0, F.col("locator") == F.col("a_locator")).otherwise(same & (F.signum(F.col("paragraph_index") - F.col("a_index")) == F.col("side")))
    rows = _preferred(hits.withColumn("ranged", F.coalesce(there, F.lit(False))), "titled", "has", "ranged").join(notes.select("item_id", F.length("norm").alias("chars")), "item_id")
    one = F.col("candidate_count") == 1
    status = F.when(one & F.col("ranged"), "high-confidence").when(one & (F.col("chars") >= LEAST), "exact").otherwise("ambiguous")
    return rows.select("item_id", status.alias("status"), F.lit("containment").alias("tier"), "candidate_count", F.when(one, F.col("first")).alias("locator"), F.when(F.col("ranged"), RANGED).otherwise(1.0).alias("score"))


def _loose(notes: DataFrame, place: DataFrame, most_chars: int) -> DataFrame:
    """Containment without punctuation and symbols, for six characters or more."""
    bare = notes.select("item_id", X.strip_punctuation(F.col("norm")).alias("text"), F.col("chapter_title").alias("title")).where(F.length("text") >= LEAST)
    rows, one = _preferred(Q.places(bare, place, most_chars, bare=True), "titled"), F.col("candidate_count") == 1
    return rows.select("item_id", F.when(one, "high-confidence").otherwise("ambiguous").alias("status"), F.lit("punctuation-insensitive").alias("tier"), "candidate_count", F.when(one, F.col("first")).alias("locator"), F.lit(LOOSE).alias("score"))


def _fuzzy(notes: DataFrame, paras: DataFrame, most_chars: int) -> DataFrame:
    """Similar paragraphs: the first is taken if it leads clearly."""
    ranked = Q.quote_fuzzy(notes.select("item_id", "text"), paras, kept=1_000_000_000, most_chars=most_chars)
    rows = ranked.groupBy("item_id").agg(F.count("*").alias("n"), F.max("accepted").alias("won"), F.min_by("locator", "rank").alias("first"), F.max("score").alias("score"))
    return rows.select("item_id", F.when(F.col("won"), "high-confidence").otherwise("ambiguous").alias("status"), F.lit("fuzzy").alias("tier"), F.when(F.col("won"), 1).otherwise(F.col("n")).alias("candidate_count"), F.when(F.col("won"), F.col("first")).alias("locator"), "score")


def match_events(notes: DataFrame, results: DataFrame, stored: DataFrame) -> DataFrame:
    """Results as versioned match events (``match:<source>:<version>``) that are not stored yet."""
    key = F.concat(F.lit("match:"), F.col("item_id").cast("string"), F.lit(f":{VERSION}"))
    rows = notes.select("item_id").distinct().join(results, "item_id").select(key.alias("event_id"), F.col("item_id").alias("source_event_id"), "status", "candidate_count", "locator")
    return rows.join(stored.select("event_id"), "event_id", "left_anti")


def first_resolving(anchors: DataFrame, results: DataFrame) -> DataFrame:
    """``note_id, anchor_id``: of each note's anchors (``note_id, anchor_id, start, anchor_start``), nearest first, the first whose result (``note_id, anchor_id, status``) is sure."""
    near = F.abs(F.col("start") - F.col("anchor_start"))
    sure = results.where(F.col("status").isin("exact", "high-confidence")).select("note_id", "anchor_id")
    return anchors.where("anchor_start is not null").join(sure, ["note_id", "anchor_id"]).groupBy("note_id").agg(F.min_by("anchor_id", F.struct(F.coalesce(near, F.lit(0)), "anchor_id")).alias("anchor_id"))
