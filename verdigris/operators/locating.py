"""Where the notes of many books stand, each in its own book: all tiers, and each highlight's anchors in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import stored
from .grams import book_hits
from .matching import KEPT, LEAST, LOOSE, RANGED
from .quotes import similar_windows

#: What a note can be, and the least length for a similar place and the scores that admit one, make it sure, and set it apart.
HIGHLIGHT, REVIEW = "highlight", "review"
SIMILAR_LEAST, ADMIT, ACCEPT, LEAD = 12, 0.88, 0.94, 0.05
#: Notes of one chapter beyond so many are dealt to several tasks, to each with all anchors of the chapter; paragraphs and quotes of a book likewise.
NOTES_AT_ONCE, PARAS_AT_ONCE, QUOTES_AT_ONCE = 5000, 2000, 500
PLACE = "struct<chapter:int,index:int,locator:string>"


def _dealt(rows: DataFrame, keys: list[str], by: str, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a number of the part of its group that a row is dealt to, and how many parts large groups have."""
    parts = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*keys, F.ceil(F.col("__n") / most).cast("int").alias(f"__{name}s"))
    out = rows.join(parts, keys, "left").withColumn(name, F.pmod(F.xxhash64(by), F.coalesce(f"__{name}s", F.lit(1))).cast("int")).drop(f"__{name}s")
    return out, parts


def _to_all(rows: DataFrame, parts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Each row once for every part of its group."""
    every = F.sequence(F.lit(0), F.coalesce(f"__{name}s", F.lit(1)) - 1)
    return rows.join(parts, keys, "left").withColumn(name, F.explode(every)).drop(f"__{name}s")


def _by_title(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """``target, title, places``: the places of a target, only those in chapters of that title where there are any."""
    place = F.struct(F.col("chapter").cast("int").alias("chapter"), F.col("paragraph_index").cast("int").alias("index"), "locator")
    fits = (F.col("title") != "") & F.contains("in_title", "title")
    both = wanted.join(hits, "target").groupBy("target", "title").agg(F.sort_array(F.collect_list(place)).alias("all"), F.sort_array(F.collect_list(F.when(fits, place))).alias("fit"))
    return both.select("target", "title", F.when(F.size("fit") > 0, F.col("fit")).otherwise(F.col("all")).alias("places"))


def locate_notes(notes: DataFrame, paras: DataFrame) -> DataFrame:
    """``note_id, status, tier, candidate_count, locator, score, anchor_id``: one row per note.

    ``notes`` has ``note_id, book_id, kind, position, quote, chapter_uid, chapter_title, note_range`` and optionally
    ``edition``; ``paras`` has ``book_id, chapter, chapter_title, paragraph_index, locator, text``. A note is searched in
    its own book alone: as it is, without punctuation, then by similarity; a tier sees what those before it found
    nowhere. Reviews of a highlight's chapter that have a range are its anchors, nearest first (in their own order if
    the highlight has no range): the first with which the highlight's place is sure decides, else it is tried without.
    A note without text is not found, one of another edition is not searched. Note ids are unique, and an
    edition is that of a book.
    """
    edition = F.coalesce(F.col("edition"), F.lit("")) if "edition" in notes.columns else F.lit("")
    n = notes.select(
        "note_id", F.col("book_id"), F.xxhash64("book_id").alias("seed"), "kind", "position", F.coalesce(F.col("chapter_uid").cast("string"), F.lit("\0")).alias("uid"), X.range_start(F.col("note_range")).alias("start"),
        X.normalize_search(F.coalesce("quote", F.lit(""))).alias("norm"), X.normalize_search(F.coalesce("chapter_title", F.lit(""))).alias("title"), (F.coalesce("quote", F.lit("")) != "").alias("said"), edition.alias("edition"),
    )
    n = stored(n.withColumn("target", F.sha2(F.concat_ws("\0", F.col("book_id").cast("string"), "norm"), 256)), "notes")
    open_ = n.where("said and norm <> '' and edition <> 'mismatch'")
    targets = stored(open_.groupBy("target").agg(F.first("seed").alias("seed"), F.first("norm").alias("norm")), "targets")
    own = paras.select(F.xxhash64("book_id").alias("seed"), "chapter", "paragraph_index", "locator", X.normalize_search(F.coalesce("chapter_title", F.lit(""))).alias("in_title"), X.normalize_search(F.coalesce("text", F.lit(""))).alias("norm"))
    p = stored(own.join(targets.select("seed").distinct(), "seed", "left_semi"), "paragraphs")
    where = p.select("locator", "chapter", "paragraph_index", "in_title")
    wanted = open_.select("target", "title").distinct()

    hits = stored(book_hits(targets, p).join(where, "locator"), "hits")
    exact = _by_title(hits, wanted)
    left = targets.join(hits.select("target").distinct(), "target", "left_anti").withColumn("norm", X.strip_punctuation(F.col("norm")))
    loose_hits = stored(book_hits(left.where(F.length("norm") >= LEAST), p.withColumn("norm", X.strip_punctuation(F.col("norm")))).join(where, "locator"), "loose-hits")
    one = F.size("places") == 1
    loose = _by_title(loose_hits, wanted).select("target", "title", F.struct(F.when(one, "high-confidence").otherwise("ambiguous").alias("status"), F.lit("punctuation-insensitive").alias("tier"), F.size("places").cast("bigint").alias("n"), F.when(one, F.get("places", F.lit(0))["locator"]).alias("locator"), F.lit(LOOSE).alias("score")).alias("loose"))
    rest = targets.join(left.select("target"), "target", "left_semi").join(loose_hits.select("target").distinct(), "target", "left_anti")
    fuzzy = _similar(rest.where(F.length("norm") >= SIMILAR_LEAST), p)

    known = open_.join(exact, ["target", "title"], "left").join(loose, ["target", "title"], "left").join(fuzzy, "target", "left")
    known = known.select("note_id", "seed", "uid", "kind", "start", F.length("norm").alias("chars"), F.coalesce("places", F.array().cast(f"array<{PLACE}>")).alias("places"), F.coalesce("loose", "fuzzy").alias("other"))
    known = stored(known, "known-notes")
    reviews = open_.where((F.col("kind") == REVIEW) & F.col("start").isNotNull()).select("seed", "uid", F.col("note_id").alias("anchor_id"), "position", "start", "target")
    # A review that nothing is left of after normalising is an anchor as well: the first in order, it decides by itself.
    blank = n.where((F.col("kind") == REVIEW) & F.col("said") & (F.col("norm") == "") & F.col("start").isNotNull()).select("seed", "uid", F.col("note_id").alias("anchor_id"), "position", "start", F.lit(None).cast("string").alias("target"))
    every_hit = hits.groupBy("target").agg(F.collect_list(F.struct(F.col("chapter").cast("int").alias("chapter"), F.col("paragraph_index").cast("int").alias("index"), "locator")).alias("hits"))
    anchors = reviews.unionByName(blank).join(every_hit, "target", "left").drop("target")
    found = _anchored(known, anchors)
    status = F.when(~F.col("said"), "not-found").when(F.col("edition") == "mismatch", "edition-mismatch").otherwise(F.coalesce("status", F.lit("not-found")))
    return n.join(found, "note_id", "left").select("note_id", status.alias("status"), "tier", F.coalesce("candidate_count", F.lit(0).cast("bigint")).alias("candidate_count"), "locator", "score", "anchor_id")


def _similar(rest: DataFrame, p: DataFrame) -> DataFrame:
    """``target, fuzzy``: for targets found nowhere else, similar paragraphs of their own book. Paragraphs and quotes of a large book are dealt out, so that a task holds a bounded number of each."""
    books = p.join(rest.select("seed").distinct(), "seed", "left_semi").select("seed", "locator", "norm")
    texts, text_parts = _dealt(books, ["seed"], "locator", PARAS_AT_ONCE, "part")
    quotes, quote_parts = _dealt(rest.select("seed", "target", "norm"), ["seed"], "target", QUOTES_AT_ONCE, "block")
    texts, quotes = _to_all(texts, quote_parts, ["seed"], "block"), _to_all(quotes, text_parts, ["seed"], "part")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = similar_windows(list(zip(left.column("target").to_pylist(), left.column("norm").to_pylist(), strict=True)), right.column("norm").to_pylist(), ADMIT) if left.num_rows and right.num_rows else []
        locators = right.column("locator").to_pylist()
        return pa.table({"target": pa.array([f[0] for f in found], pa.string()), "locator": pa.array([locators[f[1]] for f in found], pa.string()), "score": pa.array([round(f[2], 4) for f in found], pa.float64())})

    keys = ["seed", "part", "block"]
    scored = quotes.groupBy(*keys).cogroup(texts.groupBy(*keys)).applyInArrow(run, "target string, locator string, score double")
    # Rounded first, as scores are told; of equal ones the earlier place is the better.
    top = scored.groupBy("target").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "locator"))), 1, 2).alias("top"))
    first, second = -F.get("top", F.lit(0))["s"], F.coalesce(-F.get("top", F.lit(1))["s"], F.lit(0.0))
    won = (first >= ACCEPT) & (first - second >= LEAD)
    return top.select("target", F.struct(F.when(won, "high-confidence").otherwise("ambiguous").alias("status"), F.lit("fuzzy").alias("tier"), F.when(won, F.lit(1).cast("bigint")).otherwise(F.col("n")).alias("n"), F.when(won, F.get("top", F.lit(0))["locator"]).alias("locator"), first.alias("score")).alias("fuzzy"))


class _Anchors:
    """A chapter's anchors: by their own order, and by nearness to a place."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=lambda a: a["position"])
        by: dict[int, list[dict]] = {}
        for a in self.rows:
            a["at"] = {h["locator"] for h in a["hits"] or ()}
            by.setdefault(a["start"], []).append(a)
        self.starts, self.by = sorted(by), by

    def nearest(self, start: int | None) -> Iterator[dict]:
        if start is None:
            yield from self.rows
            return
        from bisect import bisect_left

        high = bisect_left(self.starts, start)
        low = high - 1
        while low >= 0 or high < len(self.starts):
            below = start - self.starts[low] if low >= 0 else None
            above = self.starts[high] - start if high < len(self.starts) else None
            some = []
            if below is not None and (above is None or below <= above):
                some += self.by[self.starts[low]]
                low -= 1
            if above is not None and (below is None or above <= below):
                some += self.by[self.starts[high]]
                high += 1
            yield from sorted(some, key=lambda a: a["position"])


def _placed(note: dict, anchor: dict | None) -> tuple[str, int, str | None, float]:
    """Status, number of candidates, place and score of a note whose text stands somewhere, with an anchor or without."""
    places, ranged = note["places"], False
    if anchor and anchor["at"]:
        if len(places) > 1:
            places = [x for x in places if x["locator"] in anchor["at"]] or places
        if note["start"] is not None and len(anchor["at"]) == 1:
            (there,) = anchor["hits"]
            side = (note["start"] > anchor["start"]) - (note["start"] < anchor["start"])
            if side:
                some = [x for x in places if x["chapter"] == there["chapter"] and (x["index"] > there["index"]) - (x["index"] < there["index"]) == side]
            else:
                some = [x for x in places if x["locator"] == there["locator"]]
            places, ranged = some or places, bool(some)
    sure = len(places) == 1 and (ranged or note["chars"] >= LEAST)
    status = "ambiguous" if not sure else "high-confidence" if ranged else "exact"
    return status, len(places), places[0]["locator"] if len(places) == 1 else None, RANGED if ranged else 1.0


def _anchored(known: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each chapter's notes with its anchors; a chapter of very many notes is dealt to several tasks."""
    keys = ["seed", "uid"]
    notes, parts = _dealt(known, keys, "note_id", NOTES_AT_ONCE, "part")
    beside = _to_all(anchors, parts, keys, "part")
    note_kind, anchor_kind = known.schema["note_id"].dataType.simpleString(), anchors.schema["anchor_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        near, tried, out = _Anchors(right.to_pylist()), {}, []
        for note in left.to_pylist():
            asks = note["kind"] == HIGHLIGHT
            if not note["places"]:
                other = note["other"]
                if other:
                    first = next(near.nearest(note["start"]), None) if asks and other["status"] == "high-confidence" else None
                    out.append((note["note_id"], other["status"], other["tier"], other["n"], other["locator"], other["score"], first and first["anchor_id"]))
                continue
            key = note["start"], note["chars"] >= LEAST, asks, tuple(x["locator"] for x in note["places"])
            if key not in tried:
                found, by = None, None
                for anchor in near.nearest(note["start"]) if asks else ():
                    found = _placed(note, anchor)
                    if found[0] != "ambiguous":
                        by = anchor["anchor_id"]
                        break
                else:
                    found = _placed(note, None)
                tried[key] = found, by
            (status, n, locator, score), by = tried[key]
            out.append((note["note_id"], status, "containment", n, locator, score, by))
        kinds = [left.schema.field("note_id").type, pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64(), right.schema.field("anchor_id").type]
        names = ["note_id", "status", "tier", "candidate_count", "locator", "score", "anchor_id"]
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})

    group = [*keys, "part"]
    return notes.groupBy(*group).cogroup(beside.groupBy(*group)).applyInArrow(run, f"note_id {note_kind}, status string, tier string, candidate_count bigint, locator string, score double, anchor_id {anchor_kind}")
