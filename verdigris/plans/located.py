"""Queries that locate notes made of the documents' own paragraphs, each in its own book, and that normalise planted forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D
from ..operators import locating, matching

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _LETTERS)
_BOLD = "".join(chr((0x1D41A if c.islower() else 0x1D400) + (ord(c.lower()) - 97)) for c in _LETTERS)
_APART = {c: f"{base}{mark}" for mark, some in (("̀", "àèìòù"), ("́", "áéíóú"), ("̂", "âêîôû"), ("̃", "ãñõ"), ("̈", "äëïöü"), ("̧", "ç")) for c, base in zip(some, {"̃": "ano", "̧": "c"}.get(mark, "aeiou"), strict=True)}
_JOINED = {"ffi": "ﬃ", "fi": "ﬁ", "st": "ﬆ", "1": "①", "2": "２"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _forms(s: SparkSession, d: str) -> DataFrame:
    """Every document in another form of its letters: marks apart, full width, bold of mathematics, ligatures and circled digits."""
    text, k = F.col("text"), F.col("doc_id") % 4

    def exchanged(pairs: dict[str, str]) -> F.Column:
        out = text
        for a, b in pairs.items():
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    form = F.when(k == 0, exchanged(_APART)).when(k == 1, F.translate(text, _LETTERS, _WIDE)).when(k == 2, F.translate(text, _LETTERS, _BOLD)).otherwise(exchanged(_JOINED))
    rows = _table(s, d, "documents").select("doc_id", form.alias("form"))
    return rows.select("doc_id", F.sha2(X.normalize_search(F.col("form")), 256).alias("search_sha256"), F.sha2(X.normalize_key(F.col("form")), 256).alias("key_sha256"))


def _paras(s: SparkSession, d: str) -> DataFrame:
    paras = D.paragraphs(_table(s, d, "documents").select("doc_id", "text"))
    return paras.select(F.col("doc_id").alias("book_id"), "chapter", F.concat(F.lit("Chapter "), "chapter").alias("chapter_title"), "paragraph_index", "locator", "line_no", "text")


def _notes(s: SparkSession, d: str) -> DataFrame:
    """A note for every paragraph: reviews, whole paragraphs, short quotes, quotes with their chapter's title, with other punctuation, and turned around."""
    k, i, t = (F.col("book_id") + F.col("paragraph_index")) % 6, F.col("paragraph_index"), F.col("text")
    other = F.translate(t, ",.", ";!")
    quote = (
        F.when(k == 0, F.substring(t, 1, 40)).when(k == 2, F.substring(t, 1, 4)).when(k == 3, F.substring(t, 11, 12))
        .when((k == 4) & (F.length(X.strip_punctuation(X.normalize_search(t))) >= 6), other).when(k == 5, F.reverse(F.substring(t, 1, 11))).otherwise(t)
    )
    title = F.when(k == 3, F.concat(F.lit("chapter"), "chapter"))
    span = F.when((k != 1) | (i % 4 != 0), F.concat(i * 100 + k, F.lit(" - "), i * 100 + 50))
    edition = F.when(F.col("book_id") % 17 == 5, "mismatch")
    return _paras(s, d).select(F.col("locator").alias("note_id"), "book_id", F.when(k == 0, locating.REVIEW).otherwise(locating.HIGHLIGHT).alias("kind"), F.col("line_no").alias("position"), quote.alias("quote"), F.col("chapter").alias("chapter_uid"), title.alias("chapter_title"), span.alias("note_range"), edition.alias("edition"))


def _located(s: SparkSession, d: str) -> DataFrame:
    return locating.locate_notes(_notes(s, d), _paras(s, d).drop("line_no"))


def _match_events(s: SparkSession, d: str) -> DataFrame:
    """Every third note has its event already."""
    found = _located(s, d).withColumnRenamed("note_id", "item_id")
    stored = _paras(s, d).where("paragraph_index % 3 = 0").select(F.concat(F.lit("match:"), "locator", F.lit(f":{matching.VERSION}")).alias("event_id"))
    return matching.match_events(found.select("item_id"), found, stored)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"normalized_forms": _forms, "locate_notes": _located, "located_match_events": _match_events}


def oracle(p: str, norm: str) -> dict[str, str]:
    """The SQL, from the building blocks for paragraphs and search normalisation: every note meets every paragraph of its book, every anchor every note of its chapter."""
    bare = "regexp_replace({}, '[\\p{{P}}\\p{{S}}]', '', 'g')"
    found = f"""{p}, t AS (SELECT doc_id, chapter, paragraph_index AS i, line_no, locator, text, {norm.format("text")} AS n FROM p), tb AS (SELECT *, {bare.format("n")} AS b FROM t),
q0 AS (SELECT doc_id, chapter, i, line_no, locator AS note, (doc_id + i) % 6 AS k, text, b FROM tb),
q1 AS (SELECT *, CASE WHEN k = 0 THEN substring(text, 1, 40) WHEN k = 2 THEN substring(text, 1, 4) WHEN k = 3 THEN substring(text, 11, 12) WHEN k = 4 AND length(b) >= 6 THEN translate(text, ',.', ';!') WHEN k = 5 THEN reverse(substring(text, 1, 11)) ELSE text END AS quote,
  CASE WHEN k <> 1 OR i % 4 <> 0 THEN i * 100 + k END AS s FROM q0),
q AS (SELECT doc_id, chapter, i, line_no, note, k, s, quote <> '' AS said, {norm.format("quote")} AS n, {bare.format(norm.format("quote"))} AS b FROM q1),
h0 AS (SELECT q.note, q.k, q.chapter AS own, t.locator, t.chapter, t.i FROM q JOIN tb t ON q.doc_id = t.doc_id AND q.n <> '' AND contains(t.n, q.n) WHERE q.doc_id % 17 <> 5),
h AS (SELECT * FROM (SELECT *, k = 3 AND contains('chapter' || chapter, 'chapter' || own) AS fits, bool_or(k = 3 AND contains('chapter' || chapter, 'chapter' || own)) OVER (PARTITION BY note) AS any_fits FROM h0) WHERE fits OR NOT any_fits),
a AS (SELECT q.note, q.doc_id, q.chapter, q.line_no, q.s, count(h0.locator) AS hits, min(h0.chapter) AS at_chapter, min(h0.i) AS at_i, min(h0.locator) AS at_ FROM q LEFT JOIN h0 USING (note) WHERE q.k = 0 AND q.said AND q.doc_id % 17 <> 5 GROUP BY ALL),
c AS (SELECT q.note, q.s, length(q.n) AS chars, a.note AS anchor, abs(q.s - a.s) AS far, a.line_no, h.locator, h.chapter, h.i, x.locator IS NOT NULL AS beside, count(*) OVER w AS n_all, count(x.locator) OVER w AS n_beside, a.s AS a_s, a.hits, a.at_chapter, a.at_i, a.at_
  FROM q JOIN h USING (note) JOIN a ON q.k <> 0 AND a.doc_id = q.doc_id AND a.chapter = q.chapter LEFT JOIN h0 x ON x.note = a.note AND x.locator = h.locator WINDOW w AS (PARTITION BY q.note, a.note)),
c1 AS (SELECT *, s IS NOT NULL AND hits = 1 AND CASE WHEN s = a_s THEN locator = at_ ELSE chapter = at_chapter AND sign(i - at_i) = sign(s - a_s) END AS ranged FROM c WHERE n_all = 1 OR n_beside = 0 OR beside),
c2 AS (SELECT note, anchor, any_value(far) AS far, any_value(line_no) AS line_no, any_value(chars) AS chars, count(*) AS n, count(*) FILTER (ranged) AS r, CASE WHEN count(*) FILTER (ranged) > 0 THEN min(locator) FILTER (ranged) ELSE min(locator) END AS locator FROM c1 GROUP BY note, anchor),
c3 AS (SELECT *, CASE WHEN r = 1 THEN 'high-confidence' WHEN r = 0 AND n = 1 AND chars >= 6 THEN 'exact' END AS status FROM c2),
sure AS (SELECT note, status, locator, anchor, CASE WHEN r = 1 THEN 0.99 ELSE 1.0 END AS score FROM c3 WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY note ORDER BY coalesce(far, 0), line_no) = 1),
alone AS (SELECT note, count(*) AS n, min(locator) AS locator, any_value(length(q.n)) AS chars FROM h JOIN q USING (note) GROUP BY note),
lo0 AS (SELECT q.note, q.k, q.chapter AS own, t.locator, t.chapter FROM q JOIN tb t ON q.doc_id = t.doc_id AND q.n <> '' AND length(q.b) >= 6 AND contains(t.b, q.b) WHERE q.doc_id % 17 <> 5 AND q.note NOT IN (SELECT note FROM h0)),
lo AS (SELECT note, CASE WHEN count(*) FILTER (fits) > 0 THEN count(*) FILTER (fits) ELSE count(*) END AS n, CASE WHEN count(*) FILTER (fits) > 0 THEN min(locator) FILTER (fits) ELSE min(locator) END AS locator FROM (SELECT *, k = 3 AND contains('chapter' || chapter, 'chapter' || own) AS fits FROM lo0) GROUP BY note),
first_a AS (SELECT q.note, a.note AS anchor FROM q JOIN a ON q.k <> 0 AND a.doc_id = q.doc_id AND a.chapter = q.chapter QUALIFY row_number() OVER (PARTITION BY q.note ORDER BY coalesce(abs(q.s - a.s), 0), a.line_no) = 1),
found AS (SELECT q.note AS note_id, CASE WHEN NOT said THEN 'not-found' WHEN q.doc_id % 17 = 5 THEN 'edition-mismatch' WHEN sure.status IS NOT NULL THEN sure.status WHEN alone.n = 1 AND alone.chars >= 6 THEN 'exact' WHEN alone.n > 0 THEN 'ambiguous' WHEN lo.n = 1 THEN 'high-confidence' WHEN lo.n > 1 THEN 'ambiguous' ELSE 'not-found' END AS status,
  CASE WHEN alone.n > 0 THEN 'containment' WHEN lo.n > 0 THEN 'punctuation-insensitive' END AS tier, CASE WHEN sure.status IS NOT NULL THEN 1 ELSE coalesce(alone.n, lo.n, 0) END AS candidate_count,
  coalesce(sure.locator, CASE WHEN alone.n = 1 THEN alone.locator END, CASE WHEN lo.n = 1 THEN lo.locator END) AS locator, CASE WHEN alone.n > 0 THEN CAST(coalesce(sure.score, 1.0) AS DOUBLE) WHEN lo.n > 0 THEN 0.97::DOUBLE END AS score,
  coalesce(sure.anchor, CASE WHEN lo.n = 1 THEN first_a.anchor END) AS anchor_id
  FROM q LEFT JOIN sure ON sure.note = q.note LEFT JOIN alone ON alone.note = q.note LEFT JOIN lo ON lo.note = q.note LEFT JOIN first_a ON first_a.note = q.note)"""
    key = "regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    return {
        "normalized_forms": f"SELECT doc_id, sha256({norm.format('text')}) AS search_sha256, sha256({key.format('text')}) AS key_sha256 FROM documents",
        "locate_notes": f"WITH {found} SELECT * FROM found",
        "located_match_events": f"WITH {found} SELECT 'match:' || note_id || ':1' AS event_id, note_id AS source_event_id, status, CAST(candidate_count AS BIGINT) AS candidate_count, locator FROM found JOIN p ON p.locator IS NOT DISTINCT FROM note_id WHERE p.paragraph_index % 3 <> 0".replace("candidate_count, locator FROM", "candidate_count, found.locator FROM"),
    }
