"""The registered queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as C
from ..operators import chapters as H
from ..operators import documents as D
from ..operators import events as E
from ..operators import evidence as V
from ..operators import quotes as Q
from ..sources import encodings, html
from . import books, located, records, streams, weeks

LITERALS = ("Licensed under the Apache License, Version 2.0.", "###")
#: What a week is expected to have; nothing sends refunds.
KINDS = ("click", "error", "purchase", "refund", "signup", "view")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.paragraphs(_docs(spark, sf_dir))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cleaning_registry(_paras(spark, sf_dir), LITERALS)


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    edition = F.when(F.col("toxic") == 1, "mismatch").when(F.col("quality") == 1, "confirmed").otherwise("candidate")
    return _table(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 100_000_000).otherwise(0)).alias("doc_id"), edition.alias("edition"), (F.col("quality") == 1).alias("ready"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.element_at(F.array(*map(F.lit, ("confirm", "revise", "reject", "retire"))), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("user_id", "event_id", decision.alias("decision"))


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("ratings"), F.max("l_discount").alias("top"))
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.select(F.col("l_partkey").alias("candidate_id"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("name"), F.col("l_suppkey").alias("rank"), F.col("l_suppkey").alias("source_id"), (F.col("top") >= 0.1).alias("sold_out"), "ratings")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = E.fold(_decisions(spark, sf_dir), "user_id", "event_id", "decision", E.PROFILE_STEPS)
    return states.select(F.col("user_id").alias("source_id"), F.when(F.col("user_id") % 2 == 0, "confirmed").otherwise(F.col("state")).alias("state"), F.when(F.col("user_id") % 3 == 0, "discussion").otherwise("recommendation").alias("route"), (F.col("user_id") % 5 == 0).alias("expired"), (F.col("user_id") % 7 == 0).alias("sensitive"))


def _shelf_union(s: SparkSession, d: str) -> DataFrame:
    part = _table(s, d, "part").select(F.lit("book").alias("kind"), F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.lit(0).alias("type_rank"))
    supplier = _table(s, d, "supplier").select(F.lit("album").alias("kind"), F.col("s_suppkey").alias("item"), F.col("s_name").alias("title"), F.lit(1).alias("type_rank"))
    nation = _table(s, d, "nation").select(F.lit("mp").alias("kind"), F.col("n_nationkey").cast("bigint").alias("item"), F.col("n_name").alias("title"), F.lit(2).alias("type_rank"))
    return part.unionByName(supplier).unionByName(nation).select("kind", F.concat_ws(":", "kind", F.col("item").cast("string")).alias("provider_identity"), "title", "type_rank")


def _coverage(s: SparkSession, d: str) -> DataFrame:
    labels = _table(s, d, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("done"))
    by_source = _docs(s, d).select("doc_id", "source").join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("done").alias("completed"))
    return by_source.select("source", "total", "completed", X.coverage(F.col("completed"), F.col("total")).alias("coverage"))


def _set_checks(s: SparkSession, d: str) -> DataFrame:
    docs, labels = _docs(s, d).select("doc_id"), _table(s, d, "labels")
    good, bad = labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    return count(labels.select("doc_id").join(docs, "doc_id", "left_anti"), "unknown").unionByName(count(good.intersect(bad), "both")).unionByName(count(docs.exceptAll(labels.select("doc_id")), "unlabelled"))


def _quotes(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "benchmark").select("item_id", "text")


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """The documents that count as at hand."""
    return _table(s, d, "labels").select("doc_id")


def _titles(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    first = F.substring_index("text", "\n", 1)
    rows = _docs(s, d).select("doc_id", first.alias("title"))
    return rows.select(F.col("doc_id").alias("remote_id"), "title"), rows.join(_labelled(s, d), "doc_id", "left_semi").select(F.col("doc_id").alias("local_id"), "title")


def _narrowed_by_order(s: SparkSession, d: str) -> DataFrame:
    """Every document has a note, all of its paragraphs as candidates, and the second paragraph as anchor."""
    paras = _paras(s, d).select(F.col("doc_id").alias("note_id"), "doc_id", "chapter", "paragraph_index", "locator")
    notes = _table(s, d, "documents").select(F.col("doc_id").alias("note_id"), (F.col("n_chars") % 3).alias("note_start"), F.lit(1).alias("anchor_start"))
    return V.narrow_by_order(paras, notes, paras.where("chapter = 1 and paragraph_index = 2"))


def _narrowed_by_text(s: SparkSession, d: str) -> DataFrame:
    """Every chapter is a note that could stand in any of its paragraphs, beside the word ``the``."""
    chapter = F.concat_ws("-", "doc_id", "chapter").alias("note_id")
    paras = _paras(s, d)
    return V.narrow_by_associated(paras.select(chapter, "locator", "text"), paras.select(chapter, F.lit("the").alias("associated")).distinct()).select("note_id", "locator")


def _nearest_view(s: SparkSession, d: str) -> DataFrame:
    events = _table(s, d, "events").select("event_id", F.col("user_id").alias("chapter"), F.col("event_id").alias("start"), "event_type")
    return V.nearest_anchor(events.where("event_type = 'purchase'").withColumnRenamed("event_id", "note_id"), events.where("event_type = 'view'").withColumnRenamed("event_id", "anchor_id"))


def _editions(s: SparkSession, d: str) -> DataFrame:
    code = F.lpad(F.col("p_partkey").cast("string"), 13, "9")
    kind = F.split("p_type", " ")
    pairs = _table(s, d, "part").select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.array(code).alias("identifiers"), (F.col("p_size") > 25).alias("confirmed"), F.upper("p_name").alias("remote_title"), F.when(F.col("p_retailprice") < 950, "nobody").otherwise(F.concat(F.lit("by "), "p_brand")).alias("remote_author"), F.when(F.get(kind, F.lit(0)) == "STANDARD", code).when(F.get(kind, F.lit(0)) == "PROMO", "978-0").alias("remote_isbn"))
    return V.edition_mapping(pairs)


def _queue(s: SparkSession, d: str) -> DataFrame:
    orders = _table(s, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("decision"))
    return V.decision_queue(_table(s, d, "customer").select(F.col("c_custkey").alias("candidate_id")), orders)


def _search_problems(s: SparkSession, d: str) -> DataFrame:
    paras = _paras(s, d)
    return V.search_copy_problems(paras, paras.join(_labelled(s, d), "doc_id", "left_semi").select("locator", F.lower("text").alias("normalized_text")))


def _chapters_missing(s: SparkSession, d: str) -> DataFrame:
    paras = _paras(s, d)
    return V.missing_results(paras, paras.join(_labelled(s, d), "doc_id", "left_semi"), ["doc_id", "chapter"])


#: A text that is told as GB 18030 by what it says.
CHINESE = "第一章。这是中文的正文，在书和节里。" * 20


def _encodings(s: SparkSession, d: str) -> DataFrame:
    """Documents stored in turn as UTF-8, UTF-8 with a mark, UTF-16, GB 18030 (a Chinese text), with a NUL, and as no text at all."""
    kind, text = F.col("doc_id") % 6, F.col("text")
    utf8 = text.cast("binary")
    content = (
        F.when(kind == 0, utf8).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(kind == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(kind == 3, F.lit(bytearray(CHINESE.encode("gb18030"))))
        .when(kind == 4, F.concat(utf8, F.unhex(F.lit("00")))).otherwise(F.unhex(F.lit("81")))
    )
    return encodings.detect_encodings(_docs(s, d).select("doc_id", content.alias("content")), "doc_id").select("doc_id", "status", "encoding", "confidence", "reason")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "quote_status": lambda s, d: Q.quote_status(_quotes(s, d), _paras(s, d)),
    "quote_hits": lambda s, d: Q.quote_hits(_quotes(s, d), _paras(s, d)),
    "quote_fuzzy": lambda s, d: Q.quote_fuzzy(_quotes(s, d), _paras(s, d)),
    "match_partition": lambda s, d: Q.match_partition(_quotes(s, d).select("item_id"), Q.quote_status(_quotes(s, d), _paras(s, d))),
    "paragraphs": lambda s, d: _paras(s, d),
    "paragraph_hashes": lambda s, d: _paras(s, d).select("locator", X.sha256(F.col("text")).alias("text_sha256")),
    "search_text": lambda s, d: _docs(s, d).select("doc_id", X.normalize_search(F.col("text")).alias("normalized_text")),
    "chapter_rollup": lambda s, d: D.chapter_rollup(_paras(s, d)),
    "text_scan_stats": lambda s, d: D.scan_stats(_docs(s, d)),
    "duplicate_sources": lambda s, d: D.duplicate_sources(_docs(s, d)),
    "sample_positions": lambda s, d: D.sample_positions(_paras(s, d)),
    "neighbour_context": lambda s, d: D.neighbour_context(_paras(s, d)),
    "anchor_order": lambda s, d: C.neighbours_by_order(_paras(s, d)),
    "checkpoints": lambda s, d: D.checkpoints(_paras(s, d)),
    "cleaning_registry": _registry,
    "analysis_text": lambda s, d: D.analysis_text(_paras(s, d), _registry(s, d)),
    "audit_paragraphs": lambda s, d: D.audit_paragraphs(_paras(s, d)),
    "html_blocks": lambda s, d: html.html_blocks(_table(s, d, "pages")),
    "new_events_only": lambda s, d: E.new_events_only(_table(s, d, "events").select("event_id", "event_type"), _table(s, d, "labels").select(F.col("doc_id").alias("event_id"))),
    "latest_state": lambda s, d: E.latest(_table(s, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id"),
    "state_fold": lambda s, d: E.fold(_decisions(s, d), "user_id", "event_id", "decision", E.PROFILE_STEPS),
    "belief_fold": lambda s, d: E.fold(_decisions(s, d), "user_id", "event_id", "decision", E.BELIEF_STEPS),
    "weekly_report": lambda s, d: E.weekly_report(_table(s, d, "events")),
    "weekly_gaps": lambda s, d: E.weekly_gaps(E.weekly_report(_table(s, d, "events")), KINDS),
    "delta_report": lambda s, d: E.delta_report(_table(s, d, "events")),
    "reconcile_catalog": lambda s, d: C.reconcile(_docs(s, d), _local(s, d)),
    "status_distribution": lambda s, d: C.status_distribution(C.reconcile(_docs(s, d), _local(s, d))),
    "unique_title_link": lambda s, d: C.unique_link(*_titles(s, d)),
    "user_statements": lambda s, d: C.user_statements(_table(s, d, "conversations")),
    "session_flags": lambda s, d: C.session_flags(_table(s, d, "conversations")),
    "secret_scan": lambda s, d: _docs(s, d).select("doc_id", X.contains_secret(F.col("text")).alias("has_secret")),
    "context_eligibility": lambda s, d: C.eligibility(_profile(s, d), "recommendation"),
    "candidate_merge": lambda s, d: C.merge_candidates(_offers(s, d)),
    "candidate_rank": lambda s, d: C.rank_candidates(C.merge_candidates(_offers(s, d))),
    "topic_rank": lambda s, d: _docs(s, d).select("doc_id", X.topic_score("the nation", F.col("text")).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10),
    "citation_integrity": lambda s, d: C.citation_integrity(_paras(s, d).select("locator"), _paras(s, d).join(_labelled(s, d), "doc_id", "left_semi").select("locator")),
    "coverage": _coverage,
    "shelf_union": _shelf_union,
    "set_checks": _set_checks,
    "segment_chapters": lambda s, d: H.segment_chapters(_docs(s, d)),
    "sample_replacements": lambda s, d: H.sample_with_replacement(_paras(s, d), D.analysis_text(_paras(s, d), _registry(s, d))),
    "narrow_by_order": _narrowed_by_order,
    "narrow_by_associated": _narrowed_by_text,
    "nearest_anchor": _nearest_view,
    "evidence_records": lambda s, d: V.evidence_records(Q.quote_hits(_quotes(s, d), _paras(s, d)), _paras(s, d)),
    "missing_results": _chapters_missing,
    "search_copy_problems": _search_problems,
    "cleaning_summary": lambda s, d: V.cleaning_summary(_registry(s, d)),
    "match_status_counts": lambda s, d: V.status_counts(Q.quote_status(_quotes(s, d), _paras(s, d))),
    "edition_mapping": _editions,
    "decision_queue": _queue,
    "text_encodings": _encodings,
    "deterministic_ids": lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", X.short_id("candidate", F.col("conv_id"), F.col("turn"), F.col("text")).alias("candidate_id")),
}

QUERIES |= records.QUERIES | books.QUERIES | located.QUERIES | streams.QUERIES | weeks.QUERIES

# Building blocks of the SQL.
_P = r"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS raw FROM documents),
l1 AS (SELECT doc_id, line_no, trim(regexp_replace(raw, '[\t\f\x0B ]+', ' ', 'g')) AS text FROM l),
l2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS n FROM l1 WHERE text <> ''),
p AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(n // 20 + 1 AS INTEGER) AS chapter, CAST(n % 20 + 1 AS INTEGER) AS paragraph_index, text,
  sha256(CAST(doc_id AS VARCHAR)) || '#ch-' || printf('%03d', n // 20 + 1) || ':p-' || printf('%04d', n % 20 + 1) AS locator FROM l2)"""
_NORM = "regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', '', 'g')"
_HITS = f"""{_P}, pn AS (SELECT locator, {_NORM.format("text")} AS norm FROM p), q AS (SELECT item_id, {_NORM.format("text")} AS quote FROM benchmark),
h AS (SELECT item_id, locator FROM q JOIN pn ON quote <> '' AND contains(norm, quote))"""
_STATUS = f"""{_HITS}, st AS (SELECT q.item_id, CASE WHEN length(any_value(quote)) = 0 THEN 'empty' WHEN count(DISTINCT locator) = 1 AND length(any_value(quote)) >= 6 THEN 'exact' WHEN count(DISTINCT locator) > 0 THEN 'ambiguous' ELSE 'not-found' END AS status,
count(DISTINCT locator) AS candidate_count, CASE WHEN count(DISTINCT locator) = 1 THEN min(locator) END AS locator FROM q LEFT JOIN h USING (item_id) GROUP BY q.item_id)"""
_LIT = "replace(replace(text, 'Licensed under the Apache License, Version 2.0.', ''), '###', '')"
_REG = f"""{_P}, r0 AS (SELECT locator, text, trim({_LIT}) AS cleaned_text,
(length(text) - length(replace(text, 'Licensed under the Apache License, Version 2.0.', ''))) // 47 AS n1, (length(replace(text, 'Licensed under the Apache License, Version 2.0.', '')) - length({_LIT})) // 3 AS n2 FROM p),
r AS (SELECT locator, sha256(text) AS original_sha256, CAST(n1 + n2 AS INTEGER) AS occurrences, concat_ws('+', CASE WHEN n1 > 0 THEN 'rule-1' END, CASE WHEN n2 > 0 THEN 'rule-2' END) AS rules, cleaned_text,
CASE WHEN NOT regexp_matches(cleaned_text, '[<>]') AND cleaned_text <> '' AND regexp_matches(cleaned_text, '[\\p{{L}}\\p{{N}}]') THEN 'usable' ELSE 'skipped' END AS clean_status FROM r0 WHERE n1 + n2 > 0)"""


def _fold_sql(table: str) -> str:
    steps = [x.split() for x in table.split(",")]
    case = " ".join(f"WHEN state = '{s}' AND d = '{d}' THEN '{t}'" for s, d, t in steps)
    legal = " OR ".join(f"(state = '{s}' AND d = '{d}')" for s, d, _ in steps)
    return f"""e AS (SELECT user_id, ['confirm', 'revise', 'reject', 'retire'][event_id % 4 + 1] AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, 0::BIGINT AS n, 'candidate' AS state, 0 AS applied, 0 AS illegal FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.n, CASE {case} ELSE state END, applied + CASE WHEN {legal} THEN 1 ELSE 0 END, illegal + CASE WHEN {legal} THEN 0 ELSE 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1),
z AS (SELECT user_id, arg_max(state, n) AS state, max(applied) AS applied, max(illegal) AS illegal FROM f GROUP BY user_id)"""


_REC = """loc AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 100000000 ELSE 0 END AS doc_id, CASE WHEN toxic = 1 THEN 'mismatch' WHEN quality = 1 THEN 'confirmed' ELSE 'candidate' END AS edition, quality = 1 AS ready FROM labels),
b AS (SELECT coalesce(d.doc_id, loc.doc_id) AS doc_id, CASE WHEN loc.doc_id IS NULL THEN 'unlinked' WHEN d.doc_id IS NULL THEN 'local-only' WHEN edition = 'mismatch' THEN 'mismatch' WHEN edition = 'confirmed' THEN 'confirmed' ELSE 'needs-confirmation' END AS link_status, ready FROM documents d FULL JOIN loc ON d.doc_id = loc.doc_id),
rec AS (SELECT doc_id, link_status, CASE WHEN link_status = 'needs-confirmation' THEN 'confirm-edition' WHEN link_status = 'mismatch' THEN 'review-mismatch' WHEN link_status = 'unlinked' THEN 'import-source' WHEN NOT coalesce(ready, false) THEN 'analyse' WHEN link_status = 'confirmed' THEN 'discuss' ELSE 'open-local' END AS next_action FROM b)"""
_MERGE = """o AS (SELECT l_partkey AS candidate_id, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE p_name END AS name, l_suppkey AS rank, max(l_discount) >= 0.1 AS sold_out, count(*) AS ratings FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, l_suppkey, p_name),
m AS (SELECT candidate_id, arg_min(nullif(name, ''), rank) FILTER (name <> '') AS name, array_to_string(list_sort(list_distinct(list(CAST(rank AS VARCHAR)))), ',') AS sources, bool_or(sold_out) AS sold_out, CAST(sum(ratings) AS BIGINT) AS ratings FROM o GROUP BY candidate_id)"""
_WEEK = "CAST(date_trunc('week', ts + INTERVAL 8 HOUR) AS DATE)"
_SECRET = " OR ".join(f"regexp_matches(text, '{p}')" for p in (
    r"(?i)\bauthorization\s*:\s*\S+", r"(?i)\bbearer\s+[a-z0-9._~+/=-]{8,}", r"(?i)\b(api[_ -]?key|access[_ -]?token|refresh[_ -]?token|client[_ -]?secret|password|passwd|cookie|private[_ -]?key|weread_api_key)\b\s*[:=]\s*\S",
    r"(?i)-----BEGIN ((RSA|EC|OPENSSH) )?PRIVATE KEY-----", r"\bsk-[A-Za-z0-9_-]{12,}\b", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
))
_PROFILE = "candidate confirm confirmed,candidate revise revised,candidate reject rejected,confirmed revise revised,confirmed retire retired,revised revise revised,revised retire retired"
_BELIEF = "candidate confirm provisional,provisional confirm confirmed,candidate revise provisional,provisional revise revised,confirmed revise revised,revised revise revised,candidate reject rejected,provisional retire retired,confirmed retire retired,revised retire retired"

ORACLE_SQL: dict[str, str] = {
    "quote_status": f"WITH {_STATUS} SELECT * FROM st",
    "quote_hits": f"WITH {_HITS} SELECT * FROM h",
    "match_partition": f"WITH {_STATUS} SELECT item_id, CASE WHEN status = 'empty' THEN 'non-locatable' WHEN status = 'exact' THEN 'routed' ELSE 'unlocated' END AS route FROM st",
    "paragraphs": f"WITH {_P} SELECT * FROM p",
    "paragraph_hashes": f"WITH {_P} SELECT locator, sha256(text) AS text_sha256 FROM p",
    "search_text": f"SELECT doc_id, {_NORM.format('text')} AS normalized_text FROM documents",
    "chapter_rollup": f"WITH {_P} SELECT doc_id, chapter, count(*) AS paragraph_count, sha256(string_agg(text, chr(10) || chr(10) ORDER BY paragraph_index)) AS content_sha256 FROM p GROUP BY ALL",
    "text_scan_stats": "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, trim(unnest(string_split(text, chr(10)))) AS x FROM documents), s AS (SELECT doc_id, max(i) FILTER (x <> '') AS last_line, count(*) FILTER (x <> '') AS pieces, coalesce(sum(length(x)), 0) AS characters FROM l GROUP BY doc_id) SELECT doc_id, CAST(last_line AS INTEGER) AS last_line, CAST(pieces AS INTEGER) AS pieces, CAST(characters AS INTEGER) AS characters, CAST(greatest(1, ceil(characters / 2000), ceil(pieces / 20)) AS INTEGER) AS segments FROM s",
    "duplicate_sources": "SELECT sha256(text) AS sha256, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1",
    "sample_positions": f"WITH {_P}, c AS (SELECT *, paragraph_index - 1 AS i, count(*) OVER (PARTITION BY doc_id, chapter) AS n FROM p) SELECT doc_id, chapter, paragraph_index FROM c WHERE n <= 12 OR i < 4 OR i >= n - 4 OR i BETWEEN n // 2 - 1 AND n // 2 + 1",
    "neighbour_context": f'WITH {_P} SELECT a.locator, b.paragraph_index - a.paragraph_index AS "offset", b.locator AS neighbour FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.chapter = b.chapter AND b.paragraph_index <> a.paragraph_index AND abs(b.paragraph_index - a.paragraph_index) <= 3',
    "anchor_order": f'WITH {_P} SELECT locator, lag(locator) OVER w AS "before", lead(locator) OVER w AS "after" FROM p WINDOW w AS (PARTITION BY doc_id, chapter ORDER BY paragraph_index)',
    "checkpoints": f"WITH {_P}, c AS (SELECT doc_id, chapter, count(*) AS paragraph_count FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM c) SELECT doc_id, chapter, paragraph_count, round_even(k / n, 6) AS position FROM k WHERE k = 1 OR k = n // 2 + 1 OR k = n",
    "cleaning_registry": f"WITH {_REG} SELECT * FROM r",
    "analysis_text": f"WITH {_REG} SELECT p.locator, CASE WHEN clean_status = 'skipped' THEN NULL ELSE coalesce(cleaned_text, p.text) END AS analysis_text, coalesce(rules, '') AS cleaning FROM p LEFT JOIN r USING (locator)",
    "audit_paragraphs": f"""WITH {_P}, g AS (SELECT count(*) AS n FROM (SELECT doc_id, chapter FROM p GROUP BY ALL HAVING max(paragraph_index) <> count(*))),
u AS (SELECT 'locator_unique' AS "check", count(*) - count(DISTINCT locator) AS violations FROM p UNION ALL SELECT 'text_present', count(*) FILTER (trim(text) = '') FROM p UNION ALL SELECT 'locator_format', count(*) FILTER (NOT regexp_matches(locator, '^[0-9a-f]{{64}}#ch-[0-9]{{3}}:p-[0-9]{{4}}$')) FROM p UNION ALL SELECT 'index_dense', n FROM g) SELECT *, violations = 0 AS ok FROM u""",
    "new_events_only": "SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)",
    "latest_state": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "state_fold": f"WITH RECURSIVE {_fold_sql(_PROFILE)} SELECT * FROM z",
    "belief_fold": f"WITH RECURSIVE {_fold_sql(_BELIEF)} SELECT * FROM z",
    "weekly_report": f"SELECT {_WEEK} AS week, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
    "weekly_gaps": f"WITH e AS (SELECT {_WEEK} AS week, event_type FROM events), w AS (SELECT DISTINCT week FROM e), k AS (SELECT unnest({list(KINDS)}) AS missing) SELECT week, missing FROM w CROSS JOIN k WHERE (week, missing) NOT IN (SELECT (week, event_type) FROM e)",
    "delta_report": "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS fetched FROM events GROUP BY ALL), b AS (SELECT *, lag(fetched) OVER (PARTITION BY user_id ORDER BY day) AS previous FROM d) SELECT user_id, day, fetched, previous, greatest(0, fetched - coalesce(previous, 0)) AS added, fetched IS DISTINCT FROM previous AS changed FROM b",
    "reconcile_catalog": f"WITH {_REC} SELECT * FROM rec",
    "status_distribution": f"WITH {_REC} SELECT link_status, count(*) AS n, count(*) FILTER (next_action = 'discuss') AS discussable FROM rec GROUP BY ALL",
    "unique_title_link": r"WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents), f AS (SELECT DISTINCT doc_id, form FROM (SELECT doc_id, regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g') AS form FROM t UNION ALL SELECT doc_id, regexp_replace(replace(lower(regexp_extract(title, '^[^：:]*')), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g') FROM t) WHERE form <> '') SELECT a.doc_id AS remote_id, min(b.doc_id) AS local_id FROM f a JOIN f b ON a.form = b.form AND b.doc_id IN (SELECT doc_id FROM labels) GROUP BY a.doc_id HAVING min(b.doc_id) = max(b.doc_id)",
    "user_statements": r"""WITH l AS (SELECT conv_id, turn, generate_subscripts(regexp_split_to_array(text, '[\r\n]+'), 1) AS i, unnest(regexp_split_to_array(text, '[\r\n]+')) AS text FROM conversations WHERE role = 'user')
SELECT 'session:' || conv_id || '-' || turn || ':' || i AS source_id, trim(text) AS content FROM l WHERE trim(text) <> '' AND NOT regexp_matches(text, '(?i)(api[ _-]?key|access[ _-]?token|authorization|credential|secret|password|密钥|密码|令牌)') AND NOT regexp_matches(text, '(?i)(验收|体验可用|节点\s*\d|跳过.{0,6}讨论|流程.{0,8}通过|skill|同步.{0,8}成功|导入.{0,8}成功)')""",
    "session_flags": "SELECT conv_id, bool_or(role = 'system') AS has_system, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "secret_scan": f"SELECT doc_id, ({_SECRET}) AS has_secret FROM documents",
    "context_eligibility": f"WITH RECURSIVE {_fold_sql(_PROFILE)}, x AS (SELECT user_id AS source_id, CASE WHEN CASE WHEN user_id % 2 = 0 THEN 'confirmed' ELSE state END NOT IN ('confirmed', 'revised') THEN 'profile-status-not-active' WHEN user_id % 3 = 0 THEN 'profile-scope-mismatch' WHEN user_id % 5 = 0 THEN 'profile-expired' END AS exclusion_basis FROM z) SELECT source_id, exclusion_basis, exclusion_basis IS NULL AND source_id % 7 <> 0 AS selected_by_default, exclusion_basis IS NULL AND source_id % 7 = 0 AS requires_explicit_selection FROM x",
    "candidate_merge": f"WITH {_MERGE} SELECT * FROM m",
    "candidate_rank": rf"WITH {_MERGE} SELECT candidate_id, NOT sold_out AS eligible, ratings, regexp_replace(replace(lower(name), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g') AS title_key FROM m ORDER BY eligible DESC, ratings DESC, title_key NULLS FIRST, candidate_id LIMIT 50",
    "topic_rank": "WITH n AS (SELECT doc_id, " + _NORM.format("text") + " AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, 'thenation') THEN 4 ELSE 0 END + " + " + ".join(f"CAST(contains(t, '{g}') AS INTEGER)" for g in ("th", "he", "en", "na", "at", "ti", "io", "on")) + " AS score FROM n ORDER BY score DESC, doc_id LIMIT 10",
    "citation_integrity": f"WITH {_P} SELECT locator FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "coverage": "SELECT source, count(*) AS total, count(l.doc_id) AS completed, round_even(count(l.doc_id) / count(*), 6) AS coverage FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id GROUP BY source",
    "shelf_union": "SELECT 'book' AS kind, 'book:' || p_partkey AS provider_identity, p_name AS title, 0 AS type_rank FROM part UNION ALL SELECT 'album', 'album:' || s_suppkey, s_name, 1 FROM supplier UNION ALL SELECT 'mp', 'mp:' || n_nationkey, n_name, 2 FROM nation",
    "set_checks": """SELECT 'unknown' AS "check", count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'both', count(DISTINCT doc_id) FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "narrow_by_order": f"WITH {_P}, a AS (SELECT doc_id, locator FROM p WHERE chapter = 1 AND paragraph_index = 2) SELECT p.doc_id AS note_id, p.locator FROM p JOIN a USING (doc_id) JOIN documents d USING (doc_id) WHERE CASE d.n_chars % 3 WHEN 1 THEN p.locator = a.locator WHEN 0 THEN p.chapter = 1 AND paragraph_index < 2 ELSE p.chapter = 1 AND paragraph_index > 2 END",
    "narrow_by_associated": f"WITH {_P}, c AS (SELECT doc_id || '-' || chapter AS note_id, locator, contains({_NORM.format('text')}, 'the') AS has FROM p), w AS (SELECT *, bool_or(has) OVER (PARTITION BY note_id) AS has_some FROM c) SELECT note_id, locator FROM w WHERE has OR NOT has_some",
    "nearest_anchor": "WITH j AS (SELECT n.event_id AS note_id, a.event_id AS anchor_id, abs(n.event_id - a.event_id) AS distance FROM events n JOIN events a ON n.user_id = a.user_id AND n.event_type = 'purchase' AND a.event_type = 'view') SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY distance, anchor_id) = 1",
    "evidence_records": f"WITH {_HITS} SELECT locator, sha256(text) AS text_sha256, substring(text, 1, 2000) AS excerpt, length(text) > 2000 AS truncated, true AS resolved FROM p WHERE locator IN (SELECT locator FROM h)",
    "missing_results": f"WITH {_P} SELECT DISTINCT doc_id, chapter FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "search_copy_problems": f"WITH {_P} SELECT locator, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'stale' ELSE 'missing' END AS problem FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR lower(text) <> {_NORM.format('text')}",
    "cleaning_summary": f"WITH {_REG} SELECT count(*) AS affected, count(*) FILTER (clean_status = 'usable') AS usable, count(*) FILTER (clean_status = 'skipped') AS skipped, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(string_split(rules, '+')) AS x FROM r)) AS rules FROM r",
    "match_status_counts": f"WITH {_STATUS} SELECT status, count(*) AS n FROM st GROUP BY status",
    "edition_mapping": """WITH x AS (SELECT p_partkey AS pair_id, p_retailprice < 950 AS off, CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 0 END AS code, p_size > 25 AS sure FROM part)
SELECT pair_id, CASE WHEN off THEN 'mismatch' WHEN code = 1 THEN 'confirmed' WHEN code = 0 THEN 'candidate' WHEN sure THEN 'confirmed' ELSE 'candidate' END AS mapping_status, CASE WHEN off OR code = 0 THEN 'mismatch' WHEN code = 1 OR sure THEN 'confirmed' ELSE 'needs-confirmation' END AS edition_status FROM x""",
    "decision_queue": "SELECT c_custkey AS candidate_id, arg_max(o_orderstatus, o_orderkey) AS decision, CASE WHEN count(o_orderkey) = 0 THEN 'pending' ELSE 'resolved' END AS queue FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "text_encodings": """SELECT doc_id, CASE WHEN doc_id % 6 > 3 THEN 'rejected' ELSE 'detected' END AS status, ['utf-8', 'utf-8-sig', 'utf-16', 'gb18030', NULL, NULL][doc_id % 6 + 1] AS encoding, ['high', 'bom', 'bom', 'medium', NULL, NULL][doc_id % 6 + 1] AS confidence,
CASE WHEN doc_id % 6 = 5 THEN 'unsupported' WHEN doc_id % 6 = 4 AND octet_length(encode(text)) < 524288 THEN 'nul-bytes' END AS reason FROM documents""",
    "deterministic_ids": "SELECT conv_id, turn, 'candidate-' || substring(sha256(CAST(conv_id AS VARCHAR) || chr(0) || CAST(turn AS VARCHAR) || chr(0) || coalesce(text, '')), 1, 16) AS candidate_id FROM conversations",
}
ORACLE_SQL |= records.ORACLE_SQL | books.oracle(_P, _NORM, _REG) | located.oracle(_P, _NORM) | streams.oracle(_P) | weeks.ORACLE_SQL
