"""Queries over files, e-books, packets, claims, matches and sinks made of the driver's tables, with their SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chapters as H
from ..operators import documents as D
from ..operators import matching
from ..operators import packets as K
from ..sources import epub, files, sinks

LITERALS = ("Licensed under the Apache License, Version 2.0.", "###")
#: Pages in one e-book.
PAGES = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paras(s: SparkSession, d: str) -> DataFrame:
    return D.paragraphs(_table(s, d, "documents").select("doc_id", "text"))


def _analysed(s: SparkSession, d: str) -> DataFrame:
    return D.analysis_text(_paras(s, d), D.cleaning_registry(_paras(s, d), LITERALS))


# Files and e-books.
def _books(s: SparkSession, d: str) -> DataFrame:
    """Every five pages as an e-book: the spine names the first page twice and one that is not there; every seventh book has no spine, every eleventh no package."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, pages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    items = "".join(f'<item id="p{p["page_id"]}" href="text/p%20{p["page_id"]}.xhtml#x" media-type="application/xhtml+xml"/>' for p in pages)
                    refs = "".join(f'<itemref idref="p{p["page_id"]}"/>' for p in [*pages, pages[0]]) + '<itemref idref="gone"/>' if book % 7 else ""
                    nav = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
                    if book % 11:
                        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
                        z.writestr("OPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book {book}</dc:title><dc:creator>A{book}</dc:creator><dc:creator>B</dc:creator></metadata><manifest>{nav}{items}</manifest><spine>{refs}</spine></package>')
                    for p in pages:
                        z.writestr(f"OPS/text/p {p['page_id']}.xhtml", p["html"] or "")
                yield pa.RecordBatch.from_pydict({"path": [f"book-{book}.epub"], "content": pa.array([out.getvalue()], pa.binary())})

    pages = _table(s, d, "pages").groupBy((F.col("page_id") / PAGES).cast("bigint").alias("book")).agg(F.sort_array(F.collect_list(F.struct("page_id", "html"))).alias("pages"))
    return pages.mapInArrow(build, "path string, content binary")


def _epub_text(s: SparkSession, d: str) -> DataFrame:
    found = epub.epub_documents(_books(s, d))
    return found.select("path", "spine_index", "href", (F.size("blocks") > 0).alias("has_text"), "lossy")


def _imports(s: SparkSession, d: str) -> DataFrame:
    books = _books(s, d)
    other = _table(s, d, "nation").select(F.concat(F.lit("n-"), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, ".txt").otherwise(".pdf")).alias("path"), F.col("n_name").cast("binary").alias("content"))
    every = books.unionByName(other)
    return files.import_status(every, epub.epub_documents(books), other.select("path"))


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return files.admit_text(_table(s, d, "part").select(F.concat("p_partkey", F.when(F.col("p_size") % 3 == 0, ".TXT").otherwise(".pdf")).alias("path"), F.when(F.col("p_partkey") % 5 == 0, 0).when(F.col("p_partkey") % 7 == 0, 1 << 31).otherwise(F.col("p_size")).cast("bigint").alias("length")))


def _json_files(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 2, F.concat("props", F.lit("}"))).otherwise(F.concat(F.lit(" \n"), "props"))
    return _table(s, d, "events").select(F.col("event_id").cast("string").alias("path"), text.alias("text"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 3
    text = F.concat("props", F.lit("\n\n"), F.when(k == 0, "{bad").when(k == 1, "[1]").otherwise(F.col("props")), F.lit("\n"))
    return files.json_lines(_table(s, d, "events").select(F.col("event_id").cast("string").alias("path"), text.alias("text"))).select("path", "line_no", "problem")


def _headers(s: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit('title: "'), "p_name", F.lit('"\nauthors:\n  - "'), "p_brand", F.lit("\"\n  - other\nsource:\n  file_name: 'f"), "p_partkey", F.lit(".epub'\nlanguage: null\nempty: []\n"))
    rows = _table(s, d, "part").select("p_partkey", head.alias("text"))
    t = F.col("text")
    return rows.select("p_partkey", files.header_scalar(t, "title").alias("title"), F.array_join(files.header_list(t, "authors"), "|").alias("authors"), files.header_scalar(t, "file_name", 2).alias("file_name"), files.header_scalar(t, "language").alias("language"), files.header_scalar(t, "missing").alias("missing"), F.size(files.header_list(t, "empty")).alias("empty"))


def _manifests(s: SparkSession, d: str) -> DataFrame:
    now = files.source_manifest(_table(s, d, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content")))
    was = now.where("path not like '%1'").withColumn("sha256", F.when(F.col("path").like("%2"), "old").otherwise(F.col("sha256"))).unionByName(now.sparkSession.sql("select 'd/gone' as path, 'x' as sha256"))
    return files.changed_sources(was, now)


def _headings(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    forms = ("Chapter {}", "第{}章 开始", "卷{}", "楔子：起", "Chapter {} ends.", "introduction", "Part iv: The end", "第 {} 幕", "尾声", "only words", "a\tChapter {}")
    title = F.element_at(F.array(*[F.replace(F.lit(f), F.lit("{}"), k.cast("string")) for f in forms]), (k % len(forms) + 1).cast("int"))
    return _table(s, d, "part").select("p_partkey", title.alias("title")).select("p_partkey", X.is_heading(F.col("title")).alias("heading"))


# Packets, claims and progress.
def _evidence(s: SparkSession, d: str) -> DataFrame:
    return K.evidence_rows(_paras(s, d), _analysed(s, d))


def _overview_packets(s: SparkSession, d: str) -> DataFrame:
    return K.overview_packets(_paras(s, d), _analysed(s, d), H.sample_with_replacement(_paras(s, d), _analysed(s, d)))


def _stale(s: SparkSession, d: str) -> DataFrame:
    now = K.chapter_hashes(_evidence(s, d))
    return K.stale_packets(now.where("doc_id % 5 <> 0").withColumn("packet_sha256", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("packet_sha256"))), now.where("doc_id % 11 <> 0"))


def _registry_problems(s: SparkSession, d: str) -> DataFrame:
    stored = D.cleaning_registry(_paras(s, d), LITERALS)
    return K.registry_problems(stored.withColumn("occurrences", F.when(F.col("occurrences") > 1, 9).otherwise(F.col("occurrences"))).where("rules <> 'rule-1'"), _paras(s, d), LITERALS)


def _claims(s: SparkSession, d: str) -> DataFrame:
    p = _paras(s, d).where("paragraph_index = 1")
    k = F.col("doc_id") % 6
    return p.select(
        F.concat_ws("-", "doc_id", "chapter").alias("claim_id"), "doc_id", "chapter", F.when(k == 0, "opinion").otherwise(K.EVIDENCE_CLASSES[0]).alias("evidence_class"), F.when(k == 1, "v9").otherwise("v1").alias("voice_id"), F.when(k == 2, " ").otherwise("says").alias("statement"),
        F.when(k == 3, F.expr("cast(array() as array<string>)")).when(k == 4, F.array("locator", F.lit("nowhere"))).when(k == 5, F.array(F.regexp_replace("locator", "#ch-\\d+", "#ch-001"))).otherwise(F.array("locator")).alias("citations"),
    )


def _claim_problems(s: SparkSession, d: str, in_chapter: bool) -> DataFrame:
    voices = _table(s, d, "documents").select("doc_id", F.lit("v1").alias("voice_id"))
    return K.claim_problems(_claims(s, d), _evidence(s, d), voices, in_chapter)


def _progress(s: SparkSession, d: str) -> DataFrame:
    ch = lambda *n: F.array(*[F.lit(f"ch-{x}") for x in n])
    k = F.col("c_custkey") % 4
    done = F.when(k == 0, F.expr("cast(array() as array<string>)")).when(k == 1, ch(2)).otherwise(ch(3, 1))
    more = F.when(k == 3, ch(2, 3)).otherwise(F.expr("cast(array() as array<string>)"))
    failures = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("ch-2"), F.lit("bad"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    return K.progress(_table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(3).alias("chapters"), done.alias("done"), more.alias("newly_done"), failures.alias("failures")))


def _cited(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    claim = lambda *c: F.struct(F.array(*c).alias("citations"))
    result = F.struct(F.array(F.struct(F.array(claim(k, F.lit("a")), claim(F.lit("b"))).alias("claims"))).alias("sections"), F.array(F.struct(F.array(F.lit("b"), F.concat(F.lit("z"), k)).alias("book_citations"))).alias("answers"))
    return _table(s, d, "customer").select("c_custkey", result.alias("r")).select("c_custkey", F.array_join(K.cited(F.col("r")), ",").alias("citations"))


def _quality(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    one = F.concat(F.lit('{"rules":[{"rule_id":"r2"},{"rule_id":"r1"}],"entries":[{"locator":"a'), k, F.lit('","status":"skipped"},{"locator":"b","clean_status":"usable"}]}'))
    two = F.lit('{"rule_id":"r9","paragraphs":[{"locator":"c","usable":false}],"skipped_evidence":["d","c"]}')
    return K.quality_summary(_table(s, d, "customer").select(k.alias("doc_id"), F.when(k % 3 == 0, one).when(k % 3 == 1, two).otherwise("{}").alias("registry")))


def _boundary(s: SparkSession, d: str) -> DataFrame:
    rows = K.bounded(_table(s, d, "customer").select("c_custkey"))
    rows = rows.withColumn("prohibited_effects", F.when(F.col("c_custkey") % 4 == 0, F.slice("prohibited_effects", 1, 3)).otherwise(F.col("prohibited_effects"))).withColumn("source_text_is_untrusted", F.col("c_custkey") % 5 != 0)
    return rows.select("c_custkey", K.has_boundary(F.col("source_text_is_untrusted"), F.col("prohibited_effects")).alias("bounded"))


def _layers(s: SparkSession, d: str) -> DataFrame:
    labels = _table(s, d, "labels").select("doc_id", F.lit(True).alias("ready"), (F.col("quality") == 1).alias("overview"), (F.col("toxic") == 0).alias("chapter_result"))
    return K.five_layers(_paras(s, d).where("paragraph_index = 2").select("locator"), _paras(s, d), labels).drop("text")


def _limits(s: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    said = F.array(F.lit("已逐字读完"), F.when(k % 2 == 0, "全书100%").otherwise("全书 100%"), F.lit("不代表全书覆盖"), F.col("n_name"))
    return _table(s, d, "nation").select("n_nationkey", F.array_join(X.scope_limits(said), "|").alias("limits"), X.claims_too_much(F.struct(F.when(k % 3 == 0, said).alias("a"))).alias("claims"))


# Matches.
def _notes(s: SparkSession, d: str) -> DataFrame:
    """Quotes as they are, with other punctuation, cut short, of another edition, empty, misspelt, unknown, and with a text beside them."""
    k, text = F.col("item_id") % 8, F.col("text")
    said = F.when(k == 1, F.translate(text, ",.", ";!")).when(k == 2, F.substring(text, 1, 5)).when(k == 4, " \n").when(k == 5, F.concat(F.substring(text, 1, 30), F.lit("#"), F.substring(text, 32, 10_000))).when(k == 6, F.reverse(text)).otherwise(text)
    return _table(s, d, "benchmark").select("item_id", said.alias("text"), F.when(k == 7, F.substring(text, 1, 20)).alias("associated"), F.when(k == 3, "mismatch").alias("edition"))


def _loose_hits(s: SparkSession, d: str) -> DataFrame:
    from ..operators import quotes as Q

    notes = _notes(s, d).select("item_id", X.strip_punctuation(X.normalize_search(F.col("text"))).alias("text")).where(F.length("text") >= 6)
    return Q.quote_hits(notes, _paras(s, d).select("locator", X.strip_punctuation(X.normalize_search(F.col("text"))).alias("text")))


def _cascade(s: SparkSession, d: str) -> DataFrame:
    return matching.cascade(_notes(s, d), _paras(s, d))


def _match_events(s: SparkSession, d: str) -> DataFrame:
    """Where the benchmark's passages stand, as events; every third has one already."""
    from ..operators import quotes as Q

    notes = _table(s, d, "benchmark").select("item_id", "text")
    return matching.match_events(notes, Q.quote_status(notes, _paras(s, d)), notes.where("item_id % 3 = 0").select(F.concat(F.lit("match:"), "item_id", F.lit(":1")).alias("event_id")))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    rows = _table(s, d, "events")
    notes = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("note_id"), "user_id", F.when(F.col("event_id") % 6 != 0, F.col("event_id")).alias("start"))
    anchors = rows.where("event_type = 'error'").select(F.col("event_id").alias("anchor_id"), "user_id", F.col("event_id").alias("anchor_start"))
    pairs = notes.join(anchors, "user_id").drop("user_id")
    status = F.when(F.col("anchor_id") % 3 == 0, "exact").when(F.col("anchor_id") % 3 == 1, "ambiguous").otherwise("high-confidence")
    return matching.first_resolving(pairs, pairs.select("note_id", "anchor_id", status.alias("status")))


# Sinks.
def _task_events(s: SparkSession, d: str) -> DataFrame:
    rows = _table(s, d, "orders").select(F.col("o_orderstatus").alias("event"), F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("fingerprint"))
    stored = rows.where("task % 3 = 0").select(sinks.event_key(F.col("event"), F.col("task"), F.col("fingerprint")).alias("event_id")).distinct()
    return sinks.fresh_task_events(rows, stored)


def _upserted(s: SparkSession, d: str) -> DataFrame:
    c = _table(s, d, "customer")
    return sinks.upsert(c.select("c_custkey", F.lit("old").alias("state")), c.where("c_custkey % 4 = 0").select((F.col("c_custkey") + 2).alias("c_custkey"), F.lit("new").alias("state")), ["c_custkey"])


def _versions(s: SparkSession, d: str) -> DataFrame:
    o = _table(s, d, "orders")
    stored = o.where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("digest"), F.col("o_orderkey").alias("version"))
    return sinks.next_versions(stored, _table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("F").alias("digest")))


def _cells(s: SparkSession, d: str) -> DataFrame:
    rows = _table(s, d, "nation").select(F.concat("n_name", F.lit(" |\n x")).alias("a"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("b"))
    return sinks.markdown_table(rows, ["a", "b"])


def _sections(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("# top\n## One \n- a "), "n_name", F.lit("\n- b\n\n## Two\nbody "), F.col("n_nationkey").cast("string"), F.lit("\n\n## Three\n"))
    rows = _table(s, d, "nation").select("n_nationkey", F.explode(X.markdown_sections(text)).alias("title", "items"))
    return rows.select("n_nationkey", "title", F.array_join("items", "|").alias("items"))


def _scopes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(s, d, "customer").select("c_custkey", F.array_join(X.canonical_scopes(F.array(F.lit("recommendation"), F.when(k % 2 == 0, "discussion").otherwise("other"), F.lit("recommendation"))), ",").alias("scopes"), X.is_truthy(F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "0.0").otherwise("2")).alias("loose"), X.is_one(F.when(k % 3 == 0, "true").when(k % 3 == 1, "2").otherwise("1")).alias("strict"), X.safe_int(F.when(k % 4 == 0, "x").otherwise(k.cast("string"))).alias("number"))


def _statements(s: SparkSession, d: str) -> DataFrame:
    words = ("重读第一章", "去读第三章", "第二节值得阅读", "read on", "ch-004 再读一遍")
    k = F.col("c_custkey")
    return _table(s, d, "customer").select("c_custkey", X.is_next_reading(F.element_at(F.array(*map(F.lit, words)), (k % 5 + 1).cast("int"))).alias("next"))


def _components(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "part").select("p_partkey", X.file_component(F.concat(F.lit(" a/b:*"), "p_name", F.lit("  ?x. "), F.col("p_partkey").cast("string"), F.lit(" -"))).alias("name"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "text_admission": _sizes,
    "epub_parts": lambda s, d: epub.epub_parts(_books(s, d)).select("path", "status", "reason", "kind", "position", "id", "href", "title", F.array_join("authors", "|").alias("authors")),
    "epub_reading_order": lambda s, d: epub.reading_order(epub.epub_parts(_books(s, d))),
    "epub_documents": _epub_text,
    "import_status": _imports,
    "json_objects": lambda s, d: files.json_objects(_json_files(s, d), "k bigint").select("path", "status", F.col("value.k").alias("k")),
    "json_line_problems": _lines,
    "header_fields": _headers,
    "source_changes": _manifests,
    "headings": _headings,
    "evidence_rows": _evidence,
    "chapter_packets": lambda s, d: K.chapter_hashes(_evidence(s, d)),
    "packet_sets": lambda s, d: K.packet_set(K.chapter_hashes(_evidence(s, d))),
    "overview_packets": _overview_packets,
    "stale_packets": _stale,
    "skipped_evidence": lambda s, d: K.skipped(_paras(s, d), _analysed(s, d)),
    "registry_problems": _registry_problems,
    "quality_summary": _quality,
    "packet_boundary": _boundary,
    "guide": lambda s, d: K.guide(_paras(s, d), "the nation", 10),
    "first_claims": lambda s, d: K.first_claims(_paras(s, d).select("doc_id", "chapter", F.col("paragraph_index").alias("position"), "locator")),
    "cited_locators": _cited,
    "evidence_layers": _layers,
    "overview_claim_problems": lambda s, d: _claim_problems(s, d, False),
    "chapter_claim_problems": lambda s, d: _claim_problems(s, d, True),
    "analysis_progress": _progress,
    "scope_limits": _limits,
    "quote_cascade": _cascade,
    "quote_loose_hits": _loose_hits,
    "match_events": _match_events,
    "first_resolving_anchor": _resolved,
    "fresh_task_events": _task_events,
    "upserted_rows": _upserted,
    "result_versions": _versions,
    "markdown_rows": _cells,
    "markdown_sections": _sections,
    "chapter_markdown": lambda s, d: sinks.chapter_markdown(_paras(s, d)).select("doc_id", "chapter", F.sha2("markdown", 256).alias("sha256")),
    "scopes_and_truth": _scopes,
    "next_reading": _statements,
    "file_components": _components,
    "canonical_order": lambda s, d: _table(s, d, "documents").select("source").distinct().orderBy(F.lower("source"), "source"),
}

_BOOK = "bk AS (SELECT page_id, page_id // 5 AS b, 'book-' || page_id // 5 || '.epub' AS path, row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id) - 1 AS i, count(*) OVER (PARTITION BY page_id // 5) AS n FROM pages)"


def oracle(p: str, norm: str, reg: str) -> dict[str, str]:
    """The SQL, from the building blocks for paragraphs, search normalisation and the cleaning registry."""
    ev = f"""{reg}, an AS (SELECT p.*, CASE WHEN clean_status = 'skipped' THEN NULL ELSE coalesce(cleaned_text, p.text) END AS a, coalesce(rules, '') AS cleaning FROM p LEFT JOIN r USING (locator)),
ev AS (SELECT locator, doc_id, chapter, paragraph_index, substring(a, 1, 2000) AS analysis_text, length(a) > 2000 AS truncated, sha256(text) AS source_sha256, sha256(a) AS analysis_sha256, cleaning FROM an WHERE a IS NOT NULL),
pk AS (SELECT doc_id, chapter, count(*) AS evidence, sha256(string_agg(locator || ':' || analysis_sha256, chr(10) ORDER BY paragraph_index)) AS packet_sha256 FROM ev GROUP BY ALL)"""
    claims = f"""{ev}, cl AS (SELECT doc_id || '-' || chapter AS claim_id, doc_id, chapter, doc_id % 6 AS k, locator FROM p WHERE paragraph_index = 1),
own AS (SELECT claim_id, ['unknown-class', 'unknown-voice', 'no-statement', 'no-citation'][k + 1] AS problem FROM cl WHERE k < 4)"""
    bare = "regexp_replace(" + norm.format("text") + r", '[\p{P}\p{S}]', '', 'g')"
    return {
        "text_admission": "SELECT p_partkey || CASE WHEN p_size % 3 = 0 THEN '.TXT' ELSE '.pdf' END AS path, CASE WHEN p_size % 3 <> 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN p_size % 3 <> 0 THEN 'not-a-text-file' WHEN p_partkey % 5 = 0 THEN 'empty' WHEN p_partkey % 7 = 0 THEN 'too-large' END AS reason FROM part",
        "epub_parts": f"""WITH {_BOOK}, x AS (SELECT DISTINCT b, path, n FROM bk WHERE b % 11 <> 0), y AS (SELECT path, 'item' AS kind, CAST(i + 1 AS INTEGER) AS position, 'p' || page_id AS id, 'OPS/text/p ' || page_id || '.xhtml' AS href, b FROM bk WHERE b % 11 <> 0 UNION ALL SELECT path, 'item', 0, 'nav', 'OPS/nav.xhtml', b FROM x
UNION ALL SELECT path, 'ref', CAST(i AS INTEGER), 'p' || page_id, NULL, b FROM bk WHERE b % 11 <> 0 AND b % 7 <> 0 UNION ALL SELECT path, 'ref', CAST(n AS INTEGER), 'p' || page_id, NULL, b FROM bk WHERE b % 11 <> 0 AND b % 7 <> 0 AND i = 0 UNION ALL SELECT path, 'ref', CAST(n + 1 AS INTEGER), 'gone', NULL, b FROM x WHERE b % 7 <> 0)
SELECT path, 'accepted' AS status, NULL AS reason, kind, position, id, href, 'Book ' || b AS title, 'A' || b || '|B' AS authors FROM y UNION ALL SELECT DISTINCT path, 'rejected', 'no-package', NULL, NULL, NULL, NULL, NULL, NULL FROM bk WHERE b % 11 = 0""",
        "epub_reading_order": f"WITH {_BOOK} SELECT path, CAST(i AS INTEGER) AS spine_index, 'p' || page_id AS id, 'OPS/text/p ' || page_id || '.xhtml' AS href FROM bk WHERE b % 11 <> 0",
        "json_objects": "SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 4 IN (0, 3) THEN 'object' ELSE 'invalid' END AS status, CASE WHEN event_id % 4 IN (0, 3) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
        "json_line_problems": "SELECT CAST(event_id AS VARCHAR) AS path, unnest([1, 3]) AS line_no, unnest([NULL, CASE user_id % 3 WHEN 0 THEN 'bad-json' WHEN 1 THEN 'not-an-object' END]) AS problem FROM events",
        "header_fields": "SELECT p_partkey, p_name AS title, p_brand || '|other' AS authors, 'f' || p_partkey || '.epub' AS file_name, NULL AS language, NULL AS missing, 0 AS empty FROM part",
        "source_changes": "SELECT 'd/' || doc_id AS path, CASE doc_id % 10 WHEN 1 THEN 'new' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 10 IN (1, 2) UNION ALL SELECT 'd/gone', 'missing'",
        "headings": "SELECT p_partkey, p_partkey % 11 IN (0, 1, 2, 3, 6, 7, 8) AS heading FROM part",
        "evidence_rows": f"WITH {ev} SELECT * FROM ev",
        "chapter_packets": f"WITH {ev} SELECT * FROM pk",
        "packet_sets": f"WITH {ev} SELECT doc_id, count(*) AS packets, sha256(string_agg(packet_sha256, chr(10) ORDER BY chapter)) AS set_sha256 FROM pk GROUP BY doc_id",
        "stale_packets": f"WITH {ev} SELECT doc_id, chapter, CASE WHEN doc_id % 11 = 0 THEN 'not-reproducible' WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM pk WHERE (doc_id % 11 = 0 AND doc_id % 5 <> 0) OR (doc_id % 11 <> 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0))",
        "skipped_evidence": f"WITH {ev} SELECT doc_id, chapter, locator FROM an WHERE a IS NULL",
        "registry_problems": f"WITH {reg} SELECT locator, CASE WHEN rules = 'rule-1' THEN 'missing' ELSE 'changed' END AS problem FROM r WHERE rules = 'rule-1' OR (occurrences > 1 AND occurrences <> 9)",
        "quality_summary": "SELECT c_custkey AS doc_id, ['r1,r2', 'r9', ''][c_custkey % 3 + 1] AS rules, CAST([2, 1, 0][c_custkey % 3 + 1] AS BIGINT) AS affected, ['a' || c_custkey, 'c,d', ''][c_custkey % 3 + 1] AS skipped FROM customer",
        "packet_boundary": "SELECT c_custkey, c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AS bounded FROM customer",
        "guide": f"WITH {p}, n AS (SELECT doc_id, chapter, paragraph_index, locator, {norm.format('text')} AS t FROM p) SELECT locator, CASE WHEN contains(t, 'thenation') THEN 4 ELSE 0 END + " + " + ".join(f"CAST(contains(t, '{g}') AS INTEGER)" for g in ("th", "he", "en", "na", "at", "ti", "io", "on")) + " AS score FROM n ORDER BY score DESC, doc_id, chapter, paragraph_index LIMIT 10",
        "first_claims": f"WITH {p} SELECT doc_id, chapter, paragraph_index AS position, locator FROM p WHERE paragraph_index <= 2",
        "cited_locators": "SELECT c_custkey, c_custkey || ',a,b,z' || c_custkey AS citations FROM customer",
        "evidence_layers": f"""WITH {p}, w AS (SELECT *, string_agg(locator, ',') OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, string_agg(locator, ',') OVER (o ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS f FROM p WINDOW o AS (PARTITION BY doc_id, chapter ORDER BY paragraph_index)), c AS (SELECT doc_id, count(DISTINCT chapter) AS chapters FROM p GROUP BY doc_id)
SELECT locator, coalesce(b, '') AS "before", coalesce(f, '') AS "after", round_even(chapter / chapters, 6) AS position, chapters, CASE WHEN quality = 1 AND toxic = 0 THEN 'full' ELSE 'source-only' END AS evidence_mode FROM w JOIN c USING (doc_id) LEFT JOIN labels USING (doc_id) WHERE paragraph_index = 2""",
        "overview_claim_problems": f"WITH {claims} SELECT * FROM own UNION ALL SELECT claim_id, 'citation-not-usable' FROM cl WHERE k = 4 OR (k <> 3 AND (doc_id, CASE WHEN k = 5 THEN regexp_replace(locator, '#ch-\\d+', '#ch-001') ELSE locator END) NOT IN (SELECT (doc_id, locator) FROM ev))",
        "chapter_claim_problems": f"WITH {claims} SELECT * FROM own UNION ALL SELECT claim_id, 'citation-not-usable' FROM cl WHERE k = 4 OR (k <> 3 AND (doc_id, chapter, CASE WHEN k = 5 THEN regexp_replace(locator, '#ch-\\d+', '#ch-001') ELSE locator END) NOT IN (SELECT (doc_id, chapter, locator) FROM ev))",
        "analysis_progress": """WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 4 AS k, c_custkey % 3 = 0 AS f FROM customer) SELECT doc_id, CASE k WHEN 0 THEN CASE WHEN f THEN 'failed' ELSE 'not-started' END WHEN 3 THEN 'discussion-ready' ELSE 'partial' END AS status, [0.0::DOUBLE, 0.333333::DOUBLE, 0.666667::DOUBLE, 1.0::DOUBLE][k + 1] AS coverage,
['', 'ch-2', 'ch-1,ch-3', 'ch-1,ch-2,ch-3'][k + 1] AS completed, CASE WHEN f AND k IN (0, 2) THEN 'ch-2' ELSE '' END AS failed FROM c""",
        "scope_limits": "SELECT n_nationkey, '已未逐字覆盖|不代表全书覆盖|' || n_name AS limits, n_nationkey % 3 = 0 AS claims FROM nation",
        "quote_loose_hits": f"WITH {p}, t AS (SELECT locator, {bare} AS b FROM p), qq AS (SELECT item_id, CASE item_id % 8 WHEN 1 THEN translate(text, ',.', ';!') WHEN 2 THEN substring(text, 1, 5) WHEN 4 THEN ' ' WHEN 5 THEN substring(text, 1, 30) || '#' || substring(text, 32) WHEN 6 THEN reverse(text) ELSE text END AS text FROM benchmark), q AS (SELECT item_id, {bare} AS b FROM qq) SELECT item_id, locator FROM q JOIN t ON length(q.b) >= 6 AND contains(t.b, q.b)",
        "match_events": f"WITH {p}, pn AS (SELECT locator, {norm.format('text')} AS n FROM p), q AS (SELECT item_id, {norm.format('text')} AS q FROM benchmark), st AS (SELECT item_id, count(DISTINCT locator) AS c, min(locator) AS l, any_value(length(q)) AS chars FROM q LEFT JOIN pn ON q <> '' AND contains(n, q) GROUP BY item_id) SELECT 'match:' || item_id || ':1' AS event_id, item_id AS source_event_id, CASE WHEN chars = 0 THEN 'empty' WHEN c = 1 AND chars >= 6 THEN 'exact' WHEN c > 0 THEN 'ambiguous' ELSE 'not-found' END AS status, c AS candidate_count, CASE WHEN c = 1 THEN l END AS locator FROM st WHERE item_id % 3 <> 0",
        "first_resolving_anchor": "WITH j AS (SELECT n.event_id AS note_id, a.event_id AS anchor_id, CASE WHEN n.event_id % 6 <> 0 THEN abs(n.event_id - a.event_id) ELSE 0 END AS d FROM events n JOIN events a ON n.user_id = a.user_id AND n.event_type = 'purchase' AND a.event_type = 'error' AND a.event_id % 3 <> 1) SELECT note_id, anchor_id FROM j QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY d, anchor_id) = 1",
        "fresh_task_events": "SELECT DISTINCT 'event-' || substring(sha256(o_orderstatus || chr(0) || o_custkey || chr(0) || o_orderpriority), 1, 24) AS event_id, o_orderstatus AS event, o_custkey AS task, o_orderpriority AS fingerprint FROM orders WHERE o_custkey % 3 <> 0",
        "upserted_rows": "SELECT c_custkey, 'old' AS state FROM customer WHERE c_custkey NOT IN (SELECT c_custkey + 2 FROM customer WHERE c_custkey % 4 = 0) UNION ALL SELECT c_custkey + 2, 'new' FROM customer WHERE c_custkey % 4 = 0",
        "result_versions": "WITH s AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS was, max(o_orderkey) AS last FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey) SELECT c_custkey AS key, 'F' AS digest, CASE WHEN was = 'F' THEN last ELSE coalesce(last, 0) + 1 END AS version, CASE WHEN was = 'F' THEN 'unchanged' WHEN last IS NULL THEN 'created' ELSE 'replaced' END AS outcome FROM customer LEFT JOIN s ON o_custkey = c_custkey",
        "markdown_rows": "SELECT '| ' || n_name || ' \\| x | ' || CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE '—' END || ' |' AS line FROM nation",
        "markdown_sections": "SELECT n_nationkey, unnest(['One', 'Two', 'Three']) AS title, unnest(['a ' || n_name || '|b', 'body ' || n_nationkey, '']) AS items FROM nation",
        "chapter_markdown": f"WITH {p} SELECT doc_id, chapter, sha256('# ' || chapter || chr(10) || chr(10) || string_agg('<!-- ' || locator || ' -->' || chr(10) || text, chr(10) || chr(10) ORDER BY paragraph_index)) AS sha256 FROM p GROUP BY doc_id, chapter",
        "scopes_and_truth": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'discussion,recommendation' ELSE 'recommendation' END AS scopes, c_custkey % 3 = 0 AS loose, c_custkey % 3 <> 1 AS strict, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey END AS number FROM customer",
        "next_reading": "SELECT c_custkey, c_custkey % 5 <> 3 AS next FROM customer",
        "file_components": "SELECT p_partkey, 'a-b-' || p_name || ' -x. ' || p_partkey AS name FROM part",
        "canonical_order": "SELECT DISTINCT source FROM documents",
    }
