"""Evidence packets: what an analysis is given, with hashes, and what its result may cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import documents as D

#: What the text of a packet may never cause.
PROHIBITED = ("execute-instructions", "change-permissions", "read-credentials", "send-messages", "modify-files", "browse-links")
#: What a claim can be, and of whom.
EVIDENCE_CLASSES = ("作者明确表达", "作者立场推断", "AI延伸应用")


def bounded(packets: DataFrame) -> DataFrame:
    """Packets that say their text is not to be trusted, and what it may not cause."""
    return packets.withColumns({"source_text_is_untrusted": F.lit(True), "prohibited_effects": F.array(*map(F.lit, PROHIBITED))})


def has_boundary(untrusted: Column, effects: Column) -> Column:
    """Whether a packet says so in full."""
    return F.coalesce(untrusted, F.lit(False)) & F.coalesce(F.size(F.array_except(F.array(*map(F.lit, PROHIBITED)), effects)) == 0, F.lit(False))


def evidence_rows(paras: DataFrame, analysed: DataFrame, wanted: DataFrame | None = None, limit: int = 2000) -> DataFrame:
    """``locator, doc_id, chapter, paragraph_index, analysis_text, truncated, source_sha256, analysis_sha256, cleaning``: usable paragraphs, of ``wanted`` (``locator``) only if given. A skipped one has no row."""
    rows = paras if wanted is None else paras.join(wanted.select("locator").distinct(), "locator", "left_semi")
    rows = rows.join(analysed.where("analysis_text is not null"), "locator")
    return rows.select("locator", "doc_id", "chapter", "paragraph_index", F.substring("analysis_text", 1, limit).alias("analysis_text"), (F.length("analysis_text") > limit).alias("truncated"), X.sha256(F.col("text")).alias("source_sha256"), X.sha256(F.col("analysis_text")).alias("analysis_sha256"), "cleaning")


def overview_packets(paras: DataFrame, analysed: DataFrame, replaced: DataFrame) -> DataFrame:
    """``doc_id, chapter, evidence, packet_sha256``: for each chapter its sample (``replaced``: ``locator, replacement``) as evidence, and a hash over the rows in order."""
    wanted = replaced.where("replacement is not null").select(F.col("replacement").alias("locator"))
    return chapter_hashes(evidence_rows(paras, analysed, wanted))


def chapter_hashes(rows: DataFrame) -> DataFrame:
    line = F.struct("paragraph_index", F.concat_ws(":", "locator", "analysis_sha256").alias("line"))
    return rows.groupBy("doc_id", "chapter").agg(F.count("*").alias("evidence"), X.sha256(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n")).alias("packet_sha256"))


def packet_set(packets: DataFrame) -> DataFrame:
    """``doc_id, packets, set_sha256``: one hash over a book's packet hashes in chapter order."""
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chapter", "packet_sha256"))), lambda x: x["packet_sha256"]), "\n")
    return packets.groupBy("doc_id").agg(F.count("*").alias("packets"), X.sha256(ordered).alias("set_sha256"))


def stale_packets(stored: DataFrame, now: DataFrame) -> DataFrame:
    """``doc_id, chapter, problem``: packets that a recomputation does not give again."""
    both = stored.select("doc_id", "chapter", F.col("packet_sha256").alias("was")).join(now.select("doc_id", "chapter", F.col("packet_sha256").alias("is")), ["doc_id", "chapter"], "full_outer")
    problem = F.when(F.col("is").isNull(), "not-reproducible").when(F.col("was").isNull(), "missing").when(F.col("was") != F.col("is"), "changed")
    return both.select("doc_id", "chapter", problem.alias("problem")).where("problem is not null")


def skipped(paras: DataFrame, analysed: DataFrame) -> DataFrame:
    """``doc_id, chapter, locator`` of paragraphs that cleaning left out of a chapter's packet."""
    return paras.select("doc_id", "chapter", "locator").join(analysed.where("analysis_text is null").select("locator"), "locator", "left_semi").select("doc_id", "chapter", "locator")


def registry_problems(stored: DataFrame, paras: DataFrame, literals: tuple[str, ...]) -> DataFrame:
    """``locator, problem``: where a stored cleaning registry is not what the paragraphs and rules give."""
    line = lambda df, name: df.select("locator", F.sha2(F.concat_ws("\x00", "original_sha256", F.col("occurrences").cast("string"), "rules", "cleaned_text", "clean_status"), 256).alias(name))
    both = line(stored, "was").join(line(D.cleaning_registry(paras, literals), "is"), "locator", "full_outer")
    problem = F.when(F.col("is").isNull(), "not-affected").when(F.col("was").isNull(), "missing").when(F.col("was") != F.col("is"), "changed")
    return both.select("locator", problem.alias("problem")).where("problem is not null")


def quality_summary(registries: DataFrame) -> DataFrame:
    """``doc_id, rules, affected, skipped`` of registries of any shape (JSON in ``registry``): rules under either name or one alone, rows under any of three, skipped by either status, by ``usable`` or listed."""
    row = "array<struct<locator:string,status:string,clean_status:string,usable:boolean>>"
    shape = f"rules array<struct<rule_id:string>>, registered_rules array<struct<rule_id:string>>, rule_id string, entries {row}, affected {row}, paragraphs {row}, skipped_evidence array<string>"
    x = registries.select("doc_id", F.from_json("registry", shape).alias("x")).select("doc_id", "x.*")
    none = lambda c, kind: F.coalesce(F.col(c), F.expr("array()").cast(kind))
    rules = F.array_union(F.transform(F.concat(none("rules", "array<struct<rule_id:string>>"), none("registered_rules", "array<struct<rule_id:string>>")), lambda r: r["rule_id"]), F.array("rule_id"))
    rows = F.concat(*[none(c, row) for c in ("entries", "affected", "paragraphs")])
    out = F.filter(rows, lambda r: (r["status"] == "skipped") | (r["clean_status"] == "skipped") | ~r["usable"])
    gone = F.array_union(F.transform(out, lambda r: r["locator"]), none("skipped_evidence", "array<string>"))
    told = lambda a: F.array_join(F.array_sort(F.array_distinct(F.filter(a, lambda v: v.isNotNull()))), ",")
    sizes = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in ("entries", "affected", "paragraphs")])
    return x.select("doc_id", told(rules).alias("rules"), F.greatest(sizes, F.lit(0)).cast("bigint").alias("affected"), told(gone).alias("skipped"))


def guide(paras: DataFrame, topic: str, limit: int = 3) -> DataFrame:
    """``locator, score``: the paragraphs nearest to a topic, in reading order where they score alike; 1 to 10."""
    if not 1 <= limit <= 10:
        raise ValueError("a guide has 1 to 10 places")
    scored = paras.select("doc_id", "chapter", "paragraph_index", "locator", X.topic_score(topic, F.col("text")).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id", "chapter", "paragraph_index").limit(limit).select("locator", "score")


def first_claims(claims: DataFrame, k: int = 2) -> DataFrame:
    """The first claims of each chapter, by their position."""
    order = Window.partitionBy("doc_id", "chapter").orderBy("position")
    return claims.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def cited(results: Column) -> Column:
    """All distinct citations of a nested result (sections of claims, and answers with book citations)."""
    return F.array_sort(F.array_distinct(F.flatten(F.concat(F.transform(results["sections"], lambda s: F.flatten(F.transform(s["claims"], lambda c: c["citations"]))), F.transform(results["answers"], lambda a: a["book_citations"])))))


def five_layers(focus: DataFrame, paras: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``locator, text, before, after, position, chapters, evidence_mode``: a paragraph, its neighbours, where its chapter is in the book, and whether all analysis is there (``artifacts``: ``doc_id, ready, overview, chapter_result``)."""
    order = Window.partitionBy("doc_id", "chapter").orderBy("paragraph_index")
    rows = paras.withColumns({"before": F.collect_list("locator").over(order.rowsBetween(-3, -1)), "after": F.collect_list("locator").over(order.rowsBetween(1, 3))})
    chapters = paras.groupBy("doc_id").agg(F.countDistinct("chapter").alias("chapters"))
    rows = rows.join(focus.select("locator"), "locator", "left_semi").join(chapters, "doc_id").join(artifacts, "doc_id", "left")
    full = F.coalesce(F.col("ready") & F.col("overview") & F.col("chapter_result"), F.lit(False))
    return rows.select("locator", "text", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"), F.bround(F.col("chapter") / F.col("chapters"), 6).alias("position"), "chapters", F.when(full, "full").otherwise("source-only").alias("evidence_mode"))


def claim_problems(claims: DataFrame, usable: DataFrame, voices: DataFrame, in_chapter: bool = False) -> DataFrame:
    """``claim_id, problem`` of claims (``claim_id, doc_id, chapter, evidence_class, voice_id, statement, citations``): no statement, an unknown class or voice, no citation, one that is not usable evidence of the book, or (``in_chapter``) of the claim's chapter."""
    known = voices.select("doc_id", "voice_id", F.lit(True).alias("known")).distinct()
    rows = claims.join(known, ["doc_id", "voice_id"], "left")
    own = rows.select("claim_id", F.explode(F.array(
        F.when(F.trim(F.coalesce("statement", F.lit(""))) == "", "no-statement"), F.when(~F.coalesce(F.col("evidence_class").isin(*EVIDENCE_CLASSES), F.lit(False)), "unknown-class"),
        F.when(F.col("known").isNull(), "unknown-voice"), F.when(F.coalesce(F.size("citations"), F.lit(0)) < 1, "no-citation"),
    )).alias("problem")).where("problem is not null")
    keys = ["doc_id", "locator", "chapter"] if in_chapter else ["doc_id", "locator"]
    named = claims.select("claim_id", "doc_id", "chapter", F.explode("citations").alias("locator"))
    outside = named.join(usable.select(*keys).distinct(), keys, "left_anti").select("claim_id", F.lit("citation-not-usable").alias("problem"))
    return own.unionByName(outside.distinct())


def progress(states: DataFrame) -> DataFrame:
    """``doc_id, status, coverage, completed, failed`` of analysis states (``doc_id, chapters, done, newly_done, failures``): finished chapters united and sorted, failures of those dropped."""
    done = F.array_sort(F.array_union("done", "newly_done"))
    rows = states.select("doc_id", "chapters", done.alias("completed"), F.map_filter("failures", lambda k, v: ~F.array_contains(F.array_union("done", "newly_done"), k)).alias("failures"))
    n = F.size("completed")
    status = F.when(n == 0, F.when(F.size(F.map_keys("failures")) > 0, "failed").otherwise("not-started")).when(n >= F.col("chapters"), "discussion-ready").otherwise("partial")
    return rows.select("doc_id", status.alias("status"), X.coverage(n, F.col("chapters")).alias("coverage"), F.array_join("completed", ",").alias("completed"), F.array_join(F.array_sort(F.map_keys("failures")), ",").alias("failed"))
