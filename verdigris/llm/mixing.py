"""Mixing sources to target weights by hierarchical budgeting, by built-in functions alone.

Weights go down a tree of domains, languages and sources. At each node the budget is shared out by weight, up to
what the child's whole subtree can give; what a child cannot take goes to its siblings first, and only what all of
them together cannot take was never given to their parent. Each leaf then takes whole epochs of its documents and,
of one more epoch in seeded order, the prefix that fits the rest of its budget.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_same, text_or_empty, words

#: Weights of siblings; names not listed weigh 1. The defaults of the registered query.
WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {}}
LEAF = ("domain", "lang", "source")
#: Hex digits of the seeded order that number a leaf's buckets.
BUCKET_DIGITS = 3


def source_domain(source: str = "source", domains: int = 4) -> Column:
    """``d<n>`` from the number at the end of a source's name, ``other`` without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.cast("int") % domains).cast("string")))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    return reduce(lambda out, x: F.when(F.col(level) == x[0], F.lit(float(x[1]))).otherwise(out), sorted(weights.get(level, {}).items()), F.lit(1.0))


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given``: the child's part of ``budget`` by ``weight``, at most its ``room``; shortages go to the siblings.

    Sorted by room over weight, the children that are filled come first; the level up to which all others are
    served is the budget they leave over the weight that is left.
    """
    by_need = Window.partitionBy(*([F.col(p) for p in parent] or [F.lit(0)])).orderBy(F.col("room") / F.col("weight"), name)
    before = F.coalesce(F.sum("room").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    level = (F.col("budget") - before) / F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    siblings = Window.partitionBy(*([F.col(p) for p in parent] or [F.lit(0)]))
    out = children.withColumn("__level", level).withColumn("__full", F.col("room") / F.col("weight") <= F.col("__level"))
    served = F.max(F.when(~F.col("__full"), F.col("__level"))).over(siblings)
    return out.withColumn("given", F.when(F.col("__full"), F.col("room")).otherwise(F.floor(served * F.col("weight")))).drop("__level", "__full")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget_share: float, max_epochs: int) -> DataFrame:
    """``leaves`` has ``domain, lang, source, available``; adds ``given``."""
    leaves = leaves.withColumn("room", F.col("available") * max_epochs)
    pairs = leaves.groupBy("domain", "lang").agg(F.sum("room").alias("room"), F.sum("available").alias("available"))
    roots = pairs.groupBy("domain").agg(F.sum("room").alias("room"), F.sum("available").alias("available"))
    roots = roots.withColumns({"weight": _weight("domain", weights), "budget": F.floor(F.sum("available").over(Window.partitionBy(F.lit(0))) * budget_share)})
    roots = share_out(roots, [], "domain").select("domain", F.col("given").alias("budget"))
    pairs = join_same(pairs, roots, ["domain"]).withColumn("weight", _weight("lang", weights))
    pairs = share_out(pairs, ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    leaves = join_same(leaves, pairs, ["domain", "lang"]).withColumn("weight", _weight("source", weights))
    return share_out(leaves, ["domain", "lang"], "source").select(*LEAF, "available", "given")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None,
    weights: dict[str, dict[str, float]] | None = None, budget_share: float = 0.5, max_epochs: int = 2, seed: int = 42,
) -> DataFrame:
    """One row per input row: ``doc_id, domain, lang, source, n_tokens, copies``.

    Tokens are words. The budget is ``budget_share`` of all tokens; no document is used more than ``max_epochs``
    times. ``copies`` is how often the mix has the document: a leaf's whole epochs, and one more if it stands in
    the prefix of the last. The prefix ends before the first document that does not fit.

    Null text has no tokens and never uses up budget. Null languages and sources are leaves of their own; a null id
    is ordered as an empty one. Rows of one id are ordered by a hash of their texts, so the choice never depends on
    the order of the input; equal rows are chosen one by one. An empty table gives an empty result; other columns are
    never read.
    """
    return _chosen(docs, F.xxhash64(text_or_empty(text_col)), id_col, text_col, lang_col, source_col, domain, weights, budget_share, max_epochs, seed).drop("text_hash")


def _chosen(docs: DataFrame, text_hash: Column, id_col: str, text_col: str, lang_col: str, source_col: str, domain: Column | None, weights: dict[str, dict[str, float]] | None, budget_share: float, max_epochs: int, seed: int) -> DataFrame:
    """The rows of ``mix_sources`` with ``text_hash``, by which rows of one id are ordered and told apart."""
    weights = WEIGHTS if weights is None else weights
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash.alias("text_hash"), (source_domain(source_col) if domain is None else domain).alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.size(words(text_or_empty(text_col))).cast("long").alias("n_tokens"))
    budgets = leaf_budgets(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("available")), weights, budget_share, max_epochs)
    plan = budgets.select(*LEAF, F.when(F.col("available") > 0, F.floor(F.col("given") / F.col("available"))).otherwise(F.lit(0)).alias("epochs"), F.when(F.col("available") > 0, F.col("given") % F.col("available")).otherwise(F.lit(0)).alias("rest"))
    placed = join_same(rows, plan, LEAF)
    placed = placed.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    # Rows without an id share one key: a hash of their texts spreads them over buckets.
    placed = placed.withColumn("key", F.when(F.col("doc_id").isNull(), F.md5(F.concat_ws(":", "key", F.col("text_hash").cast("string")))).otherwise(F.col("key")))
    placed = placed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    # Where the prefix ends: sums by bucket tell the bucket; only that bucket's rows are put in order.
    sums = placed.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    so_far = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("end", F.sum("n").over(so_far)).where(F.col("end") > F.col("rest")).groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("end") - F.col("n")).alias("before"))).alias("stop"))
    cut_at = join_same(placed, ends, LEAF, "left").select("doc_id", "text_hash", *LEAF, "n_tokens", "epochs", "rest", "key", "bucket", "stop.before", F.col("stop.bucket").alias("stop"))
    clear = cut_at.where("stop is null or bucket <> stop").withColumn("more", F.when(F.col("stop").isNull() | (F.col("bucket") < F.col("stop")), 1).otherwise(0))
    order = Window.partitionBy(*LEAF, "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = cut_at.where("bucket = stop").withColumn("more", (F.col("before") + F.sum("n_tokens").over(order) <= F.col("rest")).cast("int"))
    return clear.unionByName(last).select("doc_id", "text_hash", *LEAF, "n_tokens", (F.col("epochs") + F.col("more")).cast("long").alias("copies"))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None,
    weights: dict[str, dict[str, float]] | None = None, budget_share: float = 0.5, max_epochs: int = 2, seed: int = 42,
) -> DataFrame:
    """``docs``, each row as often as the mix has it. A row is told by its id, text, language, source and domain; equal rows share their copies out."""
    mine = {"__id": F.col(id_col), "__h": F.xxhash64(text_or_empty(text_col)), "__domain": source_domain(source_col) if domain is None else domain, "__lang": F.col(lang_col), "__source": F.col(source_col)}
    found = _chosen(docs, mine["__h"], id_col, text_col, lang_col, source_col, domain, weights, budget_share, max_epochs, seed)
    found = found.toDF("__id", "__h", "__domain", "__lang", "__source", "n_tokens", "copies").groupBy(*mine).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0")
    out = join_same(docs.withColumns(mine), found, list(mine))
    out = out.withColumn("__at", F.row_number().over(Window.partitionBy(*mine).orderBy("__copies")))
    share = F.expr("__copies div __rows + if(__at <= __copies % __rows, 1, 0)")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.when(share > 0, share), F.lit(1))))
    return out.select(*docs.columns)


def op7_query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
  CASE WHEN regexp_extract(coalesce(source, ''), '(\d{1,9})$', 1) = '' THEN 'other' ELSE 'd' || (CAST(regexp_extract(source, '(\d{1,9})$', 1) AS INT) % 4) END AS domain FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS available, CAST(2 * sum(n_tokens) AS BIGINT) AS room FROM d GROUP BY ALL),
pair AS (SELECT domain, lang, CAST(sum(room) AS BIGINT) AS room FROM leaf GROUP BY ALL),
root AS (SELECT domain, CAST(sum(room) AS BIGINT) AS room, (SELECT floor(sum(available) * 0.5::DOUBLE) FROM leaf) AS budget,
  CASE domain WHEN 'd0' THEN 4.0::DOUBLE WHEN 'd1' THEN 3.0::DOUBLE WHEN 'd2' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM pair GROUP BY ALL),
root1 AS (SELECT *, (budget - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM root WINDOW o AS (ORDER BY room / weight, domain)),
root2 AS (SELECT domain, CASE WHEN room / weight <= level THEN room ELSE floor(max(CASE WHEN room / weight > level THEN level END) OVER () * weight) END AS budget FROM root1),
pair1 AS (SELECT pair.*, budget, CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 2.0::DOUBLE WHEN 'fr' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM pair JOIN root2 USING (domain)),
pair2 AS (SELECT *, (budget - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM pair1 WINDOW o AS (PARTITION BY domain ORDER BY room / weight, lang)),
pair3 AS (SELECT domain, lang, CASE WHEN room / weight <= level THEN room ELSE floor(max(CASE WHEN room / weight > level THEN level END) OVER (PARTITION BY domain) * weight) END AS budget FROM pair2),
leaf1 AS (SELECT leaf.*, budget, 1.0::DOUBLE AS weight FROM leaf JOIN pair3 ON leaf.domain = pair3.domain AND leaf.lang IS NOT DISTINCT FROM pair3.lang),
leaf2 AS (SELECT *, (budget - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM leaf1 WINDOW o AS (PARTITION BY domain, lang ORDER BY room / weight, source)),
leaf3 AS (SELECT domain, lang, source, available, CAST(CASE WHEN room / weight <= level THEN room ELSE floor(max(CASE WHEN room / weight > level THEN level END) OVER (PARTITION BY domain, lang) * weight) END AS BIGINT) AS given FROM leaf2),
plan AS (SELECT domain, lang, source, CASE WHEN available > 0 THEN given // available ELSE 0 END AS epochs, CASE WHEN available > 0 THEN given % available ELSE 0 END AS rest FROM leaf3),
placed AS (SELECT d.*, epochs, rest, md5('42:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM d JOIN plan ON d.domain = plan.domain AND d.lang IS NOT DISTINCT FROM plan.lang AND d.source IS NOT DISTINCT FROM plan.source),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM summed
"""
