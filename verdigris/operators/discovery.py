"""Book candidates of several provider feeds: one schema, merged, annotated, gated and ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Routes of a recommendation, and the most characters of a search.
ROUTES, MOST_QUERY = ("deepen", "counter", "transfer"), 80


def feed_union(feeds: dict[str, DataFrame]) -> DataFrame:
    """All feeds in one table, each row with the ``feed`` it came from and its place there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("feed", F.lit(name)) for name, df in sorted(feeds.items())])


def candidates(rows: DataFrame) -> DataFrame:
    """Provider rows (``raw`` as JSON, ``feed``, ``position``) of any of three shapes as candidates; those without id or title go.

    A row's own fields win over those nested in ``bookInfo``, or in ``book.bookInfo`` where there is no ``bookInfo``,
    also where they are null. What sells out is told by a number but zero, by true, or by a text that says so.
    """
    v = F.try_parse_json("raw")
    of = lambda path: F.try_variant_get(v, path, "map<string,variant>")
    own, one, two = of("$"), of("$.bookInfo"), of("$.book.bookInfo")
    nested = F.coalesce(one, two)

    def raw(name: str) -> Column:
        return F.when(F.coalesce(F.map_contains_key(own, name), F.lit(False)), F.try_element_at(own, F.lit(name))).otherwise(F.try_element_at(nested, F.lit(name)))

    def field(name: str) -> Column:
        return F.try_variant_get(raw(name), "$", "string")

    kind = F.schema_of_variant(raw("soldout"))
    said = field("soldout")
    sold_out = F.coalesce(F.when(kind == "STRING", X.is_truthy(said)).when(kind == "BOOLEAN", said == "true").otherwise(said.try_cast("double") != 0), F.lit(False))
    out = rows.select(F.trim(field("bookId")).alias("book_id"), F.trim(field("title")).alias("title"), F.coalesce(F.trim(field("author")), F.lit("")).alias("author"), field("category").alias("category"), X.safe_int(field("newRatingCount")).alias("rating_count"), sold_out.alias("sold_out"), "feed", "position", field("reason").alias("reason"))
    source = F.concat(F.lit("provider:"), F.substring(F.sha2(F.concat_ws("\x00", "feed", F.coalesce("reason", F.lit(""))), 256), 1, 16))
    return out.where("coalesce(book_id, '') <> '' and coalesce(title, '') <> ''").withColumn("candidate_id", F.concat(F.lit("book:"), "book_id")).withColumn("source_id", source)


def merged(rows: DataFrame) -> DataFrame:
    """One row per candidate: sources once each in the order they came, the first filled value of each field, sold out if any says so."""
    at = F.struct("feed", "position")
    first = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", at)).alias(c)
    by_source = rows.groupBy("candidate_id", "source_id").agg(F.min(at).alias("at"))
    sources = by_source.groupBy("candidate_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "source_id"))), lambda x: x["source_id"]), ",").alias("sources"))
    out = rows.groupBy("candidate_id").agg(F.min_by("book_id", at).alias("book_id"), first("title"), first("author"), first("category"), F.max("rating_count").alias("rating_count"), F.bool_or("sold_out").alias("sold_out"))
    return out.join(sources, "candidate_id").withColumn("eligible", ~F.col("sold_out"))


def annotated(found: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``candidate_id, basis, stable_id``: the shelf or local entry of a candidate, by provider id, else by title and author; of several the last on the shelf counts."""
    by_id = snapshot.where("item_id is not null").groupBy("item_id").agg(F.max_by("stable_id", "shelf_order").alias("by_id"), F.lit(True).alias("on_shelf"))
    keys = lambda df: df.withColumns({"tk": X.normalize_key(F.col("title")), "ak": X.normalize_key(F.col("author"))})
    by_name = keys(snapshot.where("title is not null")).groupBy("tk", "ak").agg(F.max_by("stable_id", "shelf_order").alias("by_name"))
    rows = keys(found).join(by_id, F.col("book_id") == F.col("item_id"), "left").join(by_name, ["tk", "ak"], "left")
    basis = F.when(F.col("on_shelf"), "provider-id").when(F.col("by_name").isNotNull(), "title-author-only")
    return rows.select("candidate_id", basis.alias("basis"), F.when(F.col("on_shelf"), F.col("by_id")).otherwise(F.col("by_name")).alias("stable_id"))


def gate(found: DataFrame, per_route: int) -> DataFrame:
    """One row: eligible candidates, how many are needed for all routes, and whether there are enough."""
    need = per_route * len(ROUTES)
    return found.agg(F.count_if("eligible").alias("eligible")).select("eligible", F.lit(need).cast("bigint").alias("needed"), (F.col("eligible") >= need).alias("enough"))


def ranked(found: DataFrame) -> DataFrame:
    """Eligible first, then rating count, title key and id."""
    return found.withColumn("title_key", X.normalize_key(F.col("title"))).orderBy(F.desc("eligible"), F.desc("rating_count"), "title_key", "candidate_id")


def query_problems(queries: DataFrame, statements: DataFrame) -> DataFrame:
    """``query_id, problem``: searches that are too long, private, about the process, or a whole approved statement of 20 characters or more."""
    said = statements.where(F.length("content") >= 20).select(X.normalize_key(F.col("content")).alias("key")).distinct().withColumn("copied", F.lit(True))
    rows = queries.withColumn("key", X.normalize_key(F.col("query"))).join(said, "key", "left")
    problem = F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "empty").when(F.length("query") > MOST_QUERY, "too-long").when(F.rlike("query", F.lit(X.SENSITIVE)) | F.rlike("query", F.lit(X.PROCESS_TALK)), "private").when(F.col("copied"), "copies-a-statement")
    return rows.select("query_id", problem.alias("problem")).where("problem is not null")


def reading_snapshot(entries: DataFrame) -> DataFrame:
    """What a recommendation may know of the library: no collections."""
    return entries.where("kind <> 'mp'").select("provider_identity", "kind", "stable_id", "link_status", "text_status", "discussion_available")


def result_problems(results: DataFrame, found: DataFrame, approved: DataFrame, sources: DataFrame, per_route: int) -> DataFrame:
    """``key, problem`` of results (``item, route, candidate_id, contexts, providers, gaps``): unknown or sold-out candidates, one used twice, contexts not approved or none, providers not the candidate's or none, gaps missing, routes without their number."""
    ok = found.where("eligible").select("candidate_id", F.lit(True).alias("ok"))
    twice = results.groupBy("candidate_id").agg(F.count("*").alias("n")).where("n > 1").select("candidate_id", F.lit(True).alias("twice"))
    rows = results.join(ok, "candidate_id", "left").join(twice, "candidate_id", "left")
    own = rows.select("item", F.explode(F.array(
        F.when(F.col("ok").isNull(), "candidate-not-eligible"), F.when(F.col("twice"), "candidate-used-twice"), F.when(~F.col("route").isin(*ROUTES), "unknown-route"),
        F.when(F.size("contexts") < 1, "no-context"), F.when(F.size("providers") < 1, "no-provider"), F.when(F.trim(F.coalesce("gaps", F.lit(""))) == "", "no-gaps"),
    )).alias("problem")).where("problem is not null").select(F.col("item").cast("string").alias("key"), "problem")
    contexts = results.select("item", F.explode("contexts").alias("source_id")).join(approved.select("source_id"), "source_id", "left_anti").select(F.col("item").cast("string").alias("key"), F.lit("context-not-approved").alias("problem"))
    provider = results.select("item", "candidate_id", F.explode("providers").alias("source_id")).join(sources.select("candidate_id", "source_id"), ["candidate_id", "source_id"], "left_anti").select(F.col("item").cast("string").alias("key"), F.lit("provider-not-of-candidate").alias("problem"))
    routes = results.sparkSession.createDataFrame([(r,) for r in ROUTES], "route string").join(results.groupBy("route").agg(F.count("*").alias("n")), "route", "left")
    numbers = routes.where(F.coalesce("n", F.lit(0)) != per_route).select(F.col("route").alias("key"), F.lit("wrong-number-of-items").alias("problem"))
    return own.unionByName(contexts).unionByName(provider).unionByName(numbers).distinct()
