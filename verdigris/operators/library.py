"""A provider's shelf beside the local books: one schema, links, statuses, counts and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import stored

#: What entries without a title are called.
NO_TITLE = {"book": "未命名书籍", "album": "未命名专辑", "mp": "文章收藏"}


def shelf_entries(payloads: DataFrame) -> DataFrame:
    """One row per entry of each payload (``shelf_id, books, albums, mp``), in shelf order: books, then albums, then the collection.

    The arrays' own places give the order, so nothing is sorted. Entries without an id are kept, with no identity.
    """
    def entry(kind: str, at: Column, item: Column, title: Column, author: Column, finished: Column, top: Column, private: Column) -> Column:
        known = F.trim(F.coalesce(item, F.lit(""))) != ""
        return F.struct(
            F.lit(kind).alias("kind"), F.when(known, F.concat(F.lit(f"{kind}:"), item)).alias("provider_identity"), item.alias("item_id"), F.coalesce(F.nullif(title, F.lit("")), F.lit(NO_TITLE[kind])).alias("title"),
            F.coalesce(author, F.lit("")).alias("author"), finished.alias("finish_reading"), top.alias("is_top"), private.alias("is_private"), at.cast("int").alias("shelf_order"),
        )

    none = F.lit(None).cast("string")
    books, albums = F.coalesce("books", F.expr("array()")), F.coalesce("albums", F.expr("array()"))
    b = F.transform("books", lambda x, i: entry("book", i + 1, x["bookId"], x["title"], x["author"], X.is_one(x["finishReading"]), X.is_one(x["isTop"]), X.is_one(x["secret"])))
    a = F.transform("albums", lambda x, i: entry("album", F.coalesce(F.size("books"), F.lit(0)) + i + 1, x["albumId"], x["name"], x["authorName"], X.is_one(x["finish"]), X.is_one(x["isTop"]), X.is_one(x["secret"])))
    after = F.coalesce(F.size(books), F.lit(0)) + F.coalesce(F.size(albums), F.lit(0)) + 1
    m = F.when(F.col("mp").isNotNull(), F.array(entry("mp", after, F.lit("collection"), F.col("mp.title"), none, F.lit(False), F.lit(False), F.lit(True))))
    parts = F.filter(F.array(b, a, m), lambda x: x.isNotNull())
    return payloads.select("shelf_id", F.explode(F.flatten(parts)).alias("e")).select("shelf_id", "e.*")


def shelf_counts(entries: DataFrame) -> DataFrame:
    """Books, albums, collections (at most one) and all visible entries by shelf."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    mp = F.max((F.col("kind") == "mp").cast("int")).cast("bigint")
    return entries.groupBy("shelf_id").agg(of("book").alias("books"), of("album").alias("albums"), mp.alias("mp"), (of("book") + of("album") + mp).alias("visible_entries"))


def shelf_problems(entries: DataFrame) -> DataFrame:
    """``shelf_id, provider_identity, problem``: entries without identity, and identities that stand twice."""
    by = entries.groupBy("shelf_id", "provider_identity").agg(F.count("*").alias("n"))
    problem = F.when(F.col("provider_identity").isNull(), "missing-identity").when(F.col("n") > 1, "duplicate-identity")
    return by.select("shelf_id", "provider_identity", problem.alias("problem")).where("problem is not null")


def direct_links(shelf: DataFrame, local: DataFrame) -> DataFrame:
    """``item_id, stable_id, problem``: shelf books and locals with the same provider id; two locals with one id are an error and link nothing."""
    claims = local.where("provider_id is not null").groupBy("provider_id").agg(F.min("stable_id").alias("stable_id"), F.countDistinct("stable_id").alias("n"))
    joined = shelf.where("kind = 'book'").join(claims, F.col("item_id") == F.col("provider_id"))
    return joined.select("item_id", F.when(F.col("n") == 1, F.col("stable_id")).alias("stable_id"), F.when(F.col("n") > 1, "several-locals").alias("problem"))


def candidate_links(shelf: DataFrame, local: DataFrame, direct: DataFrame) -> DataFrame:
    """``item_id, stable_id, basis``: shelf books without a direct link, taken in shelf order: a book that just one free local of equal title (or base title) and a matching author fits gets it, and that local is free no more.

    A local is free until a book before has got it, by a direct link (``direct``: ``item_id, stable_id``) or by this
    rule. Locals without id or in error take no part.

    Shelf order is kept without walking the shelf. In a round all books decide that can: one with a single free local
    for which it is the first takes it; one that is the first for all its several locals gets none; and so do all books
    that fit the same locals if two of those fit no other book, for then neither of the two can ever be the only one
    left. So books of one much used title are done in one round, and rounds are as many as choices truly wait on each
    other.
    """
    free = local.where("stable_id is not null and text_status <> 'error'")
    full = X.normalize_key(F.col("title"))
    forms = free.select("stable_id", "authors", full.alias("full"), F.explode(X.title_forms(F.col("title"))).alias("key"))
    books, direct = shelf.where("kind = 'book'"), direct.where("stable_id is not null")
    taken_at = books.join(direct, "item_id").groupBy("stable_id").agg(F.min("shelf_order").alias("taken_at"))
    wanted = books.join(direct.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "shelf_order", "author", full.alias("key")).where("key <> ''")
    pairs = wanted.join(forms, "key").where(X.authors_match(F.col("author"), F.col("authors"))).join(taken_at, "stable_id", "left").where("taken_at is null or shelf_order < taken_at")
    place = F.struct("shelf_order", "item_id").alias("place")
    left = stored(pairs.groupBy("item_id", "shelf_order", "stable_id").agg(F.max(F.col("key") == F.col("full")).alias("whole")).select(place, "stable_id", "whole"), "wanted-locals")
    links = []
    while not left.isEmpty():
        by_book = left.groupBy("place").agg(F.count("*").alias("n"), F.xxhash64(F.array_join(F.sort_array(F.collect_set("stable_id")), "\0")).alias("fits"))
        told = left.join(by_book, "place")
        by_local = told.groupBy("stable_id").agg(F.min("place").alias("first"), (F.min("fits") == F.max("fits")).alias("alone"))
        told = told.join(by_local, "stable_id")
        is_first = F.col("place") == F.col("first")
        took = stored(told.where((F.col("n") == 1) & is_first).select("place", "stable_id", "whole"), "taken-locals")
        links.append(took)
        none = told.where("n > 1").groupBy("place").agg(F.min(is_first).alias("first_of_all"), F.count_if("alone").alias("own")).where("first_of_all or own > 1").select("place")
        done = none.unionByName(took.select("place"))
        left = stored(left.join(done, "place", "left_anti").join(took.select("stable_id"), "stable_id", "left_anti"), "wanted-locals")
    rows = reduce(DataFrame.unionByName, links) if links else left
    return rows.select("place.item_id", "stable_id", F.when(F.col("whole"), "exact-title-author").otherwise("base-title-author").alias("basis"))


def overview(shelf: DataFrame, local: DataFrame) -> DataFrame:
    """Every shelf entry with its local book, and every local book that no entry has: link status, text status, whether it can be discussed, next action."""
    claimed = direct_links(shelf, local)
    direct = claimed.where("stable_id is not null").select("item_id", "stable_id", F.lit("provider-id").alias("basis"))
    links = direct.unionByName(candidate_links(shelf, local, claimed)).withColumn("kind", F.lit("book"))
    books = local.select("stable_id", "edition_status", "mapping_status", "text_status", "analysis_status")
    linked = shelf.select("provider_identity", "kind", "item_id").join(links, ["kind", "item_id"], "left").join(books, "stable_id", "left")
    alone = books.join(links.select("stable_id"), "stable_id", "left_anti").select("*", F.lit("book").alias("kind"))
    rows = linked.drop("item_id").unionByName(alone, allowMissingColumns=True)
    has, on_shelf = F.col("stable_id").isNotNull(), F.col("provider_identity").isNotNull()
    mismatch = (F.col("edition_status") == "mismatch") | (F.col("mapping_status") == "mismatch")
    sure = (F.col("edition_status") == "confirmed") & (F.col("mapping_status") == "confirmed") & (F.col("basis") == "provider-id")
    link = F.when(F.col("kind") != "book", "not-applicable").when(~has, "unlinked").when(~on_shelf, "local-only").when(mismatch, "mismatch").when(F.coalesce(sure, F.lit(False)), "confirmed").otherwise("needs-confirmation")
    rows = rows.withColumn("link_status", link)
    text = F.when(F.col("kind") != "book", "not-applicable").when(~has, "source-missing").when(F.col("link_status") == "needs-confirmation", "needs-confirmation").otherwise(F.col("text_status"))
    talk = F.coalesce((F.col("link_status") == "confirmed") & (F.col("text_status") == "text-ready") & (F.col("analysis_status") == "discussion-ready"), F.lit(False))
    rows = rows.select("provider_identity", "kind", "stable_id", "basis", "link_status", text.alias("text_status"), "analysis_status", F.col("text_status").alias("local_text_status"), talk.alias("discussion_available"))
    return rows.withColumn("next_action", next_action())


def next_action() -> Column:
    """The first rule that holds decides."""
    return (
        F.when(F.col("kind") != "book", "register-only").when(F.coalesce(F.col("local_text_status") == "error", F.lit(False)), "repair-local").when(F.col("link_status") == "needs-confirmation", "confirm-edition").when(F.col("link_status") == "mismatch", "review-mismatch")
        .when(F.col("text_status") == "source-missing", "import-source").when(F.coalesce(F.col("analysis_status").isin("not-started", "partial", "failed"), F.lit(False)), "analyse").when(F.col("discussion_available"), "discuss").when(F.col("link_status") == "local-only", "await-link").otherwise("keep")
    )


def summary(entries: DataFrame) -> DataFrame:
    """One row: entries, distinct local books (all, linked, with full text, analysed), and entries that can be discussed; one pass."""
    distinct = lambda where: F.countDistinct(F.when(where, F.col("stable_id")))
    return entries.agg(
        F.count("*").alias("combined_entries"), F.countDistinct("stable_id").alias("local_books"), distinct(F.col("provider_identity").isNotNull()).alias("linked_books"),
        distinct(F.col("local_text_status") == "text-ready").alias("full_text_books"), distinct(F.col("analysis_status") == "discussion-ready").alias("analysed_books"), F.count_if("discussion_available").alias("discussable"),
    )


def audit(entries: DataFrame, local: DataFrame, shelf: DataFrame) -> DataFrame:
    """``check, violations``: identities present and unique on shelf and overview, links to existing books, one entry a book, statuses known."""
    twice = lambda df, c: df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
    checks = {
        "shelf_identity_present": shelf.where("provider_identity is null"), "shelf_identity_unique": twice(shelf, "provider_identity"), "overview_identity_unique": twice(entries, "provider_identity"),
        "local_links": entries.where("stable_id is not null").join(local.select("stable_id"), "stable_id", "left_anti"), "one_entry_a_book": twice(entries, "stable_id"), "text_status_known": entries.where("text_status is null"),
    }
    return _counted(checks)


def _counted(checks: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("ok", F.col("violations") == 0)
