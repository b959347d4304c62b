"""Sinks over tables: keyed appends, upserts, versions, staged publication and exports.

Spark's committer makes one write all or nothing; what these add is which rows a write has. Writers of one table must
take turns, as in any store without transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def event_key(event: Column, task: Column, fingerprint: Column) -> Column:
    """The id of a task's event: the same event of the same task and fingerprint has the same."""
    return X.short_id("event", event, task, fingerprint, digits=24)


def fresh_task_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    """``events`` (``event, task, fingerprint``, ...) with their ``event_id``, each once, without those stored already."""
    keyed = events.withColumn("event_id", event_key(F.col("event"), F.col("task"), F.col("fingerprint"))).dropDuplicates(["event_id"])
    return keyed.join(stored.select("event_id"), "event_id", "left_anti")


def fresh_in_order(incoming: DataFrame, stored: DataFrame, key: str = "event_id", position: str = "position") -> DataFrame:
    """Ids that are not stored yet with the place of each in the batch; a batch's own repeats are all new."""
    return incoming.select(key, position).join(stored.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and of ``old`` those whose key ``new`` has not."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def next_versions(stored: DataFrame, results: DataFrame) -> DataFrame:
    """``key, digest, version, outcome`` of new results (``key, digest``) beside those stored (``key, digest, version``): equal digests are ``unchanged``, others get the next number."""
    latest = stored.groupBy("key").agg(F.max_by("digest", "version").alias("was"), F.max("version").alias("last"))
    rows = results.join(latest, "key", "left")
    same = F.coalesce(F.col("digest") == F.col("was"), F.lit(False))
    return rows.select("key", "digest", F.when(same, F.col("last")).otherwise(F.coalesce("last", F.lit(0)) + 1).cast("bigint").alias("version"), F.when(same, "unchanged").when(F.col("last").isNull(), "created").otherwise("replaced").alias("outcome"))


def failure_row(key: Column, problems: Column) -> Column:
    """What a failed step may keep: a code and a message of at most 200 characters that holds no secret."""
    message = F.substring(F.array_join(problems, "; "), 1, 200)
    return F.struct(key.alias("key"), F.lit("validation-failed").alias("code"), F.when(X.contains_secret(message), "withheld").otherwise(message).alias("message"))


def publish(df: DataFrame, path: str, check: Column, staging: str) -> int:
    """Writes ``df`` to ``staging``, and only if all its rows pass ``check`` to ``path``, which must not exist. Returns the rows written; a failing row publishes nothing."""
    df.write.mode("overwrite").parquet(staging)
    staged = df.sparkSession.read.schema(df.schema).parquet(staging)
    bad = staged.where(~F.coalesce(check, F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} rows do not pass; nothing was published")
    staged.write.mode("errorifexists").parquet(path)
    return staged.count()


def refresh_view(spark: SparkSession, name: str, df: DataFrame) -> None:
    """A view under a fixed name, made anew from its events."""
    df.createOrReplaceTempView(name)


def markdown_cell(x: Column) -> Column:
    """A value inside a table cell: on one line, bars escaped, a dash for nothing."""
    flat = F.trim(F.regexp_replace(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\\s+", " "))
    return F.when(flat == "", "—").otherwise(flat)


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``line``: one table row for each row; the head is ``markdown_head``."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in columns]), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"


def search_copy(paras: DataFrame) -> DataFrame:
    """``locator, normalized_text``: the copy that is searched and never quoted."""
    return paras.select("locator", X.normalize_search(F.col("text")).alias("normalized_text"))


def chapter_markdown(paras: DataFrame) -> DataFrame:
    """``doc_id, chapter, markdown``: a chapter's paragraphs, each under its locator."""
    blocks = F.sort_array(F.collect_list(F.struct("paragraph_index", F.concat(F.lit("<!-- "), "locator", F.lit(" -->\n"), "text").alias("block"))))
    return paras.groupBy("doc_id", "chapter").agg(F.concat(F.lit("# "), F.first("chapter").cast("string"), F.lit("\n\n"), F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n")).alias("markdown"))


def write_by_week(rows: DataFrame, ts: str, path: str, minutes: int = 0) -> None:
    """``rows`` below ``path``, a folder for each ISO week of ``ts`` in a fixed offset; rows without a time go to one of their own."""
    rows.withColumn("week", X.week_of(F.col(ts), minutes)).repartition("week", F.pmod(F.xxhash64(ts), F.lit(8))).write.mode("append").partitionBy("week").parquet(path)


def read_window(spark: SparkSession, path: str, ts: str, start: str, end: str, minutes: int = 0) -> DataFrame:
    """Rows of ``write_by_week`` from ``start`` on and before ``end`` (times with a zone). Weeks that cannot have any are not opened."""
    at = [F.to_timestamp(F.lit(x)) for x in (start, end)]
    first, last = spark.range(1).select(*[X.week_of(t, minutes).alias(f"w{i}") for i, t in enumerate(at)]).first()
    return spark.read.parquet(path).where((F.col("week") >= first) & (F.col("week") <= last) & (F.col(ts) >= at[0]) & (F.col(ts) < at[1])).drop("week")


def read_weeks(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """Rows of the weeks in ``asked`` (``week``), found when the query runs: only their folders are opened. Weeks are few, some thousands in a century, so they may be broadcast."""
    # Spark looks for what to leave out only if the other side has a comparison that could leave something out.
    return spark.read.parquet(path).join(F.broadcast(asked.where("week > ''").select("week").distinct()), "week", "left_semi")
