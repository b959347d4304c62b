"""The local books below a folder, those in error among them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import header_list, header_scalar

#: The files of a book, and the states that a text and an analysis can have.
HEADER, STATE = "book.yaml", "derived/analysis-state.json"
TEXT_STATES = ("registered", "source-missing", "source-imported", "needs-confirmation", "text-ready", "mismatch", "error")
ANALYSIS_STATES = ("not-started", "partial", "discussion-ready", "failed")


def local_books(folders: DataFrame, headers: DataFrame, states: DataFrame) -> DataFrame:
    """``book_dir, stable_id, title, authors, text_status, analysis_status, coverage, provider_id, mapping_status, edition_status, local_error``: one row per folder.

    ``folders`` has ``book_dir``, ``headers`` and ``states`` have ``book_dir, text``. A folder without a header, with an
    id or a status that cannot be, or with a broken analysis state is kept as an error and takes nothing else with it.
    """
    t = F.col("header")
    rows = folders.select("book_dir").distinct().join(headers.select("book_dir", F.col("text").alias("header")), "book_dir", "left").join(states.select("book_dir", F.col("text").alias("state")), "book_dir", "left")
    rows = rows.withColumns({"stable_id": header_scalar(t, "stable_book_id"), "status": F.coalesce(F.nullif(header_scalar(t, "status"), F.lit("")), F.lit("error")), "v": F.try_parse_json("state")})
    missing, known = t.isNull(), F.coalesce(F.rlike("stable_id", F.lit("^[0-9a-f]{64}$")), F.lit(False))
    can_be = F.col("status").isin(*TEXT_STATES)
    analysis = F.try_variant_get("v", "$.status", "string")
    sound = F.coalesce(analysis.isin(*ANALYSIS_STATES), F.lit(False))
    has_state = F.col("state").isNotNull() & ~missing
    error = F.when(missing, "header-missing").when(~can_be, "invalid-text-status").when(~known, "invalid-stable-id").when(has_state & ~sound, "invalid-analysis-state")
    name = F.element_at(F.split("book_dir", "/"), -1)
    return rows.select(
        "book_dir", "stable_id", F.coalesce(F.nullif(header_scalar(t, "title"), F.lit("")), name).alias("title"), F.when(missing, F.array().cast("array<string>")).otherwise(header_list(t, "authors")).alias("authors"),
        F.when(missing | ~known | ~can_be, "error").otherwise(F.col("status")).alias("text_status"), F.when(missing | (has_state & ~sound), "failed").when(has_state, analysis).otherwise("not-started").alias("analysis_status"),
        F.when(missing | (has_state & ~sound), F.lit(None)).when(has_state, F.try_variant_get("v", "$.chapters.coverage", "double")).otherwise(0.0).alias("coverage"), header_scalar(t, "book_id", 2).alias("provider_id"),
        F.coalesce(header_scalar(t, "mapping_status", 2), F.lit("unlinked")).alias("mapping_status"), F.coalesce(header_scalar(t, "edition_status", 2), F.lit("unknown")).alias("edition_status"), error.alias("local_error"),
    )


def scan_books(spark: SparkSession, root: str) -> DataFrame:
    """``local_books`` of the folders below ``root``, in the order of their names without case. A folder without any file does not show. Only headers and states are read; of other files the paths alone."""
    root = root.rstrip("/")
    place = re.sub(r"^\w+:(//[^/]*)?", "", root)  # Spark may write the store's name otherwise
    found = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    folder = lambda rest: F.regexp_extract("path", rf"^[^/]*(?://[^/]*)?{_quoted(place)}/([^/]+)/{rest}$", 1)
    text = F.col("content").cast("string")
    folders = found().load(root).select(folder(".*").alias("book_dir")).where("book_dir <> ''")
    headers = found().option("pathGlobFilter", HEADER).load(root).select(folder(_quoted(HEADER)).alias("book_dir"), text.alias("text")).where("book_dir <> ''")
    states = found().option("pathGlobFilter", STATE.rsplit("/", 1)[-1]).load(root).select(folder(_quoted(STATE)).alias("book_dir"), text.alias("text")).where("book_dir <> ''")
    return local_books(folders, headers, states).orderBy(F.lower("book_dir"), "book_dir")


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in text)
