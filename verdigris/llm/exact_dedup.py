"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Only built-in functions: no row leaves the JVM and no text is shuffled. The first scan makes a narrow row per
document (length and prefix hash of its normalised text). Rows of a length that no other row has are decided there;
of the others, those whose prefix no other row of their length has. The second scan takes the full hash, and only of
texts that may have survived both: bitmaps of the surviving classes, of a fixed size whatever the input, tell which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_bitmap, repeated_bitmap, spaced, text_or_empty

LENGTH, PREFIX = ["norm_chars"], ["norm_chars", "prefix_hash"]


def _measured(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), spaced(text_or_empty(text_col)).alias("norm"))
    return rows.withColumns({"norm_chars": F.length("norm"), "prefix_hash": F.xxhash64(F.substring("norm", 1, prefix_chars))})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, bitmaps: int = 256, digests: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, level, norm_chars, prefix_hash, content_sha256``.

    Texts are equal when identical after each run of ASCII white space is made one space. Null text counts as
    empty. Of equal texts the row with the smallest id stays; rows repeated with that id are all marked ``kept`` and
    all count in ``group_size`` (``deduplicated`` leaves one of them). A row without an id stays only where no equal
    text has one. An empty table gives an empty result. Columns other than the two named are never read.

    ``level`` says where a row was decided: ``length``, ``prefix`` or ``full``. ``content_sha256`` is null where no
    full hash was needed, unless ``digests`` asks the second scan for those as well. Two sets of ``bitmaps`` times
    4 KB are broadcast (2 MB by default), however large the input; when the surviving classes outgrow them, more full
    hashes are taken, and the result is the same.
    """
    narrow = cut(_measured(docs, id_col, text_col, prefix_chars).select(*PREFIX))
    lengths = repeated_bitmap(narrow, LENGTH, bitmaps)
    crowded = in_bitmap(narrow, lengths, LENGTH, "crowded", bitmaps).where("crowded").select(*PREFIX)
    prefixes = repeated_bitmap(crowded, PREFIX, bitmaps)

    rows = in_bitmap(in_bitmap(_measured(docs, id_col, text_col, prefix_chars), lengths, LENGTH, "by_length", bitmaps), prefixes, PREFIX, "by_prefix", bitmaps)
    level = F.when(~F.col("by_length"), "length").when(~F.col("by_prefix"), "prefix").otherwise("full")
    rows = rows.select("doc_id", level.alias("level"), *PREFIX, F.when(F.lit(digests) | (level == "full"), F.sha2("norm", 256)).alias("content_sha256"))
    # A class with one row can have a full hash too (its bit is shared); it then is a group of one.
    full = rows.where("level = 'full'")
    groups = full.groupBy("content_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = ["doc_id", "keep_id", "group_size", "kept", "level", *PREFIX, "content_sha256"]
    together = full.join(groups, "content_sha256").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*out)
    alone = rows.where("level <> 'full'").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}).select(*out)
    return alone.unionByName(together)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, and without repeats of a kept row.

    A row is told by its id and its text, so rows of one id (or none) with different texts are decided each for itself.
    """
    keep = exact_dedup(docs, id_col, text_col).where("kept").select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "norm_chars", "prefix_hash", "content_sha256")]).distinct()
    norm = spaced(text_or_empty(text_col))
    rows = docs.withColumns({"__chars": F.length(norm), "__prefix": F.xxhash64(F.substring(norm, 1, 64))})
    # Without a full hash no other row has the same length and prefix.
    same = F.col("__content_sha256").isNull() | (F.col("__content_sha256") == F.sha2(norm, 256))
    kept = rows.join(keep, rows[id_col].eqNullSafe(keep["__doc_id"]) & (F.col("__chars") == F.col("__norm_chars")) & (F.col("__prefix") == F.col("__prefix_hash")) & same)
    return kept.dropDuplicates(["__doc_id", "__norm_chars", "__prefix_hash", "__content_sha256"]).select(*docs.columns)


def op3_query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows: the operator's groups, with the digest of every normalised text from the same second scan."""
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("content_sha256").alias("text_sha256"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, norm FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
