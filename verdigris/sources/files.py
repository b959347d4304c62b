"""Files as sources: text admission, JSON objects and lines, headers of scalars and lists, whole-file digests, imports by suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: The sizes a text file may have, and how many chapters with text a book needs.
LEAST_TEXT, MOST_TEXT, LEAST_CHAPTERS = 1, 1 << 30, 3


def admit_text(files: DataFrame) -> DataFrame:
    """``path, status, reason`` of ``path, length``: a text file has the suffix and 1 byte to 1 GiB."""
    reason = F.when(~F.endswith(F.lower("path"), F.lit(".txt")), "not-a-text-file").when(F.coalesce("length", F.lit(0)) < LEAST_TEXT, "empty").when(F.col("length") > MOST_TEXT, "too-large")
    return files.select("path", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"))


def json_objects(files: DataFrame, schema: str) -> DataFrame:
    """``path, status, value`` of ``path, text``: the text must be one JSON object; anything else is ``invalid`` and has no value."""
    found = F.from_json("text", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    whole = F.startswith(F.ltrim(F.regexp_replace("text", "\\s+", " ")), F.lit("{")) & _is_one_value(F.col("text"))
    rows = files.select("path", "text", found.alias("x")).withColumn("ok", F.coalesce(whole & F.col("x._bad").isNull(), F.lit(False)))
    return rows.select("path", F.when(F.col("ok"), "object").otherwise("invalid").alias("status"), F.when(F.col("ok"), F.col("x").dropFields("_bad")).alias("value"))


def _is_one_value(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else: as the only element of an array, since parsers stop after the first value."""
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce(F.try_parse_json(wrapped).isNotNull() & (F.json_array_length(wrapped) == 1), F.lit(False))


def json_lines(files: DataFrame) -> DataFrame:
    """``path, line_no, line, problem`` of every line that is not blank: ``bad-json``, ``not-an-object``, or null where it is fine.

    A strict reader stops if any problem is there and can name the line; a lenient one reads the rows without.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("pos", "line")).where(F.trim("line") != "")
    problem = F.when(~_is_one_value(F.col("line")), "bad-json").when(~F.startswith(F.ltrim("line"), F.lit("{")), "not-an-object")
    return lines.select("path", (F.col("pos") + 1).alias("line_no"), "line", problem.alias("problem"))


def header_scalar(text: Column, key: str, indent: int = 0) -> Column:
    """The value of ``key`` at a fixed indent of a restricted header: JSON strings are unquoted, ``null`` is null; null if the key is not there."""
    raw = F.regexp_extract_all(text, F.lit(f"(?m)^ {{{indent}}}{key}:[ \t]*(.*?)[ \t]*$"), F.lit(1))
    value = F.get(raw, F.lit(0))
    quoted = F.when(F.rlike(value, F.lit('^".*"$')), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))
    return F.when(value.isNull() | (value == "null"), F.lit(None)).otherwise(F.coalesce(quoted, F.regexp_replace(value, "^'(.*)'$", "$1")))


def header_list(text: Column, key: str, indent: int = 0) -> Column:
    """The items of a flat list under ``key``; an empty one for ``[]`` or without the key."""
    block = F.regexp_extract(text, f"(?m)^ {{{indent}}}{key}:[ \t]*\n((?: {{{indent}}}[ ]*- .*\n?)*)", 1)
    items = F.filter(F.split(block, "\n"), lambda x: F.startswith(F.ltrim(x), F.lit("- ")))
    return F.transform(items, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, "^ *- ", "")), "^[\"'](.*)[\"']$", "$1"))


def source_manifest(files: DataFrame) -> DataFrame:
    """``path, sha256``, each path once: of ``path, content``."""
    return files.groupBy("path").agg(F.max(F.sha2("content", 256)).alias("sha256"))


def changed_sources(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """``path, problem``: what is ``changed``, ``missing`` or ``new`` between two manifests."""
    both = frozen.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("is")), "path", "full_outer")
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("is"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def import_status(files: DataFrame, documents: DataFrame, lines: DataFrame) -> DataFrame:
    """``path, format, chapters, status``: files by suffix, with what their chapters (``documents``: path, blocks; ``lines``: path) allow."""
    kind = F.when(F.endswith(F.lower("path"), F.lit(".epub")), "epub").when(F.endswith(F.lower("path"), F.lit(".txt")), "txt").otherwise("unsupported")
    rows = files.select("path", kind.alias("format")).distinct()
    filled = documents.where(F.size("blocks") > 0).groupBy("path").agg(F.count("*").alias("chapters"))
    texts = lines.groupBy("path").agg(F.count("*").alias("lines"))
    rows = rows.join(filled, "path", "left").join(texts, "path", "left")
    enough = F.when(F.col("format") == "epub", F.coalesce("chapters", F.lit(0)) >= LEAST_CHAPTERS).when(F.col("format") == "txt", F.coalesce("lines", F.lit(0)) > 0).otherwise(F.lit(False))
    return rows.select("path", "format", F.coalesce("chapters", F.lit(0)).cast("bigint").alias("chapters"), F.when(F.col("format") == "unsupported", "unsupported").when(enough, "imported").otherwise("too-little-text").alias("status"))


def decoded(files: DataFrame, detected: DataFrame) -> DataFrame:
    """``path, line_no, text``: non-blank lines of the files (``path, content``) whose encoding is known, decoded strictly."""
    import pandas as pd

    @F.pandas_udf("string")
    def decode(content: pd.Series, encoding: pd.Series) -> pd.Series:
        return pd.Series([None if e is None else bytes(c).decode(e) for c, e in zip(content, encoding, strict=True)], dtype=object)

    known = files.select("path", "content").join(detected.where("status = 'detected'").select("path", "encoding"), "path")
    lines = known.select("path", F.posexplode(F.split(decode("content", "encoding"), "\r\n|\r|\n")).alias("pos", "line"))
    return lines.select("path", (F.col("pos") + 1).alias("line_no"), X.clean_display(F.col("line")).alias("text")).where("text <> ''")
