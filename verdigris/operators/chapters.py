"""Chapters of plain texts, and the sampling of their paragraphs: greedy passes inside one document or one chapter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import split_long

#: What chapters without a heading of their own are called, and the mark of a part that continues one.
UNTITLED, PREFACE, CONTINUED = "正文", "前置内容", "{}（续 {}）"


def segment_chapters(docs: DataFrame, max_chars: int = 80_000, max_paragraphs: int = 800, max_piece: int = 8_000) -> DataFrame:
    """``doc_id, line_no, chapter, title, paragraph_index, text, locator``: one row per paragraph, long lines in pieces.

    A heading opens a chapter and is its first paragraph; a chapter that would grow beyond either limit goes on as
    a numbered part. Lines are cleaned and headings told in the JVM; one pass over a document's sizes cuts it, so
    nothing is shuffled. Null and blank texts have no rows.
    """
    lines = F.transform(F.split("text", "\r\n|\r|\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.trim(F.regexp_replace(x, "[\\t\\f\\x0B ]+", " ")).alias("text")))
    kept = F.transform(F.filter(lines, lambda x: x["text"] != ""), lambda x: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"), X.is_heading(x["text"]).alias("heading")))
    rows = docs.select("doc_id", kept.alias("lines")).where("size(lines) > 0")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def placed(found: list[dict]) -> Iterator[tuple[int, int, str, int, str]]:
        headed = any(x["heading"] for x in found)
        name, part, chapter, n, chars = PREFACE if headed else UNTITLED, 1, 1, 0, 0
        for x in found:
            pieces = split_long(x["text"], max_piece)
            for k, piece in enumerate(pieces):
                opens = k == 0 and x["heading"]
                if n and (opens or n >= max_paragraphs or chars + len(piece) > max_chars):
                    chapter, part, n, chars = chapter + 1, part + 1, 0, 0
                if opens:
                    name, part = x["text"], 1
                n, chars = n + 1, chars + len(piece)
                yield x["line_no"], chapter, name if part == 1 else CONTINUED.format(name, part), n, piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("line_no", "chapter", "title", "paragraph_index", "text")
        for batch in batches:
            for at in range(batch.num_rows):
                columns = list(zip(*placed(batch.column(1)[at].as_py()), strict=True))
                ids = batch.column(0).take(pa.array([at] * len(columns[0]), pa.int64()))
                types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_pydict({"doc_id": ids, **{n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)}})

    out = rows.mapInArrow(run, f"doc_id {kind}, line_no int, chapter int, title string, paragraph_index int, text string")
    return out.select("*", X.locator(X.sha256(F.col("doc_id").cast("string")), F.col("chapter"), F.col("paragraph_index")).alias("locator"))


def _chosen(usable: list[bool]) -> list[tuple[int, int | None]]:
    """Each sampled index with the index that stands in for it: itself if usable, else the nearest usable one that no earlier sample took."""
    n = len(usable)
    middle = n // 2
    wanted = range(n) if n <= 12 else sorted({*range(4), middle - 1, middle, middle + 1, *range(n - 4, n)})
    taken: set[int] = set()
    out: list[tuple[int, int | None]] = []
    for i in wanted:
        free = (j for j in range(n) if usable[j] and j not in taken)
        stand_in = i if usable[i] else min((j for j in free if j != i), key=lambda j: (abs(j - i), j), default=None)
        if stand_in is not None:
            taken.add(stand_in)
        out.append((i, stand_in))
    return out


def sample_with_replacement(paras: DataFrame, analysed: DataFrame) -> DataFrame:
    """``locator, replacement``: each chapter's sample, and for each sampled paragraph the one used in its place.

    ``analysed`` (``locator, analysis_text``) has null for what cleaning skipped. The order of choice matters, so a
    chapter is one row here; importing bounds it to some hundred paragraphs.
    """

    @F.pandas_udf("array<struct<i: int, j: int>>")
    def choose(flags: pd.Series) -> pd.Series:
        return flags.map(lambda x: [{"i": i, "j": j} for i, j in _chosen(list(x))])

    rows = paras.select("doc_id", "chapter", "paragraph_index", "locator").join(analysed.where("analysis_text is not null").select("locator", F.lit(True).alias("usable")), "locator", "left")
    ordered = F.sort_array(F.collect_list(F.struct("paragraph_index", "locator", F.coalesce("usable", F.lit(False)).alias("usable"))))
    chapters = rows.groupBy("doc_id", "chapter").agg(ordered.alias("p"))
    picked = chapters.select("p", F.explode(choose(F.transform("p", lambda x: x["usable"]))).alias("c"))
    return picked.select(F.get("p", F.col("c.i"))["locator"].alias("locator"), F.get("p", F.col("c.j"))["locator"].alias("replacement"))
