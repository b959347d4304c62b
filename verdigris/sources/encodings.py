"""Which encoding a text file is in: told, marked, UTF-8, or scored among legacy ones; never guessed between near ones."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bytes that are scored, the legacy encodings, the lead one needs, and what speaks for and against a decoding.
SAMPLE_BYTES = 512 * 1024
LEGACY = ("gb18030", "big5")
LEAST_LEAD = 0.08
COMMON = "，。！？；：、“”‘’（）《》章节第的了是在和"
GARBLED = "锟斤拷鈥銆鐨勫湪"
MARKS = {codecs.BOM_UTF8: "utf-8-sig", codecs.BOM_UTF16_LE: "utf-16", codecs.BOM_UTF16_BE: "utf-16"}
SCHEMA = "status string, encoding string, confidence string, candidates array<string>, reason string"
_COMMON, _GARBLED = (np.array(sorted(map(ord, x)), np.uint32) for x in (COMMON, GARBLED))


def _strict(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except (UnicodeDecodeError, LookupError):
        return None


def legacy_score(text: str) -> float | None:
    """How much the text looks like Chinese: three points for the share of ideographs, one for common characters, two off for garbled ones; None if it looks like no text at all."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    visible = np.array([not c.isspace() for c in text], bool)
    control = (points < 32) & ~np.isin(points, (9, 10, 13))
    if not visible.any() or control.mean() > 0.01:
        return None
    seen = points[visible]
    share = lambda found: float(found.mean())
    return 3 * share((seen >= 0x3400) & (seen <= 0x9FFF)) + share(np.isin(seen, _COMMON)) - 2 * share(np.isin(seen, _GARBLED))


def detect(data: bytes, told: str | None = None) -> tuple[str, str | None, str | None, list[str], str | None]:
    """Status (detected, ambiguous, rejected), encoding, confidence, candidates, and the reason of a rejection."""

    def checked(encoding: str, confidence: str, reason: str):
        return ("detected", encoding, confidence, [encoding], None) if _strict(data, encoding) is not None else ("rejected", None, None, [], reason)

    if told:
        try:
            return checked(codecs.lookup(told).name, "explicit", "not-in-told-encoding")
        except LookupError:
            return "rejected", None, None, [], "unknown-encoding"
    for mark, encoding in MARKS.items():
        if data.startswith(mark):
            return checked(encoding, "bom", "not-in-marked-encoding")
    if b"\0" in data[:SAMPLE_BYTES]:
        return "rejected", None, None, [], "nul-bytes"
    if _strict(data, "utf-8") is not None:
        return "detected", "utf-8", "high", ["utf-8"], None
    scores = {}
    for encoding in LEGACY:
        sample = _strict(data[:SAMPLE_BYTES], encoding) if _strict(data, encoding) is not None else None
        score = legacy_score(sample) if sample else None
        if score is not None and score >= 0:
            scores[encoding] = score
    ranked = sorted(scores, key=lambda e: (scores[e], e), reverse=True)
    if not ranked:
        return "rejected", None, None, [], "unsupported"
    if len(ranked) > 1 and scores[ranked[0]] - scores[ranked[1]] < LEAST_LEAD:
        return "ambiguous", None, "low", ranked, None
    return "detected", ranked[0], "medium", ranked, None


def detect_encodings(files: DataFrame, key: str = "path", content: str = "content", told: Column | None = None) -> DataFrame:
    """One row per file: its key and what ``detect`` says. Null content counts as empty; each row is judged alone."""
    rows = files.select(F.col(key).alias("key"), F.coalesce(F.col(content), F.lit("").cast("binary")).alias("content"), (F.lit(None).cast("string") if told is None else told).alias("told"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [detect(data.as_py(), told.as_py()) for data, told in zip(batch.column(1), batch.column(2), strict=True)]
            status, encoding, confidence, candidates, reason = zip(*found, strict=True) if found else ([],) * 5
            text = lambda x: pa.array(list(x), pa.string())
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "status": text(status), "encoding": text(encoding), "confidence": text(confidence), "candidates": pa.array(list(candidates), pa.list_(pa.string())), "reason": text(reason)})

    return rows.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
