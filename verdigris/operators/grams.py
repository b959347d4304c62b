"""Which texts contain which quotes: a quote meets only the texts of its own book, all of them in a book of few, else by an index of (book, gram).

A quote of six characters or more is looked up by its rarest gram of six, a shorter one by itself. Texts write only the
grams that some quote asks for, which a bitmap of fixed size tells, so that what is shuffled follows the quotes and not
the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

WIDTH = 6
#: Bitmaps of 4 KB (a size fixed by Spark) that tell which grams are asked for: 2 MB, however many they are.
BITMAPS, BITS = 512, 32768
#: Texts times quotes up to which a book's quotes meet all of its texts, and grams that a task holds at a time.
MOST_PAIRS, GRAMS_AT_ONCE = 4_000_000, 500_000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_keys(text: str, width: int, seed: int) -> np.ndarray:
    """Hashes of the text's windows of so many characters, different ones for each seed and width."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.full(n, np.uint64(seed % (1 << 64)) ^ np.uint64(width), np.uint64)
    for i in range(width):
        h = (h ^ codes[i : i + n]) * _STEP
        h ^= h >> np.uint64(29)
    h *= _MIX
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _asked(quotes: DataFrame) -> DataFrame:
    def told(targets: list, widths: list, keys: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(targets, pa.string()), pa.array(widths, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))], ["target", "width", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets, widths, keys, n = [], [], [], 0
            for target, seed, norm in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width = min(WIDTH, len(norm))
                own = np.unique(gram_keys(norm, width, seed))
                targets += [target] * len(own)
                widths += [width] * len(own)
                keys.append(own)
                n += len(own)
                if n >= GRAMS_AT_ONCE:
                    yield told(targets, widths, keys)
                    targets, widths, keys, n = [], [], [], 0
            yield told(targets, widths, keys)

    return quotes.select("target", "seed", "norm").mapInArrow(run, "target string, width int, key bigint")


def _held(texts: DataFrame, bitmap: bytes, widths: list[int]) -> DataFrame:
    none = [np.zeros(0, np.int64)]

    def told(batch: pa.RecordBatch, at: list, keys: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(none + at))), pa.array(np.concatenate(none + keys))], ["locator", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            at, keys, n = [], [], 0
            for i, (seed, norm) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for width in widths:
                    own = gram_keys(norm, width, seed)
                    slot = own & (BITMAPS * BITS - 1)
                    own = np.unique(own[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1])
                    at.append(np.full(len(own), i))
                    keys.append(own)
                    n += len(own)
                if n >= GRAMS_AT_ONCE:
                    yield told(batch, at, keys)
                    at, keys, n = [], [], 0
            yield told(batch, at, keys)

    return texts.select("locator", "seed", "norm").mapInArrow(run, "locator string, key bigint")


def gram_hits(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """``target, locator``: texts that contain a quote of their own book, each pair once.

    ``quotes`` has ``target`` (a string, unique), ``seed`` (a number of the book) and ``norm``; ``texts`` has ``locator,
    seed, norm``. Empty quotes are nowhere. A gram that most texts have is looked up only by quotes without a rarer one.
    """
    quotes = quotes.where("norm <> ''").select("target", "seed", "norm")
    asked = stored(_asked(quotes), "asked-grams")
    slot = F.col("key").bitwiseAND(F.lit(BITMAPS * BITS - 1))
    rows = asked.groupBy(F.floor(slot / BITS).alias("slot")).agg(F.bitmap_construct_agg((slot % BITS).cast("int")).alias("bits")).collect()
    bitmap = bytearray(BITMAPS * BITS // 8)
    for at, bits in rows:
        bitmap[at * len(bits) : (at + 1) * len(bits)] = bits
    widths = sorted(r[0] for r in asked.select("width").distinct().collect())  # six at most
    held = stored(_held(texts, bytes(bitmap), widths), "held-grams")
    counts = held.groupBy("key").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "key", "left").groupBy("target").agg(F.min_by(F.struct("key", "n"), F.struct(F.coalesce("n", F.lit(0)), "key")).alias("x"))
    rarest = rarest.where("x.n is not null").select("target", "x.key")
    places = rarest.join(held, "key").select("target", "locator")
    told = places.join(quotes.select("target", F.col("norm").alias("quote")), "target").join(texts.select("locator", "norm"), "locator")
    return told.where(F.contains("norm", "quote")).select("target", "locator").distinct()


def book_hits(quotes: DataFrame, texts: DataFrame, most_pairs: int | None = None) -> DataFrame:
    """As ``gram_hits``, for many books: only those of more than ``most_pairs`` texts times quotes go through the index of grams.

    In the others every quote is held against every text of its book, by a merge join that holds one book's side at a
    time: nothing is written for each gram, of which there are as many as characters.
    """
    quotes = quotes.where("norm <> ''").select("target", "seed", "norm")
    most = MOST_PAIRS if most_pairs is None else most_pairs
    many = quotes.groupBy("seed").agg(F.count("*").alias("q")).hint("merge").join(texts.groupBy("seed").agg(F.count("*").alias("t")), "seed")
    large = stored(many.where(F.col("q") * F.col("t") > most).select("seed"), "large-books")
    some = not large.isEmpty()
    few = [x.join(large, "seed", "left_anti") if some else x for x in (quotes, texts)]
    met = few[1].select("seed", "locator", "norm").hint("merge").join(few[0].withColumnRenamed("norm", "quote"), "seed").where(F.contains("norm", "quote")).select("target", "locator").distinct()
    return met.unionByName(gram_hits(*(x.join(large, "seed", "left_semi") for x in (quotes, texts)))) if some else met
