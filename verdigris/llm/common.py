"""What the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class body for Java and Python patterns.
SPACE = r"\x20\x09-\x0D"
#: Bits in one bitmap of bitmap_construct_agg (fixed by Spark).
BITMAP_BITS = 32768


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, or the one that the context was given. With neither a local master (tests) gets a temporary one; a cluster has no place for tables between jobs then."""
    sc = spark.sparkContext
    named, have = spark.conf.get("spark.checkpoint.dir", None), sc.getCheckpointDir()
    if not (named or have) and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if have is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc.getCheckpointDir()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared checkpoint folder, for a table that one job writes and another reads."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, which survives a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def join_same(left: DataFrame, right: DataFrame, names: tuple[str, ...] | list[str], how: str = "inner", where: Column | None = None) -> DataFrame:
    """A join on the named columns in which null equals null; each of them stands once in the result."""
    right = right.withColumnsRenamed({n: f"__right_{n}" for n in names})
    on = F.lit(True) if where is None else where
    for n in names:
        on = F.col(n).eqNullSafe(F.col(f"__right_{n}")) & on
    return left.join(right, on, how).drop(*[f"__right_{n}" for n in names])


def _slot(names: list[str], bitmaps: int) -> tuple[Column, Column]:
    """The bitmap of a key, and its bit there."""
    h = F.xxhash64(*names)
    return F.pmod(F.shiftright(h, 15), F.lit(bitmaps)), F.pmod(h, F.lit(BITMAP_BITS)).cast("int")


def repeated_bitmap(rows: DataFrame, names: list[str], bitmaps: int = 256) -> DataFrame:
    """Which keys stand in two rows or more, as bitmaps of ``bitmaps`` times 4 KB however many rows there are (``slot, bits``)."""
    slot, bit = _slot(names, bitmaps)
    return rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").groupBy(slot.alias("slot")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def in_bitmap(rows: DataFrame, filters: DataFrame, names: list[str], flag: str, bitmaps: int = 256) -> DataFrame:
    """Adds whether a row's key may be in the bitmaps: true for all keys in them, and for some others by chance."""
    slot, bit = _slot(names, bitmaps)
    at = F.col("__bit")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    seen = F.expr("coalesce((shiftright(__byte, __bit % 8) & 1) = 1, false)")
    out = rows.withColumns({"slot": slot, "__bit": bit}).join(F.broadcast(filters), "slot", "left")
    return out.withColumn("__byte", byte).withColumn(flag, seen).drop("slot", "bits", "__bit", "__byte")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def spaced(text: Column) -> Column:
    """``text`` with every run of ASCII white space replaced by one space."""
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def words(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(inner, f"[{SPACE}]+"))
