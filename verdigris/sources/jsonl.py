"""JSON lines: strict (a bad line fails the read) and lenient (bad lines are kept apart)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the lines that do not."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = rows.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return parsed.where("x._bad is null").select("x.*").drop("_bad"), parsed.where("x._bad is not null").select("value")


def append_new(df: DataFrame, path: str, key: str = "event_id") -> None:
    """Appends rows whose key is not stored yet, each key once. Writers of one path must take turns: two at once could both find a key missing."""
    rows = df.dropDuplicates([key])
    try:
        rows = rows.join(df.sparkSession.read.schema(df.schema).json(path).select(key), key, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").json(path)
