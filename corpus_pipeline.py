"""From documents to training ids in five stages, each written as Parquet and read again as the next one's input.

Not one SQL statement: toxicity and fingerprints are beyond SQL, so the rows are tested against a brute-force run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import exact_dedup, mixing, pieces, simhash, toxicity
from verdigris.llm.common import shared_folder, text_or_empty


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half, by a grammar learned from the labelled rows of the training fold. A row is told by its id and its text."""
    text = F.xxhash64(text_or_empty())
    told = docs.select(F.struct("doc_id", text.alias("h")).alias("doc_id"), "text")
    bad = toxicity.toxicity(told, toxicity.taught(spark, sf_dir, docs)).where("predicted = 1").select(F.col("doc_id.doc_id").alias("__bad"), F.col("doc_id.h").alias("__h"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]) & (text == bad["__h"]), "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal documents."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of documents whose five-word SimHashes are within four bits, and whose shingles have a Jaccard similarity of 0.8 or more."""
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weighted tree of domains, languages and sources has room for, each once."""
    return mixing.mixed(docs, budget_share=0.8, max_epochs=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and what they decode to."""
    return pieces.sentencepiece_roundtrip(docs, pieces.default_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
