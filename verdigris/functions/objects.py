"""JSON objects of any shape: canonical text, hashes that leave fields out, and walks to every value."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored

#: Texts with one of these are written otherwise by the JVM: fractions, exponents, negative zeros, very long numbers, escapes by code, characters beyond the first plane (keys are ordered by code points).
UNLIKE = r"[0-9][.eE]|-0|[0-9]{38}|\\u|[\x{10000}-\x{10FFFF}]"
#: What a context's hash leaves out of the object, the lists whose items it looks into, and the kind of item that carries a time of its own.
CONTEXT_OUT, CONTEXT_LISTS, CORRECTION = ("context_sha256", "reviewed_at"), ("available_sources", "selected_sources"), "current-report-correction"


def json_string(x: Column) -> Column:
    """A text as JSON writes it, with characters beyond ASCII as they are; null as ``null``."""
    out = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = out
    for code in range(32):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(json.dumps(chr(code))[1:-1]))
    out = F.when(F.rlike(out, F.lit(r"[\x00-\x1F]")), rare).otherwise(out)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def json_object(**fields: Column) -> Column:
    """An object of fields that are JSON already, in the order of their names."""
    parts = [F.concat(F.lit(f"{json.dumps(name)}:"), fields[name]) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _dumped(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _loaded(text: str | None):
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _canonical_udf(x: pd.Series) -> pd.Series:
    def one(s):
        if s is None:
            return None
        try:
            return _dumped(json.loads(s))
        except ValueError:
            return None

    return x.map(one)


def canonical_json(x: Column) -> Column:
    """The JSON text with its keys sorted and no blanks; null for what is none.

    A variant keeps its fields sorted, so most texts never leave the JVM; those with numbers or escapes that it writes
    otherwise, and objects with a name twice (the last counts), go through Arrow.
    """
    plain = F.when(~F.rlike(x, F.lit(UNLIKE)), F.to_json(F.try_parse_json(x)))
    return F.coalesce(plain, _canonical_udf(F.when(plain.isNull(), x)))


def content_hash(x: Column) -> Column:
    """The hash of a JSON text's canonical form."""
    return F.sha2(canonical_json(x), 256)


def object_hash(x: Column, *left_out: str) -> Column:
    """The hash of a JSON object without some of its fields, such as the hash itself; null for what is no object."""

    @F.pandas_udf(T.StringType())
    def without(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _dumped({k: v for k, v in o.items() if k not in left_out}) if isinstance(o := _loaded(t), dict) else None)

    fields = F.try_variant_get(F.when(~F.rlike(x, F.lit(UNLIKE)), F.try_parse_json(x)), "$", "map<string,variant>")
    plain = F.to_json(F.map_filter(fields, lambda k, v: ~k.isin(*left_out)))
    return F.sha2(F.coalesce(plain, without(F.when(plain.isNull(), x))), 256)


@F.pandas_udf(T.StringType())
def _semantic_udf(x: pd.Series) -> pd.Series:
    def one(s):
        o = _loaded(s)
        if not isinstance(o, dict):
            return None
        o = {k: v for k, v in o.items() if k not in CONTEXT_OUT}
        for name in CONTEXT_LISTS:
            for item in o.get(name) or []:
                if isinstance(item, dict) and item.get("source_type") == CORRECTION and isinstance(item.get("source"), dict):
                    item["source"].pop("recorded_at", None)
        return _dumped(o)

    return x.map(one)


def context_hash(x: Column) -> Column:
    """The hash of what a context says: without its own hash, the time of its review, and the times of corrections."""
    return F.sha2(_semantic_udf(x), 256)


def walked(rows: DataFrame, text: str, *ids: str) -> DataFrame:
    """``ids, path, name, kind, value``: every value of the JSON objects in ``text`` that is no object or array itself.

    ``name`` is the field that a value or its array belongs to, ``path`` also has the places in arrays. Nesting of any
    depth and shape is opened one level at a time, without a shuffle, until nothing is left; text that is no JSON has no
    values.
    """
    spark = rows.sparkSession
    level = rows.select(*ids, F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(text).alias("v")).where("v is not null")
    found = []
    while True:
        level = stored(level.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), r"^(\w+)", 1)), "json-level")
        found.append(level.where("kind not in ('OBJECT', 'ARRAY')").select(*ids, "path", "name", "kind", F.try_variant_get("v", "$", "string").alias("value")))
        inner = level.where("kind in ('OBJECT', 'ARRAY')")
        if inner.isEmpty():
            break
        opened = inner.withColumnRenamed("v", "whole").lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        opened = opened.where("pos is not null")
        level = opened.select(*ids, F.concat("path", F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))).alias("path"), F.coalesce("key", "name").alias("name"), F.col("value").alias("v"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cited_anywhere(rows: DataFrame, text: str, *ids: str, names: tuple[str, ...] = ("citations", "book_citations")) -> DataFrame:
    """``ids, locator``: what results of any shape cite, each once."""
    return walked(rows, text, *ids).where(F.col("name").isin(*names) & (F.col("kind") == "STRING")).select(*ids, F.col("value").alias("locator")).distinct()


def claimed_anywhere(rows: DataFrame, text: str, claims: list[str], *ids: str) -> DataFrame:
    """``ids, path, claim``: the strings inside of results that claim what they must not; names of fields claim nothing."""
    said = F.filter(F.array(*map(F.lit, claims)), lambda c: F.contains("value", c))
    return walked(rows, text, *ids).where("kind = 'STRING'").select(*ids, "path", F.explode(said).alias("claim"))
