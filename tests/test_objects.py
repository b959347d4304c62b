"""JSON objects against Python's own module."""

import hashlib
import json

from pyspark.sql import functions as F

from verdigris.functions import objects as O

TEXTS = [
    '{"b":1,"a":[1.0,1.10,1e5,12345678901234567890123,true,null,"x/é\\u001f\\n\\t\\"\\\\ \\ud83d\\ude00"],"a2":{"z":{},"y":[]},"A":-0.0,"é":0.1}', '{"a":1,"a":2}', ' [1, 2 ,{"z":1,"y":[]}] ', '"s"', "12",
    '{"sha":"x","é":"ß","Z":{"b":2,"a":1},"n":null,"t":"tab\\there"}', '{"\\ud83d\\ude00":1,"\\uff5a":2}', '{"k":9007199254740993,"m":123456789012345678901234567890123456789012}', "bad", "", None, '{"e":{}}', '{"list":[[],[[1]],{}]}',
]


def dumped(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def loaded(t):
    try:
        return json.loads(t)
    except (ValueError, TypeError):
        return None


def test_canonical_text_and_hashes(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", O.canonical_json(F.col("t")).alias("c"), O.content_hash(F.col("t")).alias("h"), O.object_hash(F.col("t"), "sha", "n").alias("o")).collect()
    for r in rows:
        x = loaded(r["t"])
        assert r["c"] == (None if x is None else dumped(x)) and r["h"] == (None if x is None else sha(dumped(x)))
        assert r["o"] == (sha(dumped({k: v for k, v in x.items() if k not in ("sha", "n")})) if isinstance(x, dict) else None)


def test_strings_of_all_characters(spark):
    texts = ["".join(map(chr, range(0, 300))), 'a"\\u001f\\', "😀 é", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", O.json_string(F.col("t")).alias("j"), O.json_object(b=O.json_string(F.col("t")), a=F.lit("1")).alias("o")).collect()
    for r in rows:
        assert r["j"] == json.dumps(r["t"], ensure_ascii=False) and r["o"] == dumped({"a": 1, "b": r["t"]})


def test_a_context_is_what_it_says(spark):
    context = lambda at, when, text: json.dumps({"reviewed_at": at, "context_sha256": at, "selected_sources": [{"source_type": "current-report-correction", "source": {"recorded_at": when, "x": text}}, {"source_type": "belief", "source": {"recorded_at": "kept"}}, 1], "available_sources": None})
    rows = spark.createDataFrame([(context("1", "2", "t"),), (context("3", "4", "t"),), (context("1", "2", "u"),), ("[]",)], "t string").select(O.context_hash(F.col("t")).alias("h")).collect()
    a, b, c, d = (r["h"] for r in rows)
    assert a == b != c and d is None
    assert a == sha(dumped({"selected_sources": [{"source_type": "current-report-correction", "source": {"x": "t"}}, {"source_type": "belief", "source": {"recorded_at": "kept"}}, 1], "available_sources": None}))


def leaves(x, path="$", name=None):
    if isinstance(x, dict):
        return [y for k, v in x.items() for y in leaves(v, f"{path}.{k}", k)]
    if isinstance(x, list):
        return [y for i, v in enumerate(x) for y in leaves(v, f"{path}[{i}]", name)]
    return [(path, name, x)]


def test_walks_reach_every_value(spark):
    deep = '{"a":' * 30 + '"end"' + "}" * 30
    texts = [t for t in TEXTS if not t or "e5" not in t] + [deep]
    got = sorted((r["id"], r["path"], r["name"], r["value"]) for r in O.walked(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", "id").collect())
    shown = lambda v: None if v is None else str(v)
    want = sorted((i, p, n, shown(v)) for i, t in enumerate(texts) if (x := loaded(t)) is not None and t != '{"a":1,"a":2}' for p, n, v in leaves(x))
    known = [w for w in want if not (w[3] or "").startswith("123456789012345678901234567890123456789012")]
    assert [g for g in got if g[1] != "$.m"] == known


def test_citations_and_claims_of_any_shape(spark):
    rows = spark.createDataFrame([(1, '{"s":[{"claims":[{"citations":["a","b"]}]},{"deep":{"book_citations":["c",{"x":"no"}],"citations":"d"}}],"note":"已逐字读完","逐字读完":"no"}'), (2, '[{"citations":[]}]'), (3, None)], "id int, t string")
    assert sorted(map(tuple, O.cited_anywhere(rows, "t", "id").collect())) == [(1, "a"), (1, "b"), (1, "c"), (1, "d")]
    assert sorted(map(tuple, O.claimed_anywhere(rows, "t", ["逐字读完"], "id").collect())) == [(1, "$.note", "逐字读完")]
