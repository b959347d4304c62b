"""The pipeline's rows against a plain run of the same five decisions."""

import hashlib
import re

import duckdb
import sentencepiece

from verdigris.llm import mixing, pieces, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_steps(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.toPandas().sort_values("doc_id")
    grammar = toxicity.taught(spark, SF, docs)
    reader = toxicity.Reader(grammar.stems)
    kept = kept[[float(grammar.score([reader.features(t)])[0]) < 0.5 for t in kept.text]]
    kept = kept[~kept.text.map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)).duplicated()]
    ids, fp = list(kept.doc_id), {d: simhash.fingerprint(t.encode(), 5) % (1 << 64) for d, t in zip(kept.doc_id, kept.text, strict=True)}
    words = dict(zip(kept.doc_id, kept.text.str.lower().str.split(), strict=True))
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    group = {d: d for d in ids}
    for a in ids:
        for b in ids:
            if group[a] != group[b] and (fp[a] ^ fp[b]).bit_count() <= 4 and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    documents = kept[[group[d] == d for d in kept.doc_id]]
    con = duckdb.connect()
    con.register("documents", documents)
    sql = mixing.OP7_SQL.replace("2 * sum(n_tokens)", "1 * sum(n_tokens)").replace("* 0.5::DOUBLE", "* 0.8::DOUBLE")
    chosen = set(con.execute(sql).df().query("copies > 0").doc_id)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = {(d, hashlib.sha256(" ".join(map(str, [*sp.encode(t), 2])).encode()).hexdigest()) for d, t in zip(documents.doc_id, documents.text, strict=True) if d in chosen}
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
