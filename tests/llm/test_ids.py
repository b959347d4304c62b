"""Null and repeated ids with different texts through the stages of the pipeline."""

import pytest

from verdigris.llm import mixing, toxicity

LONG = "one two three four five six seven eight nine ten " * 3
ROWS = [
    (None, LONG + "alpha"), (None, LONG + "beta gamma delta"), (None, "you idiot."), (None, "something else stands in this text"),
    (7, LONG + "alpha"), (7, "seven says one thing here"), (7, "seven says a second thing there"), (7, "seven says one thing here"), (8, "you idiot."), (8, "eight is polite"), (9, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", "src1") for r in ROWS], "doc_id bigint, text string, lang string, source string")


def _rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_toxic_rows_go_alone(spark, docs, monkeypatch):
    import corpus_pipeline

    n = len(toxicity.FEATURES)
    weights = [9.0 if f == "insult_targeted" else 0.0 for f in toxicity.FEATURES]
    monkeypatch.setattr(toxicity, "taught", lambda *a: toxicity.Grammar({"^idiot": 5.0}, weights, -1.0, [0.0] * n, [1.0] * n))
    assert _rows(corpus_pipeline.drop_toxic(spark, docs, "")) == sorted((r for r in ROWS if r[1] != "you idiot."), key=str)


def test_copies_go_by_text(spark, docs):
    import corpus_pipeline

    # 7 and 8 are the smallest ids of the texts they share with null ids.
    left = sorted({r for r in ROWS if r not in {(None, LONG + "alpha"), (None, "you idiot.")}}, key=str)
    assert _rows(corpus_pipeline.drop_copies(spark, docs, "")) == left
    assert _rows(corpus_pipeline.drop_near_copies(spark, docs, "")) == left


def test_null_ids_with_one_prefix_are_told_apart(spark):
    import corpus_pipeline

    rows = [(i, "x" * 64 + c) for i in (None, 3) for c in "abba"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _rows(corpus_pipeline.drop_copies(spark, docs, "")) == [(3, "x" * 64 + "a"), (3, "x" * 64 + "b")]
    assert len(_rows(corpus_pipeline.drop_copies(spark, docs.where("doc_id is null"), ""))) == 2


def test_the_mix_takes_rows_and_not_ids(spark, docs):
    assert _rows(mixing.mixed(docs, budget_share=1.0, max_epochs=1)) == sorted(ROWS, key=str)
    for share in (0.3, 0.5, 0.8):
        some = mixing.mixed(docs, budget_share=share, max_epochs=2)
        chosen = mixing.mix_sources(docs, budget_share=share, max_epochs=2).selectExpr("sum(n_tokens * copies)").first()[0]
        words = sum(len((t or "").split()) for _, t in _rows(some))
        assert words == chosen <= share * sum(len((t or "").split()) for _, t in ROWS)


def test_every_row_gets_its_ids(spark, docs):
    import corpus_pipeline

    assert _rows(corpus_pipeline.encode(spark, docs, "").withColumnRenamed("decoded", "text")) == sorted(((d, t or "") for d, t in ROWS), key=str)
