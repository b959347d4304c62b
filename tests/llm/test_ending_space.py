"""Pre-tokens of texts that end in a space."""

from verdigris.llm import pieces, token_counts


def test_a_space_at_the_end_counts(spark):
    mark = pieces.MARK
    assert token_counts.pre_tokens("a b ") == [mark + "a", mark + "b", mark]
    assert token_counts.pre_tokens("a b") == [mark + "a", mark + "b"] and token_counts.pre_tokens("") == []
    texts = ["a b", "a b ", "a b  ", "the end\n ", "the end\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    n = {r["doc_id"]: r["n_pre_tokens"] for r in token_counts.token_counts(docs, pieces.default_model()).collect()}
    assert n == {0: 2, 1: 3, 2: 4, 3: 4, 4: 3}
    sp = pieces.ChunkEncoder(pieces.default_model()).sp
    for text in ("a b ", "a b  ", " ", "  "):
        assert "".join(token_counts.pre_tokens(text)) == mark + text.replace(" ", mark) == "".join(sp.encode(text, out_type=str))
