"""Token counts against segmentations written out in full, and against the vocabulary's own encoding."""

import math

from verdigris.llm import pieces, token_counts


def every_segmentation(word, scores, byte_score):
    if not word:
        yield 0.0, 0
        return
    for end in range(1, len(word) + 1):
        head = word[:end]
        steps = [(scores[head], 1)] if head in scores else []
        if end == 1:
            n = len(head.encode())
            steps.append((n * byte_score, n))
        for score, tokens in steps:
            for rest, more in every_segmentation(word[end:], scores, byte_score):
                yield score + rest, tokens + more


def test_scores_are_log_probabilities():
    trie = token_counts.TrieCounter(pieces.default_model())
    total = math.fsum(math.exp(s) for s in trie.pieces.values()) + 256 * math.exp(trie.byte_score)
    assert 0.99 < total < 1.0  # the bytes count as the last rank, so a little is left
    assert trie.pieces["▁the"] > trie.pieces["▁therefore"] > trie.byte_score
    own = token_counts.TrieCounter(pieces.default_model(), ranked=False)
    assert own.byte_score < min(own.pieces.values())


def test_the_best_of_all_segmentations_counts():
    trie = token_counts.TrieCounter(pieces.default_model())
    words = {pieces.MARK + w for w in ["", "a", "the", "thereby", "reading", "readers", "zzq", "漢字", "é🙂x", "Straße"]} | {"\n", "\n\t"}
    got = trie.counts(words)
    for word in words:
        best, tokens = max(every_segmentation(word, trie.pieces, trie.byte_score), key=lambda x: (round(x[0], 9), -x[1]))
        assert got[word] == tokens, (word, best)


def test_the_query_counts_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trie = token_counts.TrieCounter(pieces.default_model())
    rows = {r["doc_id"]: (r["n_pre_tokens"], r["n_tokens"]) for r in token_counts.token_counts(docs, pieces.default_model()).collect()}
    sp = pieces.ChunkEncoder(pieces.default_model()).sp
    mine = theirs = 0
    for r in docs.collect():
        parts = token_counts.pre_tokens(r["text"] or "")
        assert rows[r["doc_id"]] == (len(parts), sum(trie.counts({p})[p] for p in parts))
        mine, theirs = mine + rows[r["doc_id"]][1], theirs + len(sp.encode(r["text"] or ""))
    assert abs(mine - theirs) < 0.03 * theirs
