"""Ranked search against a plain computation over all documents, and the clustering that it visits."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from verdigris.llm import bisection, lexical_search

DOCS = "doc_id bigint, text string, item_id string, rank string, score string, term string"
ITEMS = "item_id bigint, text string, doc_id int, shard string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def said(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """``item_id, rank, doc_id, score`` by scoring everything."""
    tf = [(d, Counter(said(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in tf]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for (d, c), n in zip(tf, sizes, strict=True):
            m = 10 + (90 * n * n_docs) // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(said(text)) if c[t])
            if s > 0:
                scored.append((-s, (d is not None, d or 0), d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **how):
    width = len(DOCS.split(",")) - 2
    d = spark.createDataFrame([(*x, *["c"] * width) for x in docs], DOCS)
    i = spark.createDataFrame([(*x, 1, "s") for x in items], ITEMS)
    out = lexical_search.search(d, i, **how)
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in out.collect()), key=str)


def test_terms_are_those_of_the_pattern():
    for text in ("", "A-b_c 12é~Ünï", "\x00\x7f[x]", "中文，字 a b\x85c", "ÀB ÉCole İX"):
        assert [t.decode() for t in lexical_search.terms_of(text)] == said(text)


@pytest.mark.parametrize("shard", [3, 1000])
def test_search_equals_scoring_everything(spark, shard):
    r = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)]
    docs = [(int(i), " ".join(r.choice(vocab, int(r.integers(1, 40)), p=np.arange(60, 0, -1) / 1830))) for i in r.permutation(120)]
    docs += [(500 + i, "w1 w2 w3 w50") for i in range(30)] + [(7, "w1 w2 w3 w50")] * 2 + [(900, None), (901, ""), (902, "!!!"), (903, "w59 " * 5000)]
    items = [(i, " ".join(r.choice(vocab, 6))) for i in range(8)] + [(20, "w1 w2 W3 w50"), (21, None), (22, ""), (23, "unheard of"), (24, "w59 w59 never"), (20, "w4")]
    assert found(spark, docs, items, shard=shard) == plain(docs, items)


def test_null_ids_ties_and_repeats(spark):
    docs = [(None, "alpha beta"), (3, "alpha beta"), (1, "alpha beta"), (1, "alpha beta"), (-4, "beta alpha"), *[(10 + i, "gamma delta") for i in range(9)]]
    assert found(spark, docs, [(1, "alpha")], k=3) == plain(docs, [(1, "alpha")], 3)
    assert [x[2] for x in found(spark, docs, [(1, "alpha")], k=4)] == [None, -4, 1, 1]
    assert found(spark, docs, [(None, "alpha")], k=1) == [(None, 1, None, found(spark, docs, [(1, "alpha")], k=1)[0][3])]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_far_shards_are_not_visited(spark, monkeypatch):
    """Bounds keep an item away from shards without anything near its tenth score; its first visits are single shards."""
    docs = [(i, f"t{i % 8} " * 3 + f"t{i % 8}x") for i in range(160)] + [(1000 + i, "needle thread " * 4) for i in range(12)] + [(2000, "needle")]
    asked = []
    real = lexical_search._visit
    monkeypatch.setattr(lexical_search, "_visit", lambda index, items, k: (asked.append((index, items)), real(index, items, k))[1])
    monkeypatch.setattr(lexical_search, "DEPTH", 3)
    assert found(spark, docs, [(1, "needle thread"), (2, "t1")], shard=20) == plain(docs, [(1, "needle thread"), (2, "t1")])
    index = asked[0][0].select("terms", "most").collect()
    visited = 0
    for _, items in asked:
        for _, terms, weights, _, low, high in items:
            bounds = [sum(w * dict(zip(r["terms"], r["most"], strict=True)).get(t, 0) for t, w in zip(terms, weights, strict=True)) for r in index]
            visited += sum(max(low, 1) <= b < high for b in bounds)
    assert len(asked) <= 3 and visited < len(index)  # two items over all shards would be twice as many


def test_blocks_of_items_find_what_all_at_once_find(spark, monkeypatch):
    docs = [(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(60)]
    items = [(i, f"w{i % 7} w{i % 4}") for i in range(9)]
    monkeypatch.setattr(lexical_search, "TERMS_AT_ONCE", 4)
    assert found(spark, docs, items, shard=8) == plain(docs, items)


def test_bisection_brings_documents_of_shared_terms_together():
    r = np.random.default_rng(1)
    topics = r.integers(0, 4, 400)
    docs = [np.unique(np.concatenate([t * 50 + r.integers(0, 50, 12), 200 + r.integers(0, 50, 3)])) for t in topics]
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    tree = bisection.fit(starts, np.concatenate(docs), 250, 2)
    leaves = tree.leaves(starts, np.concatenate(docs))
    assert min(np.bincount(leaves, minlength=4)) > 50
    pure = sum(np.bincount(topics[leaves == leaf], minlength=4).max() for leaf in range(4))
    assert pure > 340  # by chance about 120
