"""The verdict of the quality rules on texts with and without their language's common words."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigris.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("lang", sorted(quality.COMMON_WORDS))
def test_texts_without_common_words_are_rejected(spark, lang):
    rng = random.Random(4)
    references = quality.language_references(spark.read.parquet(f"{SF}/documents.parquet"))
    common = quality.COMMON_WORDS[lang].split()
    shares = references[lang][1]
    word = lambda: "".join(rng.choice("aeioubdklmnrst") for _ in range(5))
    clean = [" ".join(rng.choices([*common, None], shares)[0] or word() for _ in range(n)) for n in (120, 400, 1000)]
    bare = [" ".join(word() for _ in range(n)) for n in (80, 120, 400, 1000)]
    docs = spark.createDataFrame([(i, t, lang) for i, t in enumerate(clean + bare)], "doc_id int, text string, lang string")
    # The character rule is left out: these words have no capitals and no marks.
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, references=references, max_char_distance=1.0).collect()}
    assert kept == {i: i < len(clean) for i in range(len(clean + bare))}


def test_windows_whose_hashes_meet(spark, monkeypatch):
    """Interleaved windows of one hash: every repeat is found, whatever the hash."""
    rng = random.Random(2)
    texts = ["a b c x a b d y a b c z", "p q r", "a a a a", *[" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("lang", F.lit("en"))

    def plain(text):
        w = text.split()
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        return len({i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)})

    for weak in (None, lambda *x: F.length(x[0]).cast("long"), lambda *x: F.xxhash64(x[0])):
        if weak:
            monkeypatch.setattr(quality, "_window_hash", weak)
        assert {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_rules(docs).collect()} == {i: plain(t) for i, t in enumerate(texts)}
