"""Quotations against plain Python over all paragraphs."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.operators import matching
from verdigris.operators import quotes as Q


def _ratio(q, t):
    width = min(len(t), len(q) + max(4, len(q) // 5))
    return max(SequenceMatcher(None, q, t[s : s + width]).ratio() for s in {*range(0, len(t) - width + 1, max(1, len(q) // 6)), len(t) - width})


def test_fuzzy_tier_has_every_similar_paragraph(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
    quotes, paras = [("fox", "thequickbrown")], [("fox", "thequikcbrown"), ("eleven", "thequickbro"), ("tiny", "th")]
    for n in [*range(12, 21), 64, 64, 100, 300]:
        q = text(n)
        quotes.append((f"q{len(quotes)}", q))
        at = rng.randrange(n // 3, 2 * n // 3)
        edited = [q[:at] + q[at + 1 :], q[:at] + "z" + q[at:], q[:at] + "z" + q[at + 1 :], "".join(c for i, c in enumerate(q) if i % 8 != 7)]
        paras += [(f"p{len(paras) + k}", t) for k, t in enumerate([*edited, text(40) + edited[0] + text(40), text(200)])]
    want = {(i, loc): round(r, 4) for i, q in quotes for loc, t in paras if (r := _ratio(q, t)) >= 0.88}
    assert len(want) > 40 and ("fox", "fox") in want
    for most in (Q.MOST_CHARS, 100):
        found = Q.quote_fuzzy(spark.createDataFrame(quotes, "item_id string, text string"), spark.createDataFrame(paras, "locator string, text string"), most_chars=most).collect()
        assert {(r["item_id"], r["locator"]): r["score"] for r in found} == want
    assert Q.quote_fuzzy(spark.createDataFrame([], "item_id string, text string"), spark.createDataFrame(paras, "locator string, text string")).where(F.lit(True)).count() == 0


def test_short_quotes_are_found_and_ambiguous(spark):
    quotes = spark.createDataFrame([(1, "fox"), (2, "O wl"), (3, "x"), (4, " "), (5, "brown fox"), (6, "zebra")], "item_id int, text string")
    paras = spark.createDataFrame([("a", "the brown fox"), ("b", "fox"), ("c", "an owl")], "locator string, text string")
    for most in (Q.MOST_CHARS, 0):
        hits = sorted(map(tuple, Q.quote_hits(quotes, paras, most_chars=most).collect()))
        assert hits == [(1, "a"), (1, "b"), (2, "c"), (3, "a"), (3, "b"), (5, "a")]
    found = {r["item_id"]: (r["status"], r["candidate_count"]) for r in Q.quote_status(quotes, paras).collect()}
    assert found == {1: ("ambiguous", 2), 2: ("ambiguous", 1), 3: ("ambiguous", 2), 4: ("empty", 0), 5: ("exact", 1), 6: ("not-found", 0)}


def test_bare_hits_and_what_comes_along(spark):
    """The scan takes away what the JVM's pattern does, over signs of all planes, and tells the columns asked for."""
    signs = "".join(map(chr, [*range(0x21, 0x30), *range(0xA1, 0xC0), *range(0x2000, 0x2BFF, 3), *range(0x3000, 0x3030), *range(0xFF00, 0xFFEF, 2), *range(0x1F300, 0x1F6FF, 5), 0x1FAE8, 0x10EAD]))
    texts = [f"ab{c}cd{c}ef" for c in signs] + ["abcdef", "a b c d e f", None, ""]
    paras = spark.createDataFrame([(f"p{i}", t, i) for i, t in enumerate(texts)], "locator string, text string, n int")
    quotes = spark.createDataFrame([(1, "abcdef"), (2, ""), (3, "cdef")], "item_id int, text string")
    stripped = paras.withColumn("text", X.strip_punctuation(X.normalize_search(F.col("text"))))
    want = sorted(map(tuple, Q.places(quotes, stripped, along=("n",)).select("item_id", "locator", "n").collect()))
    assert len(want) > 500 and all(loc == f"p{n}" for _, loc, n in want)
    for most in (Q.MOST_CHARS, 0):
        assert sorted(map(tuple, Q.places(quotes, paras, most, ("n",), True).select("item_id", "locator", "n").collect())) == want


def test_cascade_reads_paragraphs_once_a_tier(spark):
    """Notes found by the tiers before are stored, and hits are not joined with all paragraphs."""
    notes = spark.createDataFrame([(1, "the quick brown fox"), (2, "a line that stands; alone"), (3, "fuzzy matching needs some lunger sentence"), (4, "nothing of it")], "item_id int, text string")
    texts = ["The quick brown fox jumps", "A line that stands alone", "Fuzzy matching needs some longer sentence"]
    paras = spark.createDataFrame([(f"p{i}", 1, 1, i, t) for i, t in enumerate(texts)], "locator string, doc_id int, chapter int, paragraph_index int, text string")
    found = matching.cascade(notes, paras)
    assert {r["item_id"]: (r["status"], r["tier"], r["locator"]) for r in found.collect()} == {1: ("exact", "containment", "p0"), 2: ("high-confidence", "punctuation-insensitive", "p1"), 3: ("high-confidence", "fuzzy", "p2"), 4: ("not-found", None, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
