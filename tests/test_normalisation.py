"""Normalisation against Python's own, over all of Unicode and in company."""

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from verdigris.functions import text as X


def search(s):
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", s).casefold())


def key(s):
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", s).casefold())


def test_stable_characters_are_stable():
    """What the pattern lets pass is in NFKC in any company, and folded by its small letter (but for the two that are replaced)."""
    stable = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), X.STABLE))
    seconds = {d.split()[1] for c in map(chr, range(sys.maxunicode + 1)) if (d := unicodedata.decomposition(c)) and not d.startswith("<") and " " in d}
    for c in map(chr, range(sys.maxunicode + 1)):
        if stable.fullmatch(c):
            assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and f"{ord(c):04X}" not in seconds, hex(ord(c))
            assert c.casefold() == c.lower().replace("ß", "ss").replace("ς", "σ"), hex(ord(c))


def test_all_of_unicode(spark):
    """Every character by itself, after a letter, before a mark, and before a Hangul vowel."""
    codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    frame = spark.createDataFrame(pd.DataFrame({"c": list(map(chr, codes))})).repartition(4)
    texts = frame.select(F.explode(F.array("c", F.concat(F.lit("a"), "c"), F.concat("c", F.lit("\u0323\u0301")), F.concat("c", F.lit("\u1161\u11a8")))).alias("t"))

    def plain(t: pd.Series) -> pd.Series:
        return t.map(lambda s: "".join(unicodedata.normalize("NFKC", s).casefold().split()))

    want = F.pandas_udf(plain, "string")
    bad = texts.select("t", X.normalize_search(F.col("t")).alias("got"), want("t").alias("want")).where("got <> want").collect()
    assert not bad, [(r["t"].encode("unicode_escape"), r["got"], r["want"]) for r in bad[:10]]


def test_keys_in_company(spark):
    texts = ["Ｄune: ﬁ①Ⅻ㈱㍿ﷺ", "cafe\u0301 ka\u3099 ｶﾞｷﾞ", "𝓜𝒶𝓽𝔥 𝐁old ℌ", "Straße ΣΊΣΥΦΟΣ ς", "\u1100\u1161\u11a8 각", "x\u0323\u0301 \u1e69 \u212b", "", "İstanbul", "_a_ b\x1c\x85c\u2003d", "½ ⑫ ㎏"]
    rows = spark.createDataFrame([(t, [t, None, "plain"]) for t in texts], "t string, ts array<string>").select("t", X.normalize_key(F.col("t")).alias("key"), X.normalize_search(F.col("t")).alias("search"), X.normalize_keys(F.col("ts")).alias("keys")).collect()
    for r in rows:
        assert (r["key"], r["search"], r["keys"]) == (key(r["t"]), search(r["t"]), [key(r["t"]), "", "plain"])


def test_only_unstable_texts_go_through_arrow(spark):
    """Of a stable text the function gets a null."""
    seen = spark.createDataFrame([("plain text",), ("e\u0301",), (None,)], "t string").select(F.when(~F.rlike("t", F.lit(X.STABLE)), F.col("t")).alias("sent")).collect()
    assert [r["sent"] for r in seen] == [None, "e\u0301", None]
