"""Quality rules by distribution divergence.

A document's character-class and common-word histograms are compared to those of its language by Jensen-Shannon
distance. Every figure of a document is computed inside its own row by built-in functions; the references are
sums over the whole corpus, a fixed number of figures per named language, and become literals of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, text_or_empty, words

#: Frequent function words of the languages that have a reference of their own, as many of each.
COMMON_WORDS = {
    "de": "der die das und in zu den ist von mit nicht ein",
    "en": "the of and to in is that for with as on was",
    "es": "de la el que y en los del las un por con",
    "fr": "de la le les des et un une du dans est pour",
}
#: Character classes counted one by one; lower-case ASCII letters, white space and all others come on top.
CHAR_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-", "#*$%&|<>", "@^_~=+/\\[]{}`")
BLANK = " \t\n\x0b\x0c\r"
#: Word windows with their places are packed into one number each: 40 bits of hash, 24 of place.
PLACE_BITS = 24


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _group(lang: str) -> Column:
    """The language, if it has word lists here, else the group of all others (which has the English list)."""
    return F.when(F.col(lang).isin(*sorted(COMMON_WORDS)), F.col(lang)).otherwise(F.lit("other"))


def _list(lang: Column) -> Column:
    out = F.array(*map(F.lit, COMMON_WORDS["en"].split()))
    for name, listed in COMMON_WORDS.items():
        out = F.when(lang == name, F.array(*map(F.lit, listed.split()))).otherwise(out)
    return out


def _measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Words, base figures but for repeats, and both histograms as arrays of counts. Each step's columns are used more than once by the next, so that Spark computes them once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _group(lang_col).alias("__lang"), text_or_empty(text_col).alias("__text"))
    rows = rows.withColumns({"__words": words(F.col("__text")), "__rest": F.regexp_replace("__text", f"[a-z{SPACE}]+", ""), "__list": _list(F.col("__lang"))})
    rows = rows.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.aggregate("__words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
        "__hits": F.filter("__words", lambda w: F.array_contains(F.col("__list"), w)),
        "__classes": F.array(*[(F.length("__rest") - F.length(_without(F.col("__rest"), chars))).cast("long") for chars in CHAR_CLASSES]),
    })
    known = F.aggregate("__classes", F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.withColumns({
        "__chars": F.concat("__classes", F.array(F.col("word_chars") - F.length("__rest"), F.length("__text") - F.col("word_chars"), F.length("__rest") - known)),
        "__counts": F.concat(F.transform("__list", lambda k: F.size(F.filter("__hits", lambda w: w == k)).cast("long")), F.array(F.col("n_words") - F.size("__hits"))),
    })


def _references(rows: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """Histograms summed over all documents of each language: at most one small row for each list and ``other``."""
    n, m = len(CHAR_CLASSES) + 3, len(COMMON_WORDS["en"].split()) + 1
    every = rows.select("__lang", F.concat("__chars", "__counts").alias("__all"))
    found = every.groupBy("__lang").agg(*[F.sum(F.get("__all", F.lit(i))).alias(f"x{i}") for i in range(n + m)]).collect()
    return {r["__lang"]: ([r[f"x{i}"] for i in range(n)], [r[f"x{i}"] for i in range(n, n + m)]) for r in found}


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[list[int], list[int]]]:
    """The references of a corpus, to be given to ``quality_rules`` for other documents."""
    return _references(_measured(docs.withColumn("__none", F.lit(0)), "__none", text_col, lang_col))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a count array to shares that sum to 1; 0 if the array has no counts."""
    total = F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    both = lambda x, r: part(x, (x + r) / 2) + part(r, (x + r) / 2)
    summed = F.aggregate(F.zip_with(p, q, lambda x, r: both(x / total, r)), F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.sqrt(F.greatest(summed / 2, F.lit(0.0)))).otherwise(F.lit(0.0))


def _window_hash(*words_: Column) -> Column:
    return F.xxhash64(*words_)


def _repeat_words() -> Column:
    """How many words stand in 3-word windows that occur twice or more.

    Windows are sorted by hash and place; neighbours of equal hash are compared word by word. Where two of them
    differ, hashes have met by chance, and that text's windows are sorted as they are, as are those of a text of
    more words than a place can number.
    """
    w = F.col("__words")
    starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    packed = F.sort_array(F.transform(starts, lambda x, i: F.shiftleft(_window_hash(x, F.get(w, i + 1), F.get(w, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long"))))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    words_equal = lambda a, b: (F.get(w, a) == F.get(w, b)) & (F.get(w, a + 1) == F.get(w, b + 1)) & (F.get(w, a + 2) == F.get(w, b + 2))
    near = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.shiftright(F.get(s, i).bitwiseXOR(F.get(s, i + 1)), PLACE_BITS) == 0)
    pairs = lambda s: F.transform(near(s), lambda i: F.array(place(F.get(s, i)), place(F.get(s, i + 1))))
    alike = lambda ps: F.when(F.forall(ps, lambda p: words_equal(p[0], p[1])), F.flatten(ps))
    short = F.get(F.transform(F.array(packed), lambda s: F.get(F.transform(F.array(pairs(s)), alike), F.lit(0))), F.lit(0))
    exact = F.sort_array(F.transform(starts, lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))
    same_text = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.get(s, i)["g"] == F.get(s, i + 1)["g"])
    long = F.get(F.transform(F.array(exact), lambda s: F.flatten(F.transform(same_text(s), lambda i: F.array(F.get(s, i)["i"], F.get(s, i + 1)["i"])))), F.lit(0))
    found = F.when(F.size(w) < 4, F.expr("cast(array() as array<int>)")).when(F.size(w) < (1 << PLACE_BITS), F.coalesce(short, long)).otherwise(long)
    return F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2))))).cast("long")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, max_repeat_percent: int = 50,
    max_char_distance: float = 0.26, max_word_distance: float = 0.25, guard_words: int = 80, references: dict[str, tuple[list[int], list[int]]] | None = None,
) -> DataFrame:
    """One row per input row: the base figures, both distances, and the verdict ``kept``.

    Null text has no words. A null or unnamed language is compared to the reference of all such documents. Texts
    under ``guard_words`` words have too few counts for a histogram and are judged by the base rules alone. About 84 %
    of a language's words are none of its common words, so a text with none of them is only 0.29 to 0.30 away from
    its reference; ``max_word_distance`` is below that and above all but one of the documents labelled good. Equal
    and repeated rows get equal figures; an empty table gives an empty result; other columns are never read.
    """
    rows = _measured(docs, id_col, text_col, lang_col).withColumns({"__lines": F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != ""), "n_repeat_words": _repeat_words()})
    rows = rows.select(
        "doc_id", "__lang", "n_words", "word_chars", F.get("__classes", F.lit(CHAR_CLASSES.index("#*$%&|<>"))).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", "__chars", "__counts",
    )
    if references is None:
        rows = cut(rows)  # texts are read once: what follows needs a few numbers of each
        references = _references(rows)
    n, m = len(CHAR_CLASSES) + 3, len(COMMON_WORDS["en"].split()) + 1

    def reference(k: int, size: int) -> Column:
        out = F.array(*[F.lit(0.0)] * size)
        for lang, hists in sorted(references.items()):
            out = F.when(F.col("__lang") == lang, F.array(*[F.lit(x / max(1, sum(hists[k]))) for x in hists[k]])).otherwise(out)
        return out

    rows = rows.withColumns({"char_distance": _distance(F.col("__chars"), reference(0, n)), "word_distance": _distance(F.col("__counts"), reference(1, m))})
    rows = rows.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    usual = (F.col("n_words") < guard_words) | ((F.col("char_distance") <= max_char_distance) & (F.col("word_distance") <= max_word_distance))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & usual).alias("kept"), "char_distance", "word_distance")


def op8_query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
