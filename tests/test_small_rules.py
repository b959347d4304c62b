"""Rules of single values that are easily got wrong."""

import json
import random

from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.operators import discovery as R


def test_one_decimal_is_the_exact_values(spark):
    r = random.Random(1)
    values = [50.25, 0.25, 0.35, 0.45, 0.15, 99.95, 0.05, 0.0, 100.0, 7.75, 2.675, 1e-9, 33.3, -0.25, -3.14] + [r.randint(0, 2000) / 20 for _ in range(300)] + [r.random() * 100 for _ in range(500)] + [round(r.random() * 100, 2) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.one_decimal(F.col("v")).alias("t")).collect()
    for row in rows:
        want = f"{row['v']:.1f}".rstrip("0").rstrip(".")
        assert row["t"] == want, row


def test_ratings(spark):
    rows = spark.createDataFrame([("50.25", 3), ("502.5", None), ("bad", 1), (None, 1)], "r string, n int").select(X.rating_text(F.col("r"), F.col("n")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["50.2/100（3 人评分）", "50.2/100", "暂无评分", "暂无评分"]


def test_truth_of_texts_and_numbers(spark):
    row = spark.sql("select '2' a, ' Yes\t' b, '1' c, '0' d, 2 e, 0.0 f, true g, cast(null as string) h, '1.0' i").select(*[X.is_truthy(F.col(c)).alias(c) for c in "abcdefghi"]).first()
    assert list(row) == [False, True, True, False, True, False, True, False, False]


def test_ranges_in_any_digits(spark):
    rows = spark.createDataFrame([("１２ - ３０",), ("٣-٥",), ("5 -",), (" 7-9",), (None,)], "r string").select(X.range_start(F.col("r")).alias("s")).collect()
    assert [r["s"] for r in rows] == [12, 3, None, 7, None]


def test_names_of_fields_claim_nothing(spark):
    row = spark.sql("""select named_struct('逐字读完', 'no', 'b', 1) a, named_struct('x', array('已逐字读完')) b, named_struct('x', '"逐字读完":') c, map('全书100%', 'n') d""").select(*[X.claims_too_much(F.col(c)).alias(c) for c in "abcd"]).first()
    assert list(row) == [False, True, True, False]


def test_the_last_of_equal_titles_counts(spark):
    text = "# t\n## One\n- a\n## Two \nbody\nmore\n\n## One\n\n- b\n- c\n##\n\nempty title\n## \tLast"
    row = spark.createDataFrame([(text,)], "t string").select(X.markdown_sections(F.col("t")).alias("m")).first()
    assert row["m"] == {"Two": ["body\nmore"], "One": ["b", "c"], "empty title": [], "Last": []}


def test_an_outer_null_wins_over_a_nested_value(spark):
    raws = [{"bookId": "1", "title": "t", "author": None, "bookInfo": {"author": "in", "soldout": "2"}}, {"bookInfo": {"bookId": 2, "title": "u", "soldout": 2}}, {"book": {"bookInfo": {"bookId": "3", "title": "v", "author": "deep", "soldout": "yes"}}, "title": None}, {"book": {"bookInfo": {"bookId": "4", "title": "w", "soldout": True}}}]
    rows = R.candidates(spark.createDataFrame([(json.dumps(x), i, "f") for i, x in enumerate(raws)], "raw string, position int, feed string")).orderBy("position").collect()
    assert [(r["book_id"], r["author"], r["sold_out"]) for r in rows] == [("1", "", False), ("2", "", True), ("4", "", True)]
