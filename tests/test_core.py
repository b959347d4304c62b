import pytest
from pyspark.sql import functions as F

from oracle import spark_rows, sql_rows
from verdigris.functions import text as X
from verdigris.operators import chapters as H
from verdigris.operators import documents as D
from verdigris.operators import events as E
from verdigris.operators import evidence as V
from verdigris.operators import quotes as Q
from verdigris.plans.queries import ORACLE_SQL, QUERIES
from verdigris.sources.encodings import detect, detect_encodings
from verdigris.sources.html import blocks_of, html_blocks
from verdigris.sources.jsonl import append_new, read_lenient
from verdigris.streaming import folds

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(ORACLE_SQL[name], SF)


def test_quotes_are_found_alike_by_scan_and_by_gram(spark):
    quotes = spark.createDataFrame([(1, "the same words"), (2, "The Same  words"), (3, "words again"), (4, "short"), (5, None), (6, "nowhere to be seen")], "item_id int, text string")
    paras = spark.createDataFrame([("a", "x the same words again"), ("a2", "the samewords"), ("b", ""), ("c", None), ("d", "words again, words again"), ("d", "words again, words again")], "locator string, text string")
    found = [sorted(map(tuple, Q.quote_hits(quotes, paras, most_chars=n).collect())) for n in (Q.MOST_CHARS, 0)]
    assert found[0] == found[1] == [(1, "a"), (1, "a2"), (2, "a"), (2, "a2"), (3, "a"), (3, "d")]
    assert Q.quote_hits(quotes.where("item_id > 3"), paras).count() == 0


def test_html_blocks(spark):
    """One case for each rule of a block."""
    assert blocks_of("<p>a<p>b<br>c<script>var t='</p>'</script>d</p>x") == [("p", "a"), ("p", "b\ncd")]
    assert blocks_of("just <b>text</b>\n and\tmore") == [("p", "just text\nand more")]
    assert blocks_of("<ul><li>one<li>two</ul><head><p>no</p></head>") == [("li", "one"), ("li", "two")]
    assert blocks_of("<p>a</li>b</p><svg><p>x</p></svg>") == [("p", "ab")] and blocks_of("<p> </p>all &amp; one") == [("p", "all & one")]
    assert blocks_of("<svg><svg></svg><p>in</p></svg><p>out</p></script><p>on</p>") == [("p", "out"), ("p", "on")] and blocks_of("") == []
    pages = spark.createDataFrame([(1, "<h1>T</h1><p>x"), (2, None), (None, "y")], "page_id int, html string")
    assert sorted(map(tuple, html_blocks(pages).collect()), key=str) == [(1, 0, "h1", "T"), (1, 1, "p", "x"), (None, 0, "p", "y")]


def test_scalar_functions(spark):
    row = spark.range(1).select(
        X.clean_display(F.lit(" a\t b \r\n\n c")).alias("clean"), X.normalize_search(F.lit("Straße X")).alias("search"), X.excerpt(F.lit("x" * 181)).alias("cut"),
        X.isbn_digits(F.array(F.lit("x"), F.lit("978-3-16-148410-0"))).alias("isbn"), X.range_start(F.lit("12-30")).alias("start"), X.range_start(F.lit("")).alias("none"),
        X.strict_timestamp(F.lit("2024-01-01T00:00:00")).alias("naive"), X.is_heading(F.lit("Chapter 12")).alias("heading"), X.is_heading(F.lit("Chapter 12 ends.")).alias("sentence"),
        X.title_forms(F.lit("One: Two")).alias("forms"), X.authors_match(F.lit("A. Bee"), F.array(F.lit(""), F.lit("abee"))).alias("author"), X.contains_secret(F.lit("api_key = abcdef123")).alias("secret"),
        X.normalize_search(F.lit("Ｆｕｌｌ　ｗｉｄｔｈ ﬁne…")).alias("wide"), X.normalize_key(F.lit("Dune: Ｍ-ß_1")).alias("key"), X.range_start(F.lit(" 7 - 9 ")).alias("blanks"), X.is_heading(F.lit("introduction")).alias("intro"),
    ).first()
    assert row["clean"] == "a b\nc" and row["search"] == "strassex" and len(row["cut"]) == 180 and row["isbn"] == "9783161484100"
    assert row["wide"] == "fullwidthfine..." and row["key"] == "dunemss1" and row["blanks"] == 7 and not row["intro"]
    assert row["start"] == 12 and row["none"] is None and row["naive"] is None and row["heading"] and not row["sentence"]
    assert sorted(row["forms"]) == ["one", "onetwo"] and row["author"] and row["secret"]


def test_vectorised_functions(spark):
    df = spark.createDataFrame([("abcdef", "xxabcdefyy", '{"b":1,"a":"é"}', "a" * 9000)], "q string, t string, j string, long string")
    row = df.select(X.partial_similarity_udf("q", "t").alias("s"), X.canonical_json_udf("j").alias("j"), X.split_long_udf("long").alias("p")).first()
    assert 0.7 < row["s"] <= 1 and row["j"] == '{"a":"é","b":1}' and [len(x) for x in row["p"]] == [8000, 1000]


def test_folds_count_illegal_steps(spark):
    rows = [("x", 1, "confirm"), ("x", 2, "confirm"), ("x", 3, "retire"), ("y", 1, "retire")]
    out = {r["k"]: (r["state"], r["applied"], r["illegal"]) for r in E.fold(spark.createDataFrame(rows, "k string, seq int, d string"), "k", "seq", "d", E.PROFILE_STEPS).collect()}
    assert out == {"x": ("retired", 2, 1), "y": ("candidate", 0, 1)}
    many = spark.createDataFrame([("k", i, ("confirm", "revise", "reject", "retire")[i * i % 3 % 4]) for i in range(100)], "k string, seq int, d string")
    assert len({tuple(E.fold(many, "k", "seq", "d", E.BELIEF_STEPS, block=b).first()) for b in (1, 7, 1000)}) == 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"event_id":"a"}\nnot json\n\n{"event_id":"b"}\n')
    good, bad = read_lenient(spark, str(tmp_path / "in.jsonl"), "event_id string")
    assert sorted(r[0] for r in good.collect()) == ["a", "b"] and bad.count() == 1
    for _ in range(2):
        append_new(good.unionByName(good), str(tmp_path / "log"))
    assert spark.read.schema("event_id string").json(str(tmp_path / "log")).count() == 2


def test_encodings(spark):
    chinese = "第一章。这是中文的正文，在书和节里。" * 20
    files = [("a", "plain é".encode()), ("b", "\ufeffmarked".encode()), ("c", "two".encode("utf-16")), ("d", chinese.encode("gb18030")), ("e", b"x\0y"), ("f", b"\xff\xfe\xff"), ("g", b"\x81"), ("h", None)]
    found = {r["path"]: (r["status"], r["encoding"], r["confidence"]) for r in detect_encodings(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert found["a"] == found["h"] == ("detected", "utf-8", "high") and found["b"] == ("detected", "utf-8-sig", "bom") and found["c"] == ("detected", "utf-16", "bom")
    assert found["d"][1:] == ("gb18030", "medium") and found["e"][0] == found["f"][0] == found["g"][0] == "rejected"
    assert detect(b"abc", "latin-1")[1:3] == ("iso8859-1", "explicit") and detect(b"abc", "no such")[4] == "unknown-encoding" and detect(b"\xe9", "utf-8")[4] == "not-in-told-encoding"


def test_narrowing(spark):
    candidates = spark.createDataFrame([(1, "a", "one two"), (1, "b", "one"), (2, "c", "x"), (2, "d", "y"), (3, "e", "z")], "note_id int, locator string, text string")
    notes = spark.createDataFrame([(1, "T wo"), (2, "two"), (3, None)], "note_id int, associated string")
    assert sorted(r["locator"] for r in V.narrow_by_associated(candidates, notes).collect()) == ["a", "c", "d", "e"]
    places = spark.createDataFrame([(1, 1, 1, i, f"p{i}") for i in range(1, 5)] + [(1, 1, 2, 1, "q")] + [(2, 2, 1, i, f"r{i}") for i in (1, 2)], "note_id int, doc_id int, chapter int, paragraph_index int, locator string")
    ranges = spark.createDataFrame([(1, 9, 5), (2, 1, 5)], "note_id int, note_start int, anchor_start int")
    assert sorted(r["locator"] for r in V.narrow_by_order(places, ranges, places.where("locator in ('p2', 'r1', 'r2')")).collect()) == ["p3", "p4"]


def test_nearest_anchor(spark):
    notes = spark.createDataFrame([(1, 1, 10), (2, 1, 0), (3, 2, 5), (4, 1, None)], "note_id int, chapter int, start int")
    anchors = spark.createDataFrame([(7, 1, 8), (6, 1, 12), (5, 1, 12), (9, 1, None)], "anchor_id int, chapter int, start int")
    assert sorted(map(tuple, V.nearest_anchor(notes, anchors).collect())) == [(1, 5, 2), (2, 7, 8)]


def test_streams_agree_with_tables(spark, tmp_path):
    rows = spark.sql("select * from values ('a', 'x', timestamp'2024-01-01 10:00:00'), ('a', 'x', timestamp'2024-01-01 10:00:00'), ('b', 'y', timestamp'2024-01-07 23:00:00'), ('c', 'x', timestamp'2024-01-08 00:00:00'), ('d', 'x', timestamp'2024-02-01 00:00:00') as t(event_id, event_type, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, made in (("ids", folds.deduplicated(stream)), ("weeks", folds.weekly_counts(stream))):
        made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("ids").collect()) == ["a", "b", "c", "d"]
    closed = {(str(r["week"]), r["event_type"]): r["events"] for r in spark.table("weeks").collect()}
    assert closed == {("2024-01-01", "x"): 2, ("2024-01-01", "y"): 1, ("2024-01-08", "x"): 1}


def test_chapters_are_cut_at_headings_and_limits(spark):
    text = "before\n\nChapter 1\n" + "a" * 25 + "\nx\ny\nz\n序言\nlast"
    docs = spark.createDataFrame([(1, text), (2, "one\rtwo"), (3, None), (4, " \n ")], "doc_id int, text string")
    found = [tuple(r)[:6] for r in H.segment_chapters(docs, 30, 3, 10).orderBy("doc_id", "chapter", "paragraph_index").collect()]
    assert [r[1:] for r in found if r[0] == 1] == [
        (1, 1, H.PREFACE, 1, "before"), (3, 2, "Chapter 1", 1, "Chapter 1"), (4, 2, "Chapter 1", 2, "a" * 10), (4, 2, "Chapter 1", 3, "a" * 10),
        (4, 3, H.CONTINUED.format("Chapter 1", 2), 1, "a" * 5), (5, 3, H.CONTINUED.format("Chapter 1", 2), 2, "x"), (6, 3, H.CONTINUED.format("Chapter 1", 2), 3, "y"),
        (7, 4, H.CONTINUED.format("Chapter 1", 3), 1, "z"), (8, 5, "序言", 1, "序言"), (9, 5, "序言", 2, "last"),
    ]
    assert [r[1:] for r in found if r[0] != 1] == [(1, 1, H.UNTITLED, 1, "one"), (2, 1, H.UNTITLED, 2, "two")]
    text_back = {r["doc_id"]: r["t"] for r in H.segment_chapters(spark.read.parquet(f"{SF}/documents.parquet")).groupBy("doc_id").agg(F.sum(F.length("text")).alias("t")).collect()}
    assert text_back == {r["doc_id"]: r["t"] for r in D.paragraphs(spark.read.parquet(f"{SF}/documents.parquet")).groupBy("doc_id").agg(F.sum(F.length("text")).alias("t")).collect()}


def test_skipped_samples_are_replaced_by_the_nearest(spark):
    paras = spark.createDataFrame([(1, 1, i + 1, f"p{i}") for i in range(20)] + [(2, 1, 1, "q0")], "doc_id int, chapter int, paragraph_index int, locator string")
    analysed = spark.createDataFrame([(f"p{i}", None if i in (1, 3, 10) else "t") for i in range(20)] + [("q0", None)], "locator string, analysis_text string")
    found = {r["locator"]: r["replacement"] for r in H.sample_with_replacement(paras, analysed).collect()}
    same = {f"p{i}": f"p{i}" for i in (0, 2, 9, 11, 16, 17, 18, 19)}
    assert found == same | {"p1": "p2", "p3": "p4", "p10": "p11", "q0": None}  # p11 is only taken by itself later


def test_fuzzy_tier_against_all_paragraphs(spark):
    quotes = spark.createDataFrame([(1, "the quick brown fox jumps over the dog"), (2, "entirely other words stand here now"), (3, "too short")], "item_id int, text string")
    texts = {"a": "So the quick brown fox jumped over the dog, they say.", "b": "the quick brown fox jumps over the dog", "c": "nothing of the kind is written here", "d": "entirely other words stood here now"}
    paras = spark.createDataFrame(list(texts.items()), "locator string, text string")
    found = {(r["item_id"], r["locator"]): (r["score"], r["rank"], r["accepted"]) for r in Q.quote_fuzzy(quotes, paras).collect()}
    pairs = quotes.where("item_id < 3").crossJoin(paras).select("item_id", "locator", X.partial_similarity_udf(X.normalize_search(quotes["text"]), X.normalize_search(paras["text"])).alias("raw")).where("raw >= 0.88")
    assert {k: v[0] for k, v in found.items()} == {(r["item_id"], r["locator"]): round(r["raw"], 4) for r in pairs.collect()}
    assert found[(1, "b")][:2] == (1.0, 1) and set(found) >= {(1, "b"), (2, "d")}
