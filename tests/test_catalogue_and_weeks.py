"""Books in folders, and weeks in folders."""

import json

from pyspark.sql import functions as F

from verdigris.sources import catalogue, sinks

GOOD = "a" * 64


def test_books_of_a_folder_with_all_that_can_be_wrong(spark, tmp_path):
    root = tmp_path / "some.books"
    files = {
        "B two/book.yaml": f'stable_book_id: "{GOOD}"\nstatus: text-ready\ntitle: "Zwei: é"\nauthors:\n  - "A"\n  - B\nprovider:\n  book_id: "77"\n  mapping_status: confirmed\n  edition_status: mismatch\n', "B two/derived/analysis-state.json": json.dumps({"status": "discussion-ready", "chapters": {"coverage": 0.5}}),
        "a one/parsed/paragraphs.jsonl": "{}", "c/book.yaml": "title: null\nstatus: text-ready\n", "d/book.yaml": f"stable_book_id: {GOOD}\nstatus: odd\n", "e/book.yaml": f"stable_book_id: {GOOD}\nstatus: registered\n", "e/derived/analysis-state.json": "[1]",
        "f/book.yaml": f"stable_book_id: {GOOD}\nstatus: mismatch\nlanguage: ~\n", "f/deep/book.yaml": "status: not its own", "f/other/analysis-state.json": "not its own", "stray.txt": "x",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    rows = catalogue.scan_books(spark, f"file://{root}/").collect()
    assert [r["book_dir"] for r in rows] == ["a one", "B two", "c", "d", "e", "f"]
    by = {r["book_dir"]: r for r in rows}
    assert {k: r["local_error"] for k, r in by.items()} == {"a one": "header-missing", "B two": None, "c": "invalid-stable-id", "d": "invalid-text-status", "e": "invalid-analysis-state", "f": None}
    two = by["B two"]
    assert (two["stable_id"], two["title"], two["authors"], two["text_status"], two["analysis_status"], two["coverage"], two["provider_id"], two["mapping_status"], two["edition_status"]) == (GOOD, "Zwei: é", ["A", "B"], "text-ready", "discussion-ready", 0.5, "77", "confirmed", "mismatch")
    assert [(by[k]["text_status"], by[k]["analysis_status"], by[k]["coverage"], by[k]["title"]) for k in ("a one", "c", "e", "f")] == [("error", "failed", None, "a one"), ("error", "not-started", 0.0, "c"), ("registered", "failed", None, "e"), ("mismatch", "not-started", 0.0, "f")]


def events(spark):
    return spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_add("HOUR", (F.col("id") * 5).cast("int"), F.to_timestamp(F.lit("2023-12-30 00:00:00"))).alias("ts"))


def opened(df):
    """The week folders that a query's rows come from, and the filters on folders in its plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]


def test_a_window_opens_only_its_weeks(spark, tmp_path):
    path = str(tmp_path / "w")
    sinks.write_by_week(events(spark), "ts", path, 480)
    sinks.write_by_week(spark.createDataFrame([(1000, None)], "event_id bigint, ts timestamp"), "ts", path, 480)
    got = sinks.read_window(spark, path, "ts", "2024-01-08T00:00:00+08:00", "2024-01-15T00:00:00+08:00", 480)
    bounds = [F.to_timestamp(F.lit(x)) for x in ("2024-01-07 16:00:00", "2024-01-14 16:00:00")]
    want = events(spark).where((F.col("ts") >= bounds[0]) & (F.col("ts") < bounds[1]))
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect())
    edges = {r[0] for r in got.collect()}
    assert min(edges) == 42 and events(spark).where("event_id = 42").first()["ts"].isoformat() == "2024-01-07T18:00:00"
    assert "week" in opened(got) and "2024-W02" in opened(got)
    found = sinks.read_weeks(spark, path, spark.createDataFrame([("2024-W02",)], "week string"))
    shut = [p for p in (tmp_path / "w").glob("week=*") if "W02" not in p.name and "W03" not in p.name]
    for folder in shut:  # what is not opened may as well be broken
        for part in folder.glob("*.parquet"):
            part.write_bytes(b"broken")
            (folder / f".{part.name}.crc").unlink(missing_ok=True)
    assert {r[0] for r in got.collect()} == edges
    assert "dynamicpruning" in opened(found).lower() and {r[0] for r in found.select("event_id").collect()} == edges
