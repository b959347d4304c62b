"""E-books, files, the matching cascade and sinks on small fixtures, against plain versions."""

import io
import random
import unicodedata
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from verdigris.operators import chapters as H
from verdigris.operators import matching
from verdigris.operators import memory as M
from verdigris.operators import quotes as Q
from verdigris.operators import sessions as S
from verdigris.sources import epub, files, sinks


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


PACKAGE = '<package xmlns="x"><metadata><title>T</title><creator>A</creator></metadata><manifest><item id="n" href="nav.html" media-type="text/html" properties="x nav"/><item id="a" href="a.html" media-type="text/html"/><item id="b" href="b.html" media-type="application/xhtml+xml"/><item id="c" href="c.css" media-type="text/css"/></manifest><spine>{}</spine></package>'


def test_epub(spark, monkeypatch):
    docs = [("o/a.html", "<h1>One</h1><p>text"), ("o/b.html", "<?xml version='1.0' encoding='gb18030'?><p>书</p>".encode("gb18030")), ("o/nav.html", "<p>nav")]
    books = [
        ("spine.epub", _zip([("o/p.opf", PACKAGE.format('<itemref idref="b"/><itemref idref="a"/><itemref idref="b"/><itemref idref="z"/>')), *docs])),
        ("none.epub", _zip([("o/p.opf", PACKAGE.format("")), *docs])), ("up.epub", _zip([("../x.opf", PACKAGE)])), ("bad.epub", b"no zip"), ("empty.epub", None), ("a.txt", b"x"), ("broken.epub", _zip([("p.opf", "<a>")])),
    ]
    table = spark.createDataFrame(books, "path string, content binary")
    parts = epub.epub_parts(table)
    assert {r["path"]: r["reason"] for r in parts.where("status = 'rejected'").collect()} == {"up.epub": "unsafe-path", "bad.epub": "not-a-zip", "empty.epub": "not-a-zip", "a.txt": "not-an-epub", "broken.epub": "invalid-xml"}
    assert [(r["path"], r["id"]) for r in epub.reading_order(parts).orderBy("path", "spine_index").collect()] == [("none.epub", "a"), ("none.epub", "b"), ("spine.epub", "b"), ("spine.epub", "a")]
    found = [tuple(r)[2:] for r in epub.epub_documents(table).where("path = 'spine.epub'").orderBy("spine_index").collect()]
    assert found == [("o/b.html", None, False, ["书"]), ("o/a.html", "One", False, ["One", "text"])]
    assert epub.decode_xml("﻿é".encode()) == ("é", False) and epub.decode_xml(b"\xff\x81")[1] and epub.decode_xml("é".encode("utf-16"))[0] == "é"
    monkeypatch.setattr(epub, "MOST_MEMBERS", 1)
    with pytest.raises(epub.Refused, match="too-many-members"):
        epub.admitted(books[0][1])
    status = {r["path"]: r["status"] for r in files.import_status(table, epub.epub_documents(table), table.select("path")).collect()}
    assert status["spine.epub"] == "too-little-text" and status["a.txt"] == "imported"


def _norm(s):
    return "".join(unicodedata.normalize("NFKC", s or "").casefold().split())


def _bare(s):
    return "".join(c for c in s if unicodedata.category(c)[0] not in "PS")


def _ratio(q, t):
    width, step = min(len(t), len(q) + max(4, len(q) // 5)), max(1, len(q) // 6)
    return max(SequenceMatcher(None, q, t[s : s + width]).ratio() for s in {*range(0, len(t) - width + 1, step), len(t) - width})


def _start(x):
    a, _, b = (x or "").partition("-")
    return int(a) if a.strip().isdigit() and b.strip().isdigit() else None


def _plain_cascade(note, paras):
    """Status and places, straight from the rules."""
    text, title, beside, own_range, beside_range, edition = note
    if edition == "mismatch":
        return "edition-mismatch", 0, None
    q = _norm(text)
    if not q:
        return "not-found", 0, None
    keep = lambda hits, has: [p for p in hits if has(p)] or hits
    norm = lambda p: _norm(p["text"])
    titled = lambda hits: keep(hits, lambda p: title and _norm(title) in _norm(p["chapter_title"]))
    hits = titled([p for p in paras if q in norm(p)])
    if len(hits) > 1 and beside:
        hits = keep(hits, lambda p: _norm(beside) in norm(p))
    anchors = [p for p in paras if beside and _norm(beside) in norm(p)]
    if hits and len(anchors) == 1 and _start(own_range) is not None and _start(beside_range) is not None:
        side = (_start(own_range) > _start(beside_range)) - (_start(own_range) < _start(beside_range))
        a = anchors[0]
        there = [p for p in hits if (p["locator"] == a["locator"] if not side else p["chapter"] == a["chapter"] and (p["paragraph_index"] - a["paragraph_index"]) * side > 0)]
        if there:
            hits = there
            if len(there) == 1:
                return "high-confidence", 1, there[0]["locator"]
    if hits:
        return ("exact" if len(hits) == 1 and len(q) >= 6 else "ambiguous"), len(hits), hits[0]["locator"] if len(hits) == 1 else None
    loose = titled([p for p in paras if len(_bare(q)) >= 6 and _bare(q) in _bare(norm(p))])
    if loose:
        return ("high-confidence" if len(loose) == 1 else "ambiguous"), len(loose), loose[0]["locator"] if len(loose) == 1 else None
    near = sorted(((round(r, 4), p["locator"]) for p in paras if len(q) >= 12 and norm(p) and (r := _ratio(q, norm(p))) >= 0.88), reverse=True)
    if near:
        won = near[0][0] >= 0.94 and near[0][0] - (near[1][0] if len(near) > 1 else 0.0) >= 0.05
        return ("high-confidence", 1, near[0][1]) if won else ("ambiguous", len(near), None)
    return "not-found", 0, None


def test_cascade(spark):
    texts = [
        ("The quick brown fox jumps over the lazy dog, twice.", "One"), ("Once more: the quick brown fox jumps!", "Two"), ("A line that stands alone here; with punctuation.", "One"), ("abc", "One"), ("Straße und Ｆｕｌｌ width", "Two"),
        ("an anchor text of its own", "Two"), ("said again and again", "Two"), ("said again and again, beside it", "Two"), ("said again and again", "One"), ("Fuzzy matching needs some longer sentence to be found at all", "Two"), ("", "One"),
    ]
    paras = [{"locator": f"p{i:02}", "doc_id": 1, "chapter": 1 if t == "One" else 2, "paragraph_index": i, "chapter_title": t, "text": x} for i, (x, t) in enumerate(texts)]
    notes = [
        ("the quick brown fox jumps", None, None, None, None, None), ("the quick brown fox jumps", "Two", None, None, None, None), ("The quick brown fox jumps over", None, None, None, None, None), ("abc", None, None, None, None, None), ("", None, None, None, None, None),
        ("A line that stands, alone here with punctuation", None, None, None, None, None), ("the lazy dog", None, None, None, None, "mismatch"), ("STRASSE UND full", None, None, None, None, None), ("said again and again", None, "beside it", None, None, None),
        ("said again and again", None, "an anchor text", "90-95", "10-20", None), ("said again and again", None, "an anchor text", "1 - 5", "10-20", None), ("Fuzy matching needs some longer sentence to be fund at all", None, None, None, None, None), ("Fuzzy matching needs longer sentence to be found", None, None, None, None, None),
        ("nothing like this stands anywhere in it", None, None, None, None, None), ("again", "One", None, None, None, None), ("A line.that,stands", None, None, None, None, None), (None, None, None, None, None, None),
    ]
    schema = "item_id int, text string, chapter_title string, associated string, note_range string, associated_range string, edition string"
    table = spark.createDataFrame([(i, *n) for i, n in enumerate(notes)], schema)
    places = spark.createDataFrame([tuple(p.values()) for p in paras], "locator string, doc_id int, chapter int, paragraph_index int, chapter_title string, text string")
    want = {i: _plain_cascade(n, paras) for i, n in enumerate(notes)}
    for chars in (Q.MOST_CHARS, 0):
        got = {r["item_id"]: (r["status"], r["candidate_count"], r["locator"]) for r in matching.cascade(table, places, chars).collect()}
        assert got == want
    assert {"exact", "ambiguous", "high-confidence", "not-found", "edition-mismatch"} == {w[0] for w in want.values()}


def test_fuzzy_tier_loses_nothing(spark):
    """One edit in short quotes and edits spread over long ones, against every window of every text."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    texts = [" ".join(word() for _ in range(rng.choice([4, 30, 90]))) for _ in range(25)]
    quotes = []
    for t in texts:
        at = rng.randrange(max(1, len(t) - 60))
        q = list(t[at : at + rng.choice([16, 40, 200])])
        for i in range(rng.randrange(9), len(q), rng.choice([8, 12, 50])):
            q[i] = rng.choice(["", "x", q[i] + "y"])
        quotes.append("".join(q))
    quotes += ["thequickbrown", "abcdef1hijklm2opqrst3vwxyz"]
    texts += ["thequikcbrown", "abcdefghijklmnopqrstuvwxyz"]
    want = {(i, j): round(r, 4) for i, q in enumerate(map(_norm, quotes)) for j, t in enumerate(map(_norm, texts)) if len(q) >= 12 and (r := _ratio(q, t)) >= 0.88}
    found = Q.quote_fuzzy(spark.createDataFrame(list(enumerate(quotes)), "item_id int, text string"), spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "locator string, text string"), kept=1000)
    assert {(r["item_id"], int(r["locator"])): r["score"] for r in found.collect()} == want and len(want) > 8


def test_long_lines_are_cut_at_sentences(spark):
    text = "a" * 7000 + ". " + "b" * 3000
    rows = [r["text"] for r in H.segment_chapters(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("paragraph_index").collect()]
    assert rows == ["a" * 7000 + ".", "b" * 3000]


def test_weeks():
    assert S.week_bounds("2020-W53", 480) == ("2020-12-27T16:00:00Z", "2021-01-03T16:00:00Z") and S.week_bounds("2021-W01") == ("2021-01-04T00:00:00Z", "2021-01-11T00:00:00Z")
    for bad in ("2021-1", "2021-W54"):
        with pytest.raises(ValueError):
            S.week_bounds(bad)


def test_strict_streams(spark):
    sha = F.sha2("content", 256)
    rows = [
        ("a", 1, "e1", "candidate", None, None, "candidate", "x"), ("a", 2, "e2", "decision", "confirm", "candidate", "confirmed", "x"), ("b", 1, "e3", "decision", "confirm", "candidate", "confirmed", "x"), ("c", 1, "e4", "candidate", None, None, "candidate", "x"), ("c", 2, "e4", "candidate", None, None, "candidate", "x"),
        ("d", 1, "e5", "candidate", None, None, "candidate", "x"), ("d", 2, "e6", "decision", "retire", "candidate", "retired", "x"), ("d", 3, "e7", "candidate", None, None, "candidate", "x"), ("f", 1, None, "candidate", None, None, "candidate", "x"), ("g", 1, "e8", "candidate", None, None, "confirmed", "x"),
    ]
    events = spark.createDataFrame(rows, "item string, seq int, event_id string, kind string, decision string, from_status string, to_status string, content string").withColumn("content_sha256", sha)
    found = {(r["item"], r["seq"]): r["problem"] for r in M.violations(events).collect()}
    assert found == {("b", 1): "decision-without-candidate", ("c", 1): "event-id-not-unique", ("c", 2): "event-id-not-unique", ("d", 2): "transition", ("d", 3): "second-candidate", ("f", 1): "event-id-not-unique", ("g", 1): "bad-start"}
    assert [tuple(r) for r in M.states(events).collect()] == [("a", "confirmed", "x", "e2")]


def test_publication(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    with pytest.raises(ValueError):
        sinks.publish(df, str(tmp_path / "out"), F.col("v").isNotNull(), str(tmp_path / "stage"))
    assert not (tmp_path / "out").exists()
    assert sinks.publish(df.where("k = 1"), str(tmp_path / "out"), F.col("v").isNotNull(), str(tmp_path / "stage")) == 1
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.publish(df.where("k = 1"), str(tmp_path / "out"), F.lit(True), str(tmp_path / "stage"))
    row = spark.range(1).select(sinks.failure_row(F.lit("k"), F.array(F.lit("one"), F.lit("password = abc"))).alias("x")).first()["x"]
    assert row["message"] == "withheld" and sinks.markdown_head(["a", "b"]) == "| a | b |\n|---|---|"
