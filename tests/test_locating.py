"""Locating the notes of many books against a plain run of one note after the other."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest

from verdigris.operators import grams, locating

NOTES = "note_id bigint, book_id bigint, kind string, position int, quote string, chapter_uid bigint, chapter_title string, note_range string, edition string"
PARAS = "book_id bigint, chapter int, chapter_title string, paragraph_index int, locator string, text string"


def norm(s):
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", s or "").casefold())


def bare(s):
    return "".join(c for c in s if unicodedata.category(c)[0] not in "PS")


def start(r):
    m = re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", r or "")
    return int(m[1]) if m else None


def ratio(q, t):
    if not q or not t:
        return 0.0
    width = min(len(t), len(q) + max(4, len(q) // 5))
    return max(SequenceMatcher(None, q, t[s : s + width]).ratio() for s in {*range(0, len(t) - width + 1, max(1, len(q) // 6)), len(t) - width})


def one(note, book, title, anchor):
    """Status, tier, candidates, place and score of a note with an anchor (or None)."""
    q = norm(note["quote"])
    if note["edition"] == "mismatch":
        return "edition-mismatch", None, 0, None, None
    if not q:
        return "not-found", None, 0, None, None
    texts = [(p, norm(p["text"])) for p in book]
    by_title = lambda some: [p for p in some if norm(title) in norm(p["chapter_title"])] or some if title else some
    place = lambda some: some[0]["locator"] if len(some) == 1 else None
    found = by_title([p for p, t in texts if q in t])
    if found:
        ranged = []
        if anchor:
            a = norm(anchor["quote"])
            at = [p for p, t in texts if a and a in t]
            if len(found) > 1:
                found = [p for p in found if p in at] or found
            s, b = start(note["note_range"]), start(anchor["note_range"])
            if s is not None and b is not None and len(at) == 1:
                u = at[0]
                ranged = [p for p in found if (p["locator"] == u["locator"] if s == b else p["chapter"] == u["chapter"] and (p["paragraph_index"] > u["paragraph_index"]) == (s > b) and p["paragraph_index"] != u["paragraph_index"])]
                found = ranged or found
        status = "high-confidence" if ranged and len(found) == 1 else "exact" if len(found) == 1 and len(q) >= 6 else "ambiguous"
        return status, "containment", len(found), place(found), 0.99 if ranged else 1.0
    found = by_title([p for p, t in texts if bare(q) in bare(t)]) if len(bare(q)) >= 6 else []
    if found:
        return "high-confidence" if len(found) == 1 else "ambiguous", "punctuation-insensitive", len(found), place(found), 0.97
    scored = sorted(((-round(r, 4), p["locator"]) for p, t in texts if (r := ratio(q, t)) >= 0.88), key=lambda x: x) if len(q) >= 12 else []
    if not scored:
        return "not-found", None, 0, None, None
    top, nxt = -scored[0][0], -scored[1][0] if len(scored) > 1 else 0.0
    if top >= 0.94 and top - nxt >= 0.05:
        return "high-confidence", "fuzzy", 1, scored[0][1], top
    return "ambiguous", "fuzzy", len(scored), None, top


def plain(notes, paras):
    out = []
    for n in notes:
        book = [p for p in paras if p["book_id"] == n["book_id"]]
        if not n["quote"]:
            out.append((n["note_id"], "not-found", None, 0, None, None, None))
            continue
        anchors = [a for a in notes if a["book_id"] == n["book_id"] and a["kind"] == "review" and a["quote"] and a["chapter_uid"] == n["chapter_uid"] and start(a["note_range"]) is not None] if n["kind"] == "highlight" else []
        anchors.sort(key=lambda a: a["position"])
        if start(n["note_range"]) is not None:
            anchors.sort(key=lambda a: abs(start(n["note_range"]) - start(a["note_range"])))
        for a in anchors:
            got = one(n, book, n["chapter_title"], a)
            if got[0] in ("exact", "high-confidence"):
                out.append((n["note_id"], *got, a["note_id"]))
                break
        else:
            out.append((n["note_id"], *one(n, book, n["chapter_title"], None), None))
    return sorted(out)


def located(spark, notes, paras):
    names = [x.split()[0] for x in NOTES.split(", ")]
    rows = locating.locate_notes(spark.createDataFrame([tuple(n[c] for c in names) for n in notes], NOTES), spark.createDataFrame([tuple(p[x.split()[0]] for x in PARAS.split(", ")) for p in paras], PARAS)).collect()
    return sorted((r["note_id"], r["status"], r["tier"], r["candidate_count"], r["locator"], r["score"], r["anchor_id"]) for r in rows)


def library(seed, books=4):
    r = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma,", "delta.", "épée", "ｆｕｌｌ", "中文", "zeta!", "eta"]
    shared = [" ".join(r.choice(vocab) for _ in range(6)) for _ in range(4)]
    paras = []
    for b in range(books):
        for c in range(1, 4):
            for i in range(1, 7):
                text = r.choice(shared) if r.random() < 0.4 else " ".join(r.choice(vocab) for _ in range(r.randint(2, 12)))
                paras.append({"book_id": b, "chapter": c, "chapter_title": f"Chapter {c}", "paragraph_index": i, "locator": f"b{b}#ch-{c:03}:p-{i:04}", "text": text})
    notes = []
    for k in range(70):
        p = r.choice(paras)
        t = p["text"]
        a = r.randint(0, max(0, len(t) - 4))
        quote = r.choice([t, t[a : a + r.randint(1, 30)], t.replace(",", ";").replace(".", "!"), t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :], t[::-1], "", None, " ", ",.", "nowhere at all to be seen"])
        kind = r.choice(["highlight", "highlight", "review"])
        span = r.choice([f"{p['paragraph_index'] * 100}-{p['paragraph_index'] * 100 + 9}", f"{r.randint(0, 700)} - 9", None, "x"])
        notes.append({"note_id": k, "book_id": p["book_id"] if r.random() < 0.95 else 99, "kind": kind, "position": k, "quote": quote, "chapter_uid": r.choice([p["chapter"], p["chapter"], None]), "chapter_title": r.choice([None, f"chapter {p['chapter']}", "no such", ""]), "note_range": span, "edition": (None, "confirmed", None, "mismatch")[p["book_id"]]})
    return notes, paras


@pytest.mark.parametrize("seed", [1, 2])
def test_as_one_note_after_the_other(spark, seed):
    notes, paras = library(seed)
    got, want = located(spark, notes, paras), plain(notes, paras)
    assert got == want
    assert {x[1] for x in want} >= {"exact", "ambiguous", "high-confidence", "not-found", "edition-mismatch"} and any(x[6] is not None for x in want)


def test_large_books_and_chapters_are_dealt_out(spark, monkeypatch):
    notes, paras = library(3, books=1)
    want = plain(notes, paras)
    for name, most in (("NOTES_AT_ONCE", 4), ("PARAS_AT_ONCE", 3), ("QUOTES_AT_ONCE", 2)):
        monkeypatch.setattr(locating, name, most)
    assert located(spark, notes, paras) == want


def test_a_quote_in_two_books_is_exact_in_each(spark):
    paras = [{"book_id": b, "chapter": 1, "chapter_title": None, "paragraph_index": 1, "locator": f"b{b}", "text": "The very same sentence."} for b in (1, 2)]
    notes = [{"note_id": b, "book_id": b, "kind": "highlight", "position": 0, "quote": "very same", "chapter_uid": 1, "chapter_title": None, "note_range": None, "edition": None} for b in (1, 2, 3)]
    assert [x[:5] for x in located(spark, notes, paras)] == [(1, "exact", "containment", 1, "b1"), (2, "exact", "containment", 1, "b2"), (3, "not-found", None, 0, None)]


def test_texts_write_only_grams_that_are_asked_for(spark):
    quotes = spark.createDataFrame([("q", 7, "needle in hay"), ("s", 7, "zq")], "target string, seed bigint, norm string")
    texts = spark.createDataFrame([(f"l{i}", 7, "nothing of the kind " * 20) for i in range(30)] + [("hit", 7, "a needle in hay zq"), ("other", 8, "a needle in hay zq")], "locator string, seed bigint, norm string")
    assert sorted(map(tuple, grams.gram_hits(quotes, texts).collect())) == [("q", "hit"), ("s", "hit")]
    bits = bytearray(grams.BITMAPS * grams.BITS // 8)
    assert grams._held(texts, bytes(bits), [6]).count() == 0
    key = int(grams.gram_keys("needle", 6, 7)[0]) & (grams.BITMAPS * grams.BITS - 1)
    bits[key >> 3] |= 1 << (key & 7)
    assert [r["locator"] for r in grams._held(texts, bytes(bits), [6]).collect()] == ["hit"]


def test_books_of_few_paragraphs_write_no_grams(spark, monkeypatch):
    notes, paras = library(4)
    want, kinds, real = plain(notes, paras), [], grams.stored
    monkeypatch.setattr(grams, "stored", lambda df, kind="table": (kinds.append(kind), real(df, kind))[1])
    assert located(spark, notes, paras) == want
    assert not {"asked-grams", "held-grams"} & set(kinds)
    # Larger ones do, a bounded number at a time.
    monkeypatch.setattr(grams, "MOST_PAIRS", 50)
    monkeypatch.setattr(grams, "GRAMS_AT_ONCE", 5)
    assert located(spark, notes, paras) == want
    assert "held-grams" in kinds
