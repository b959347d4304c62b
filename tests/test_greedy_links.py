"""Links in shelf order, against a walk along the shelf."""

import random

import pytest

from verdigris.operators import library as L

SHELF = "kind string, item_id string, title string, author string, shelf_order int"
LOCAL = "stable_id string, title string, authors array<string>, provider_id string, text_status string"


def key(s):
    return "".join(c for c in s.casefold() if c.isalnum())


def walked(shelf, local):
    used, out = set(), []
    claims = {x[3]: x[0] for x in local if x[3]}
    for kind, item, title, author, _ in sorted(shelf, key=lambda x: x[4]):
        if kind != "book":
            continue
        if item in claims:
            used.add(claims[item])
            continue
        fits = {}
        for sid, t, authors, _, status in local:
            names = [key(a) for a in authors if key(a)]
            if sid is None or sid in used or status == "error" or not key(author) or not any(n in key(author) or key(author) in n for n in names):
                continue
            if key(title) == key(t):
                fits[sid] = "exact-title-author"
            elif key(title) and key(title) == key(t.split(":")[0]):
                fits[sid] = "base-title-author"
        if len(fits) == 1:
            ((sid, basis),) = fits.items()
            used.add(sid)
            out.append((item, sid, basis))
    return sorted(out)


def linked(spark, shelf, local):
    s, lo = spark.createDataFrame(shelf, SHELF), spark.createDataFrame(local, LOCAL)
    return sorted(map(tuple, L.candidate_links(s, lo, L.direct_links(s, lo)).collect()))


def test_the_second_entry_gets_what_the_first_has_left(spark):
    local = [("F", "Dune", ["Frank"], None, "ok"), ("J", "Dune", ["Junior"], None, "ok")]
    shelf = [("book", "1", "Dune", "Frank", 1), ("book", "2", "Dune", "Frank Junior", 2), ("book", "3", "Dune", "Junior", 3)]
    assert linked(spark, shelf, local) == walked(shelf, local) == [("1", "F", "exact-title-author"), ("2", "J", "exact-title-author")]
    assert linked(spark, [(k, i, t, a, 10 - o) for k, i, t, a, o in shelf], local) == [("2", "F", "exact-title-author"), ("3", "J", "exact-title-author")]


def test_a_direct_link_takes_its_book_only_from_there_on(spark):
    local = [("D", "Dune", ["Frank"], "5", "ok")]
    for order, want in ((1, [("9", "D", "exact-title-author")]), (7, [])):
        shelf = [("book", "5", "other", "x", 4), ("book", "9", "Dune", "Frank", order)]
        assert linked(spark, shelf, local) == walked(shelf, local) == want


def test_one_title_on_very_many_entries_needs_few_rounds(spark, monkeypatch):
    """Entries that fit the same several locals are all decided at once, not one after the other."""
    rounds = []
    real = L.stored
    monkeypatch.setattr(L, "stored", lambda df, kind: (rounds.append(kind), real(df, kind))[1])
    local = [(f"L{i}", "Works", ["Ann"], None, "ok") for i in range(3)] + [("S", "Single", ["Ann"], None, "ok")]
    shelf = [("book", f"{i}", "Works" if i % 2 else "Single", "Ann", i) for i in range(400)]
    assert linked(spark, shelf, local) == [("0", "S", "exact-title-author")]
    assert rounds.count("wanted-locals") <= 4


@pytest.mark.parametrize("seed", range(3))
def test_chains(spark, seed):
    r = random.Random(seed)
    shelf, local = [], []
    for g in range(25):
        titles = [f"T{g}", f"T{g}: one", f"T{g}: two", f"t {g} TWO"]
        for i in range(r.randint(1, 9)):
            n = len(shelf)
            shelf.append((r.choice(["book"] * 9 + ["album"]), f"i{n}", r.choice(titles), r.choice(["Ann", "Ann Bo", "Bo", "", "Cy"]), 0))
        for i in range(r.randint(0, 6)):
            local.append((f"s{len(local)}" if r.random() < 0.95 else None, r.choice(titles), r.choice([["Ann"], ["Bo"], ["Cy", "Bo"], [""]]), None, r.choice(["ok"] * 6 + ["error"])))
    for x in range(0, len(local), 4):
        local[x] = (local[x][0] or f"n{x}", *local[x][1:3], f"i{r.randrange(len(shelf))}-{x}" if r.random() < 0.3 else shelf[(x * 7) % len(shelf)][1], local[x][4])
    claims = [x[3] for x in local if x[3]]
    local = [x if not x[3] or claims.count(x[3]) == 1 else (*x[:3], None, x[4]) for x in local]
    order = list(range(len(shelf)))
    r.shuffle(order)
    shelf = [(*x[:4], o) for x, o in zip(shelf, order, strict=True)]
    want = walked(shelf, local)
    assert linked(spark, shelf, local) == want and len(want) > 10
