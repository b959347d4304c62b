"""The filters before the similarity of windows lose no pair, and spare most of the long comparisons."""

import random
from difflib import SequenceMatcher

from verdigris.operators import quotes as Q


def _plain(quotes, texts, admit):
    out = []
    for i, t in enumerate(texts):
        for item, q in quotes:
            width = min(len(t), len(q) + max(4, len(q) // 5))
            starts = {*range(0, len(t) - width + 1, max(1, len(q) // 6)), len(t) - width}
            raw = max(SequenceMatcher(None, q, t[s : s + width]).ratio() for s in starts)
            if raw >= admit:
                out.append((item, i, raw))
    return sorted(out)


def test_filters_lose_nothing(monkeypatch):
    r = random.Random(5)
    syllables = [a + b + c for a in "bdfklmnprst" for b in "aeiou" for c in "nrst"][:60]
    some = lambda n: "".join(r.choice(syllables) for _ in range(n))
    quotes = [(k, some(r.randint(4, 40))) for k in range(20)]
    texts = [some(r.randint(1, 120)) for _ in range(60)]
    for _, q in quotes:
        for cuts in (0, 1, 3, 6):
            t = list(q)
            for _ in range(cuts):
                t[r.randrange(len(t))] = r.choice("xyz\U0001f600")
            texts += ["".join(t), some(3) + "".join(t) + some(2)]
    calls, real = [], Q._common
    monkeypatch.setattr(Q, "_common", lambda *x: (calls.append(1), real(*x))[1])
    got = sorted(Q.similar_windows(quotes, texts, 0.88))
    assert got == _plain(quotes, texts, 0.88) and len(got) > 40
    assert len(calls) < 4 * len(got)


def test_edits_in_like_texts_lose_nothing(monkeypatch):
    """Texts of the quotes' own syllables, short and long, with edits spread over the passages: all pairs, however they are dealt."""
    r = random.Random(8)
    syllables = [a + b for a in "bdklmnrst" for b in ("a", "e", "i", "on", "es")]
    some = lambda n: "".join(r.choice(syllables) for _ in range(n))
    quotes = [(k, some(n)) for k, n in enumerate([5, 9, 20, 60, 100, 220])]
    texts = [some(r.choice([3, 20, 90, 300])) for _ in range(12)]
    for _, q in quotes:
        for every, new in ((9, ""), (9, "y"), (30, "xx"), (5, "z")):
            t = "".join(c + new if i % every == 4 and len(new) != 1 else new or "" if i % every == 4 else c for i, c in enumerate(q))
            spread = "".join(c + "w" * (i % 6 == 2) for i, c in enumerate(q))
            texts += [t, some(30) + t + some(40), spread, some(9) + spread + some(60), t[: len(t) * 9 // 10]]
    texts += ["", "a", "\0" * 90, "\U0001f600" * 80, "Ω" * 70]
    for together, chars in ((256, 1_000_000), (5, 2000)):
        monkeypatch.setattr(Q, "TOGETHER", together)
        monkeypatch.setattr(Q, "CHARS_AT_ONCE", chars)
        for admit in (0.88, 0.7):
            got = sorted(Q.similar_windows(quotes, texts, admit))
            assert got == _plain(quotes, [t or " " for t in texts], admit) and len(got) > 20


def test_the_same_parts_in_another_order_are_not_measured(monkeypatch):
    """Halves of a quote, exchanged: what it has in characters, pairs and threes, but not where it has it."""
    r = random.Random(9)
    quotes = [(k, "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(240))) for k in range(10)]
    texts = [q[120:] + q[:120] for _, q in quotes] + ["xyz" * 40 + q[120:] + q[:120] + "xyz" * 40 for _, q in quotes]
    calls, real = [], Q._common
    monkeypatch.setattr(Q, "_common", lambda *x: (calls.append(1), real(*x))[1])
    assert Q.similar_windows(quotes, [*texts, quotes[0][1]], 0.88) == [(0, 20, 1.0)]
    assert len(calls) == 1
