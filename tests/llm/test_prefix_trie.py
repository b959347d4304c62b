"""The trie against a plain one built from dictionaries, with buckets of one row up to all."""

import hashlib
import random
import zlib

import pytest

from verdigris.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, number int, path string"
SF = "/root/testdata/sf0.001"


def plain(turns, rebuild=True):
    convs, out = {}, {}
    for c, t, r, x in sorted(turns, key=lambda z: (z[0] or 0, z[1] is not None, z[1] or 0, z[2] or "", z[3] or "")):
        if c is not None:
            convs.setdefault(c, []).append((r or "", x or ""))
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:] if rebuild else own
    nodes = {}
    for c, q in out.items():
        for d in range(len(q) + 1):
            nodes.setdefault(tuple(q[:d]), []).append(c)
    below = {p: [0, 0, 0] for p in nodes}  # children, leaves, saved
    for p in sorted(nodes, key=len, reverse=True):
        below[p][1] = below[p][1] or 1
        below[p][2] += (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            up = below[p[:-1]]
            up[0], up[1], up[2] = up[0] + 1, up[1] + below[p][1], up[2] + below[p][2]
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(out[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), *below[p], ends(p, m)) for p, m in nodes.items())


def built(spark, turns, **how):
    rows = [(*t, "x", -1, "y") for t in turns]
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **how).collect())


def some_turns(seed, n=60):
    r = random.Random(seed)
    out = []
    for c in range(n):
        said = [("system", "be kind"), ("user", f"q{r.randint(0, 2)}")] if r.random() < 0.8 else []
        said += [(r.choice(["user", "assistant", None]), r.choice(["ok", "no", "é", "", None])) for _ in range(r.randint(0, 12))]
        out += [(c if c % 7 else c + 1000, t, *x) for t, x in enumerate(said)]
    return out


@pytest.mark.parametrize("local", [1, 40, 10_000])
def test_the_trie_is_the_same_however_buckets_are_cut(spark, local):
    turns = some_turns(local)
    assert built(spark, turns, local_numbers=local) == plain(turns)


def test_many_equal_conversations_with_a_shared_beginning(spark):
    turns = [(c, t, "user", f"t{t}") for c in range(300) for t in range(6)] + [(c, t, "user", f"t{t}" if t < 5 else f"own{c}") for c in range(300, 340) for t in range(7)]
    assert built(spark, turns, local_numbers=20, rebuild=False) == plain(turns, rebuild=False)


def test_edges(spark):
    turns = [(1, None, "user", "b"), (1, None, "user", "a"), (1, 0, None, None), (1, 0, "", ""), (2, 3, "user", "x"), (2, 3, "user", "x"), (None, 1, "user", "lost"), (4, 1, "a", "bc"), (9, 1, "ab", "c"), (7, 0, "u", "y" * 200_000)]
    assert built(spark, turns, rebuild=False) == plain(turns, rebuild=False)
    assert built(spark, turns) == plain(turns)
    assert built(spark, []) == []
    assert built(spark, [(3, 0, "user", "gone")]) == plain([(3, 0, "user", "gone")])  # its turn is taken away: it ends at the root
    deep = [(c, t, "user", str(t)) for c in (5, 6) for t in range(3000)]
    assert built(spark, deep, rebuild=False, local_numbers=10_000)[-1][1] == 3000


def test_finishing_a_bucket_needs_no_order_of_its_rows():
    rows = [(3, 1, "e3", [1, 2, 2], [4, 5, 6]), (1, 2, "e1", [1, 2], [4, 5]), (2, 1, "e2", [1, 9], [4, 7])]
    want = None
    for seed in range(6):
        random.Random(seed).shuffle(rows)
        got = sorted(prefix_trie._finish(list(rows), 1, 0))
        want = want or got
        assert got == want
    assert want[0] == (1, 1, 0, 4, 2, 2, 22, prefix_trie.NO_ENDS)
