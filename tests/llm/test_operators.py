"""The training-data operators against SQL, brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import spark_rows, sql_rows
from verdigris.llm import chat, components, exact_dedup, mixing, pieces, quality, simhash, suffix_dedup, suffix_grouping, token_counts, toxicity, warc
from verdigris.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, fingerprint int, keep_id int, n_words int"
EDGE = [(1, "a b c d e", "en", "src1", 0, 0, 0), (2, "a  b c\td e", "en", "src1", 0, 0, 0), (2, "a  b c\td e", "en", "src1", 0, 0, 0), (3, None, None, None, 0, 0, 0), (4, "", "xx", "src2", 0, 0, 0), (None, "a b c d e", "de", "other", 0, 0, 0), (5, "x y z " * 40_000, "en", "src0", 0, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(ORACLE_SQL[name], SF)


def test_exact_dedup_edges(edge, empty):
    rows = {(r["doc_id"], r["group_size"]): (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(edge).collect()}
    assert rows[(1, 4)] == (1, True) and rows[(2, 4)] == (1, False) and rows[(None, 4)] == (1, False)
    assert rows[(3, 2)] == (3, True) and rows[(4, 2)] == (3, False) and rows[(5, 1)] == (5, True)
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicated(edge).collect()) == [1, 3, 5]
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.exact_dedup(edge).count() == len(EDGE)


def test_exact_dedup_levels(spark):
    """A length of its own needs no prefix, a prefix of its own no full hash; equal prefixes are told by the full hash."""
    rows = [(1, "a" * 10), (2, "b" * 20), (3, "c" * 20), (4, "x" * 64 + "p"), (5, "x" * 64 + "q"), (6, "x" * 64 + "p")]
    found = {r["doc_id"]: (r["level"], r["keep_id"], r["content_sha256"] is None) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert found == {1: ("length", 1, True), 2: ("prefix", 2, True), 3: ("prefix", 3, True), 4: ("full", 4, False), 5: ("full", 5, False), 6: ("full", 4, False)}


def _brute_simhash(rows, distance=4):
    fp = {d: simhash.fingerprint((t or "").encode()) % (1 << 64) for d, t in rows}
    comp = {d: d for d in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= distance and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {(d, f"{fp[d]:016x}", comp[d]) for d in fp}


@pytest.mark.parametrize("bucket", [64, 2])
def test_simhash_against_all_pairs(docs, bucket):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in simhash.simhash_dedup(docs, most_in_bucket=bucket).collect()} == _brute_simhash(rows)


def test_simhash_edges(edge, empty):
    rows = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_dedup(edge).collect()}
    assert {(3, "0" * 16, 3), (4, "0" * 16, 3)} <= rows and {r[2] for r in rows if r[0] in (1, 2, None)} == {1}
    assert simhash.simhash_dedup(empty).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    assert {roots[i] for i in range(1, 201)} == {0} and roots[501] == 500


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(3000):
        t = bytes(rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(30)))
        assert suffix_grouping.suffix_order(t) == sorted(range(len(t)), key=lambda i: t[i:])


def _brute_cuts(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out[d] = len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("most", [2000, 2, 1])
def test_suffix_dedup_against_all_windows(docs, most):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(docs, most_segments=most).collect()}
    assert found == _brute_cuts(rows)


def test_suffix_dedup_edges(edge, empty):
    rows = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(edge).collect()]
    assert len(rows) == len(EDGE) and all(r[2] == 0 for r in rows) and (5, 240_000, 0) in rows
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    with pytest.raises(TypeError):
        suffix_dedup.suffix_dedup(edge, id_col="lang")


def test_suffix_dedup_with_repeated_and_null_ids(spark):
    """Rows of one id never take from each other; each loses what smaller ids have, also where its id has other texts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(120))
    a, b, c = word(), word(), word()
    rows = [(1, a), (2, b + a), (2, b + a), (2, c + b), (2, c + b), (3, b), (3, c + "x" + a[:60]), (None, a), (None, a), (4, None), (-5, b[20:90])]
    first: dict[bytes, int] = {}
    for d, t in rows:
        if d is not None:
            for i in range(len(t or "") - 49):
                w = t[i : i + 50].encode()
                first[w] = min(first.get(w, d), d)
    want = []
    for d, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if d is not None and first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want.append((d, bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    for most in (2000, 1):
        got = [(r["doc_id"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), most_segments=most, buckets=3).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_window_owners():
    """Without the suffix order the result is another one."""
    segments = [(0, b"p" * 10 + b"g" * 24 + b"q" * 26, 10, 7), (0, b"p" * 10 + b"g" * 24 + b"q" * 20 + b"r" * 6, 10, 3)]
    low = suffix_dedup.window_owners(segments, 50)
    assert low[0].tolist() == [3] * 5 + [7] * 6 and low[1].tolist() == [3] * 11


def test_chat_reads_back(spark):
    rows = [(1, 0, "system", "be <|im_end|> good"), (1, 1, "user", "a <\\| b <|"), (1, 2, "assistant", "word " * 3000), (1, 3, "user", None), (1, 4, "assistant", "ok"), (1, 4, "assistant", "ok"), (2, None, None, ""), (None, 0, "user", "x"), (3, 0, "system", "alone"), (4, 0, "as%0Asist\n<|ant", "odd role")]
    windows = chat.chat_windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), budget=64, history=16).cache()
    read = {}
    for r in chat.read_windows(windows).orderBy("conv_id", "window").collect():
        read.setdefault(r["conv_id"], ([], []))
        read[r["conv_id"]][0].extend((t["role"], t["text"]) for t in r["turns"])
        read[r["conv_id"]][1].extend(r["learned"])
    assert read[1][0] == [(r[2], r[3] or "") for r in rows[:6]] and read[1][1] == ["word " * 3000, "ok", "ok"]
    assert read[2][0] == [("", "")] and read[None][0] == [("user", "x")] and read[3][0] == [("system", "alone")] and read[4][0] == [("as%0Asist\n<|ant", "odd role")]
    assert all(r["text"].startswith("<|im_start|>system\n") for r in windows.where("conv_id = 1").collect())


def test_chat_edges(spark):
    schema = "conv_id string, turn bigint, role string, text string, window int, block int, body int"
    assert chat.chat_windows(spark.createDataFrame([], schema)).count() == 0
    rows = [("a", i, "system" if i == 0 else ("user", "assistant")[i % 2], f"w{i} " * (1 + i % 7), 1, 2, 3) for i in range(60)] * 2
    rows += [(None, None, None, None, 1, 2, 3)] * 2
    for block in (7, 1024):
        windows = chat.chat_windows(spark.createDataFrame(rows, schema), budget=64, history=16, block=block).orderBy("conv_id", "window").collect()
        if block == 7:
            first = [tuple(r) for r in windows]
        assert [tuple(r) for r in windows] == first
    read = {}
    for r in chat.read_windows(chat.chat_windows(spark.createDataFrame(rows, schema), budget=64, history=16)).orderBy("conv_id", "window").collect():
        read.setdefault(r["conv_id"], []).extend(t["text"] for t in r["turns"])
    assert read["a"] == [r[3] for r in sorted(rows[:120], key=lambda r: r[1])] and read[None] == ["", ""]


def test_pieces_and_counts(edge, empty):
    sp = pieces.ChunkEncoder(pieces.default_model())
    rng = random.Random(5)
    for text in ["", " ", "  a ", "▁▁x", *["".join(rng.choice(" ▁\n\tabé漢🙂<| the ing") for _ in range(rng.randrange(40))) for _ in range(500)]]:
        assert next(sp.encode([text]))[0] == [*sp.sp.encode(text), 2]
    rows = pieces.sentencepiece_roundtrip(edge, pieces.default_model()).collect()
    assert len(rows) == len(EDGE) and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    assert all(r["decoded"] == next(x[1] or "" for x in EDGE if x[0] == r["doc_id"]) for r in rows)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(edge, pieces.default_model()).collect()}
    assert counts[3] == counts[4] == 0 and counts[5] >= 120_000
    assert pieces.sentencepiece_roundtrip(empty, pieces.default_model()).count() == token_counts.token_counts(empty, pieces.default_model()).count() == 0


def test_trie_counts_like_a_plain_forward_pass():
    trie = token_counts.TrieCounter(pieces.default_model())

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + n * trie.byte_score, best[end - 1][1] + n)]
            options += [(best[s][0] + trie.pieces[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in trie.pieces]
            best.append(max(options, key=lambda o: (o[0], -o[1])))
        return best[-1][1]

    words = {"▁" + w for w in ["the", "there", "therefore", "thereby", "漢字", "é", "x" * 50, "ing"]}
    assert trie.counts(words) == {w: plain(w) for w in words}


def test_quality_base_figures(docs, edge, empty):
    def plain(text):
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(zip(found, found[1:], found[2:], strict=False))
        covered = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
        return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)

    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in quality.quality_rules(docs).collect():
        assert tuple(r)[1:6] == plain(texts[r["doc_id"]])
    rows = quality.quality_rules(edge).collect()
    assert len(rows) == len(EDGE) and next(tuple(r)[1:6] for r in rows if r["doc_id"] == 5) == plain(EDGE[-1][1])
    assert quality.quality_rules(empty).count() == 0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(labels[r["doc_id"]], r["predicted"]) for r in QUERIES["op5_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    clean = [p for t, p in rows if not t]
    assert np.mean([t == p for t, p in rows]) >= 0.95 and sum(clean) <= 0.03 * len(clean)


def test_toxicity_reads_clauses(edge, empty):
    reader = toxicity.Reader({"^idiot": 5.0})
    name = dict(zip(toxicity.FEATURES, range(99), strict=False))
    assert reader.features("you idiot.")[name["insult_targeted"]] > 0 and reader.features("not an idiot.")[name["insult_negated"]] > 0
    assert reader.features("he said idiot.")[name["insult_reported"]] > 0 and reader.features("never not idiot.")[name["insult_plain"]] > 0
    grammar = toxicity.fit(edge, edge.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert toxicity.toxicity(edge, grammar).count() == len(EDGE) and toxicity.toxicity(empty, grammar).count() == 0


def test_mixing_edges(edge, empty):
    rows = mixing.mix_sources(edge, budget_share=1.0, max_epochs=1).collect()
    assert len(rows) == len(EDGE) and sum(r["n_tokens"] * r["copies"] for r in rows) <= sum(r["n_tokens"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i if i % 3 else None, "w " * (1 + i % 5) + str(i), "en", "src1") for i in range(40)] + [(7, "other text of seven", "en", "src1"), (None, None, None, None)]
    chosen = []
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame(some, "doc_id bigint, text string, lang string, source string").repartition(3)
        chosen.append(sorted((str(r["doc_id"]), r["n_tokens"], r["copies"]) for r in mixing.mix_sources(docs, budget_share=0.4, max_epochs=1).collect()))
    assert chosen[0] == chosen[1] and 0 < sum(c for *_, c in chosen[0]) < 42


def test_warc_round_trip(spark, tmp_path):
    html = "WARC/1.1\r\n\r\n" + "é" * 100
    rows = [(3, "http://www.A.example/x/#f", html, 1), (1, "https://a.example/x", html, 1), (2, None, None, 1), (4, "http://b.example", "short", 1), (5, "b.example/\n", "short", 1), (None, "c", html, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type int")
    warc.write_warc(pages, str(tmp_path / "w"), records_per_file=2)
    out = warc.capture_histories(spark, str(tmp_path / "w")).collect()
    found = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out}
    size = len(html.encode())
    assert found == {1: ("response", None, size), 3: ("revisit", 1, size), None: ("revisit", 1, size), 2: ("response", None, 0), 4: ("response", None, 5), 5: ("response", None, 5)}
    keys = [(r["url_key"], r["captured_at"]) for r in out]
    assert keys == sorted(keys) and all(r["payload_digest"] == hashlib.sha256((next(x[2] for x in rows if x[0] == r["page_id"]) or "").encode()).hexdigest() for r in out)
    runs = [sorted((i * 7 % 11,) for i in range(k)) for k in (5, 0, 3)]
    assert list(warc.LoserTree(runs)) == sorted(sum(runs, []))
