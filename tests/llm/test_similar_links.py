"""Verified SimHash links against all pairs, with crowded sets and without."""

import random

import pytest
from pyspark.sql import functions as F

from verdigris.llm import simhash


def _plain(rows):
    """The ids that stay when every pair within four bits and of similarity 0.8 or more is linked."""
    fp = {d: simhash.fingerprint((t or "").encode(), 5) % (1 << 64) for d, t in rows}
    words = {d: (t or "").lower().split() for d, t in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and group[a] != group[b] and (fp[a] ^ fp[b]).bit_count() <= 4 and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return sorted(d for d in group if group[d] == d)


@pytest.mark.parametrize("bucket", [16, 2])
def test_planted_near_copies(spark, bucket):
    """Copies with few or many words changed, texts alike in counts but not in sets, short and empty ones."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for size in (3, 6, 300, 900, 900):
        base = [word() for _ in range(size)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(1 + max(1, size // 60))):
                copy[rng.randrange(size)] = word()
            rows.append((len(rows), " ".join(copy)))
    again = "one two three four five six seven eight nine ten " * 40
    rows += [(len(rows) + i, again + " ".join(word() for _ in range(2 * i))) for i in range(8)]
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    want = _plain(rows)
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).dropDuplicates(["node"])
    roots = {r["node"]: r["root"] for r in simhash.connected_components(simhash.similar_links(texts, most_in_bucket=bucket)).collect()}
    least: dict[int, int] = {}
    for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node")).collect():
        root = roots.get(r["node"], r["node"])
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    assert sorted(least.values()) == want and 12 < len(want) < len(rows)
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == want
    assert simhash.deduplicated(docs.where(F.lit(False))).count() == 0
