"""Ranked lexical search through an index of documents clustered by recursive graph bisection.

Documents are reordered so that those which share terms stand together, and cut into shards. A shard is one row: its
documents, its terms with their postings, and the largest impact that a term has in it. The sum of those for an item's
terms, each by its weight, bounds every score in the shard. An item visits the shard of the highest bound, then some
more, then all whose bound its tenth score does not exceed: no document elsewhere can be among its best, so the search
ends exactly. Items are searched in blocks of a bounded number of terms, which go to every task; the index never moves.
Ties are decided by ``doc_id``, whatever the order of the documents in the index.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bisection import Tree, fit
from .common import BITMAP_BITS, cut, shared_folder, text_or_empty

#: What the order is fitted on, and its size: so many documents at most, hashed terms, and levels of the tree.
MOST_FITTED, HASHED_TERMS, DEPTH = 4096, 2048, 5
#: About so many documents are one shard.
SHARD = 2048
#: Bitmaps of the terms that are asked for, 4 KB each: 2 MB, however many they are.
BITMAPS = 512
#: About so many terms of items are searched at once: a block, which is sent to every task.
TERMS_AT_ONCE = 100_000
#: An item visits so many shards, by their bounds, before it visits all that can still matter.
FIRST_VISITS = (1, 6)
SCALE = 1_000_000_000
#: Every ASCII character that is no part of a term as a space, capital letters as small ones.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased, in UTF-8."""
    return text.encode().translate(FOLD).split()


def asked_terms(items: DataFrame) -> DataFrame:
    """``item, term``: each distinct term of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t.decode()) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["item", "term"])

    return items.select("item", text_or_empty().alias("text")).mapInArrow(run, "item bigint, term string")


def _bitmap(asked: DataFrame) -> bytes:
    """Which checksums, of 24 bits, terms that are asked for have."""
    h = F.crc32("term") % (BITMAPS * BITMAP_BITS)
    rows = asked.groupBy(F.floor(h / BITMAP_BITS).alias("slot")).agg(F.bitmap_construct_agg(h % BITMAP_BITS).alias("bits")).collect()
    out = bytearray(BITMAPS * BITMAP_BITS // 8)
    for slot, bits in rows:
        out[slot * len(bits) : (slot + 1) * len(bits)] = bits
    return bytes(out)


def _documents(docs: DataFrame, asked: bytes) -> DataFrame:
    """``doc_id, row, n, terms, counts, hashed`` of every document: its number of terms, and those of its terms that may be asked for, with their occurrences and checksums."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size, at = shared.value, BITMAPS * BITMAP_BITS, TaskContext.get().partitionId() << 33
        known: dict[bytes, int] = {}
        for batch in batches:
            for begins in range(0, batch.num_rows, 500):
                part = batch.slice(begins, 500)
                n, terms, counts, hashed = [], [], [], []
                for text in part.column(1).to_pylist():
                    said = terms_of(text)
                    n.append(len(said))
                    own = Counter(said)
                    kept = {}
                    for t, k in own.items():
                        h = known.get(t)
                        if h is None:
                            h = zlib.crc32(t) % size
                            h = h if bits[h >> 3] >> (h & 7) & 1 else -1
                            if len(known) < 300_000 and len(t) <= 64:  # only a cache
                                known[t] = h
                        if h >= 0:
                            kept[t] = k, h % HASHED_TERMS
                    terms.append([t.decode() for t in kept])
                    counts.append([k for k, _ in kept.values()])
                    hashed.append([h for _, h in kept.values()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(range(at, at + len(n)), pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())), pa.array(hashed, pa.list_(pa.int16()))],
                    ["doc_id", "row", "n", "terms", "counts", "hashed"],
                )
                at += len(n)

    return rows.mapInArrow(run, f"doc_id {kind}, row bigint, n bigint, terms array<string>, counts array<bigint>, hashed array<smallint>")


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the lists of an Arrow column begin, from 0, and their values one after the other."""
    starts = column.offsets.to_numpy()
    return starts - starts[0], column.values.slice(starts[0], starts[-1] - starts[0])


def _clustered(rows: DataFrame) -> DataFrame:
    """Adds ``leaf``, a document's cluster. The tree is fitted on the documents with the smallest hashes, ``MOST_FITTED`` at most; every document is sent down it."""
    sample = rows.where("n > 0").select("hashed").orderBy(F.xxhash64("row")).limit(MOST_FITTED).toPandas()["hashed"]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in sample]))).astype(np.int64)
    terms = np.concatenate([np.zeros(0, dtype=np.int64), *[np.asarray(x, dtype=np.int64) for x in sample]]).astype(np.int64)
    tree = fit(starts, terms, HASHED_TERMS, DEPTH)
    shared = rows.sparkSession.sparkContext.broadcast((tree.depth, tree.weights, tree.cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*shared.value)
        for batch in batches:
            if batch.num_rows:
                starts, terms = _flat(batch.column("hashed"))
                leaves = tree.leaves(starts, terms.to_numpy().astype(np.int64))
                columns = {x: batch.column(x) for x in batch.schema.names if x != "hashed"}
                yield pa.RecordBatch.from_pydict(columns | {"leaf": pa.array(leaves, pa.int32())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row bigint, n bigint, terms array<string>, counts array<bigint>, leaf int")


def _shards(rows: DataFrame, n_docs: int, n_terms: int, shard: int) -> DataFrame:
    """``shard, ids, terms, starts, documents, impacts, most``: documents in the order of the clusters, each term's postings and the largest impact among them."""
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("in_leaf"))  # one row a leaf of the tree
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("in_leaf") / shard))
    dealt = rows.join(F.broadcast(sizes), "leaf").select(F.concat_ws("-", "leaf", part).alias("shard"), "doc_id", "row", "n", "terms", "counts")
    ids = dealt.schema["doc_id"].dataType

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("row")
        starts, terms = _flat(table.column("terms").combine_chunks())
        _, counts = _flat(table.column("counts").combine_chunks())
        words = terms.dictionary_encode()
        code, tf = words.indices.to_numpy().astype(np.int64), counts.to_numpy()
        doc = np.repeat(np.arange(table.num_rows), np.diff(starts))
        m = 100 - 90 + (90 * table.column("n").to_numpy() * n_docs) // n_terms
        impact = (SCALE * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, code))
        first = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(words.dictionary)))))
        most = np.maximum.reduceat(impact[order], first[:-1]) if len(order) else np.zeros(0, dtype=np.int64)
        listed = lambda values, kind: pa.array([values], pa.list_(kind))
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table({
            "shard": table.column("shard").slice(0, 1), "ids": whole(table.column("doc_id").combine_chunks()), "terms": whole(words.dictionary), "starts": listed(first, pa.int32()),
            "documents": listed(doc[order], pa.int32()), "impacts": listed(impact[order], pa.int32()), "most": listed(most, pa.int32()),
        })

    return dealt.groupBy("shard").applyInArrow(build, f"shard string, ids array<{ids.simpleString()}>, terms array<string>, starts array<int>, documents array<int>, impacts array<int>, most array<int>")


def _weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2.0) / (2.0 * df + 1.0))).cast("bigint")


class _Shard:
    """One row of the index."""

    def __init__(self, batch: pa.RecordBatch, at: int):
        one = {c: batch.column(c).slice(at, 1).flatten() for c in ("ids", "terms", "starts", "documents", "impacts", "most")}
        self.ids = one["ids"]
        self.place = {t: i for i, t in enumerate(one["terms"].to_pylist())}
        self.starts, self.documents, self.impacts, self.most = (one[c].to_numpy() for c in ("starts", "documents", "impacts", "most"))
        self.order = None if self.ids.null_count else self.ids.to_numpy()

    def found(self, terms: list[str], weights: list[int]) -> list[tuple[int, int]]:
        return [(at, w) for t, w in zip(terms, weights, strict=True) if (at := self.place.get(t)) is not None]

    def bound(self, held: list[tuple[int, int]]) -> int:
        return sum(w * int(self.most[at]) for at, w in held)

    def best(self, held: list[tuple[int, int]], floor: int, k: int) -> tuple[list[int], list[int]]:
        """Places and scores of the shard's ``k`` best documents that do not score under ``floor``; more than ``k`` only where ids are null, whose ties wait for the merge."""
        total = np.zeros(len(self.ids), dtype=np.int64)
        for at, w in held:
            a, b = self.starts[at], self.starts[at + 1]
            total[self.documents[a:b]] += w * self.impacts[a:b].astype(np.int64)
        good = np.flatnonzero(total >= max(floor, 1))
        if len(good) > k:
            good = good[total[good] >= np.partition(total[good], len(good) - k)[len(good) - k]]
            if self.order is not None:
                good = good[np.lexsort((self.order[good], -total[good]))[:k]]
        return good.tolist(), total[good].tolist()


def _bounds(index: DataFrame, items: list[tuple], keep: int) -> DataFrame:
    """``item, bound``: each task's ``keep`` highest bounds of an item."""
    shared = index.sparkSession.sparkContext.broadcast([x[:3] for x in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highest: dict[int, list[int]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                place = {t: i for i, t in enumerate(batch.column("terms").slice(at, 1).flatten().to_pylist())}
                most = batch.column("most").slice(at, 1).flatten().to_numpy()
                for item, terms, weights in shared.value:
                    bound = sum(w * int(most[i]) for t, w in zip(terms, weights, strict=True) if (i := place.get(t)) is not None)
                    if bound:
                        own = highest.setdefault(item, [])
                        own.append(bound)
                        if len(own) > 4 * keep:
                            highest[item] = sorted(own)[-keep:]
        rows = [(item, b) for item, own in highest.items() for b in sorted(own)[-keep:]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["item", "bound"])

    return index.select("terms", "most").mapInArrow(run, "item bigint, bound bigint")


def _visit(index: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """``item, doc_id, score`` of the best ``k`` in each shard that an item visits: whose bound is from ``low`` to under ``high``. ``items`` are ``item, terms, weights, floor, low, high``."""
    shared = index.sparkSession.sparkContext.broadcast(items)
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                shard = _Shard(batch, at)
                asking, places, scores = [], [], []
                for item, terms, weights, floor, low, high in shared.value:
                    held = shard.found(terms, weights)
                    if held and low <= shard.bound(held) < high:
                        where, what = shard.best(held, floor, k)
                        asking += [item] * len(where)
                        places += where
                        scores += what
                yield pa.RecordBatch.from_arrays([pa.array(asking, pa.int64()), shard.ids.take(pa.array(places, pa.int64())), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return index.drop("shard").mapInArrow(run, f"item bigint, doc_id {kind}, score bigint")


def _order() -> Window:
    return Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))


def _searched(index: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """``item, doc_id, score, rank`` for one block of items, ``item, terms, weights``."""
    highest = _bounds(index, items, FIRST_VISITS[-1]).withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"))))
    marks: dict[int, dict[int, int]] = {}
    for item, bound, n in highest.where(F.col("n").isin(*FIRST_VISITS)).collect():  # a few numbers an item of the block
        marks.setdefault(item, {})[n] = bound
    best = index.sparkSession.createDataFrame([], f"item bigint, doc_id {index.schema['ids'].dataType.elementType.simpleString()}, score bigint")
    floors: dict[int, int] = {}
    above = dict.fromkeys(marks, 1 << 62)
    for n in (*FIRST_VISITS, None):
        asked = []
        for item, terms, weights in items:
            if item in marks:
                floor = floors.get(item, 0)
                low = max(floor, marks[item].get(n, 0) if n else 0)
                if low < above[item]:
                    asked.append((item, terms, weights, floor, low, above[item]))
                    above[item] = low
        if not asked:
            continue
        best = cut(best.unionByName(_visit(index, asked, k)).withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= k).drop("rank"))
        floors = dict(best.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("item", "floor").collect())
    return best


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """Each item's ``k`` best documents with a score above 0: ``item_id, rank, doc_id, score``.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``. Equal scores rank by ascending ``doc_id``, null
    first. Null and empty texts have no terms: such a document is never found, such an item finds nothing. Every row is
    a document or an item of its own, so a repeated document can fill two ranks and a repeated item is answered twice.
    Empty tables give no rows. Other columns are never read.
    """
    spark = docs.sparkSession
    asked_items = cut(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")))
    asked = cut(asked_terms(asked_items))
    said, path = shared_folder(spark, "lexical-terms"), shared_folder(spark, "lexical-index")
    _documents(docs, _bitmap(asked)).write.parquet(said)
    rows = spark.read.parquet(said)
    n_docs, n_terms = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighted = cut(asked.join(df, "term").select("item", "term", _weight(F.col("df"), n_docs).alias("w")).where("w > 0"))
    _shards(_clustered(rows), n_docs, max(n_terms, 1), shard).write.parquet(path)
    index = spark.read.parquet(path)

    blocks = max(1, -(-weighted.count() // TERMS_AT_ONCE))
    lists = cut(weighted.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights")).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))))
    found = [_searched(index, [tuple(r) for r in lists.where(F.col("block") == b).drop("block").collect()], k) for b in range(blocks)]
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    return best.withColumn("rank", F.row_number().over(_order())).join(asked_items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '') AS ts FROM documents),
a AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(DISTINCT doc_id) + 1))) AS BIGINT) AS w FROM f, a GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term), a GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
