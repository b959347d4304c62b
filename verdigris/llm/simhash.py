"""SimHash near-dedup through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``distance`` bits differ in at most so many of their eight bytes,
so at least ``8 - distance`` positional bytes match. The index is keyed by sets of so many positional bytes, not by
single ones, whose lists would each have a 256th of all rows: a pair that reaches the guaranteed minimum of matches
meets under at least one set. A pair under a set is tallied over all eight positional bytes, then verified bit by
bit, and kept under the first set it shares.

Equal fingerprints are one row of the index. A set that more than ``most_in_bucket`` fingerprints share is not
paired up: its fingerprints are linked through the values within half the distance of each instead (two
fingerprints are within the distance exactly if they have such a value in common), which is linear in the
fingerprints and finds the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

SEED = 42
BYTES = 8


def fingerprint(text: bytes, width: int = 4, hashes: int = 100_000) -> int:
    """The signed 64-bit SimHash of a text in UTF-8.

    A-Z are lower-cased; words are runs of bytes that are not ASCII white space; features are windows of
    ``width`` words joined by spaces, repeats included (fewer words: all of them; none: fingerprint zero). A bit
    is set if it is in over half the XXH64 hashes (seed 42).
    """
    from xxhash import xxh64_intdigest as digest

    found = text.lower().split()
    n = len(found)
    if not n:
        return 0
    joined = b" ".join(found)
    if n < width:
        return int(np.array([digest(joined, SEED)], np.uint64).view(np.int64)[0])
    lengths = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - width + 1]
    ends = ends[width - 1 :]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), hashes):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + hashes].tolist(), ends[at : at + hashes].tolist(), strict=True)], np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * bits > len(starts)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``doc_id, fp``: one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(fps, pa.int64())})

    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _byte(x: Column, at: int) -> Column:
    return F.shiftrightunsigned(x, 8 * at).bitwiseAND(F.lit(255))


def _met(nodes: DataFrame, distance: int, most_in_bucket: int) -> tuple[DataFrame, DataFrame]:
    """Of ``node, fp`` (both distinct rows): pairs ``a, b`` of nodes within the distance, each once, and ``place, node`` of those that meet in crowded sets.

    Every two nodes within the distance are a pair or share a place, and nodes that share a place are within the distance.
    """
    least = BYTES - distance
    sets = list(combinations(range(BYTES), least))

    def key(at: tuple[int, ...], k: int) -> Column:
        out = F.lit(k).cast("long")
        for p in at:
            out = F.shiftleft(out, 8).bitwiseOR(_byte(F.col("fp"), p))
        return out  # the number of the set above four or six bytes

    index = nodes.select("node", "fp", F.posexplode(F.array(*[key(at, k) for k, at in enumerate(sets)])).alias("set", "key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes an index for as small as the nodes that it is made of, and would send it whole through the driver.
    shared = cut(index.hint("merge").join(sizes, "key").select("key", "set", "node", "fp", "n"))

    # Postings: pairs under one set, then the tally of all their matching positional bytes, then the bits.
    buckets = shared.where(F.col("n") <= most_in_bucket).groupBy("key").agg(F.min("set").alias("set"), F.collect_list(F.struct("node", "fp")).alias("m"))
    differ = lambda x, y: x["fp"].bitwiseXOR(y["fp"])
    tally = lambda d: sum((F.when(_byte(d, p) == 0, 1).otherwise(0) for p in range(BYTES)), F.lit(0))
    enough = lambda d: (tally(d) >= least) & (F.bit_count(d) <= distance)
    pairs = buckets.select("set", F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["node"] < x["node"]) & enough(differ(x, y))), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), differ(x, y).alias("d")))))).alias("p")).select("set", "p.*")
    changed = sum((F.when(_byte(F.col("d"), p) != 0, F.lit(1 << p)).otherwise(F.lit(0)) for p in range(BYTES)), F.lit(0))
    first = F.array(*[F.lit(sum(1 << q for q in range(at[-1]) if q not in at)) for at in sets])  # bytes that must differ for this to be the first set shared
    must = F.get(first, F.col("set"))
    paired = pairs.withColumn("changed", changed).where(F.col("changed").bitwiseAND(must) == must).select("a", "b")

    # Sets beyond the bound: no pairs, but meeting places.
    crowded = shared.where(F.col("n") > most_in_bucket).select("node", "fp").distinct()
    half = distance // 2
    near = [0] + [sum(1 << i for i in c) for r in range(1, half + 1) for c in combinations(range(64), r)]
    signed = [x - (1 << 64) if x >> 63 else x for x in near]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array(signed, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                spots = some.column(1).to_numpy(zero_copy_only=False)[:, None] ^ masks[None, :]
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.repeat(some.column(0).to_numpy(zero_copy_only=False), len(masks))), "place": pa.array(spots.ravel())})

    return paired, crowded.mapInArrow(places, "node bigint, place bigint")


def _starred(spots: DataFrame) -> DataFrame:
    """``place, node, low``: each node of a place with others, and the place's first.

    A place has as many nodes at most as there are values within half the distance of it (2081 for a distance of 4),
    so a window holds few rows, and no table of places is joined or broadcast.
    """
    return spots.select("place", "node", F.min("node").over(Window.partitionBy("place")).alias("low")).where("node <> low")


def _links(fps: DataFrame, distance: int, most_in_bucket: int) -> DataFrame:
    """``a, b``: links between different fingerprints (column ``fp``, distinct) that join the same components as all links do."""
    paired, spots = _met(fps.select(F.col("fp").alias("node"), "fp"), distance, most_in_bucket)
    return paired.unionByName(_starred(spots).select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct XXH64 hashes of the windows of ``width`` words (fewer words: all of them, none: the empty text)."""
    from xxhash import xxh64_intdigest as digest

    found = text.lower().split()
    n = max(1, len(found) - width + 1)
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + width]), SEED) for i in range(n)), np.uint64, n))


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of texts (``node, text``) whose sets of shingles have that Jaccard similarity."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_pydict({"node": some.column(0), "s": pa.array([shingles(t.as_py(), width).tobytes() for t in some.column(1)], pa.binary())})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.intersect1d(s, t, assume_unique=True).size
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    known = cut(texts.join(asked, "node", "left_semi").mapInArrow(sets, "node bigint, s binary"))
    return cut(pairs.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"))


def similar_links(texts: DataFrame, distance: int = 4, width: int = 5, percent: int = 80, most_in_bucket: int = 256) -> DataFrame:
    """``a, b``: links between texts (``node``, distinct, and ``text`` as binary) whose fingerprints are within the distance and whose shingles are similar enough, or that join the same components as all such links do.

    In a meeting place every text is held against the first; only those unlike it are held against the others. A set
    of up to ``most_in_bucket`` fingerprints is paired up: so many comparisons are fewer than the 2081 places (for a
    distance of 4) that each of them would have otherwise.
    """
    schema = "node bigint, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "fp": pa.array([fingerprint(t.as_py(), width) for t in batch.column(1)], pa.int64())})

    paired, spots = _met(cut(texts.select("node", "text").mapInArrow(run, schema)), distance, most_in_bucket)
    stars = cut(_starred(spots))
    first = _verified(cut(paired.unionByName(stars.select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct()), texts, width, percent)
    unlike = stars.join(first, (stars["node"] == first["a"]) & (stars["low"] == first["b"]), "left_anti").select("place", F.col("node").alias("a"))
    others = stars.select("place", F.col("node").alias("b"))
    more = unlike.join(others, "place").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return first.unionByName(_verified(cut(more.join(first, ["a", "b"], "left_anti")), texts, width, percent))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4, most_in_bucket: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Fingerprints that differ in at most ``distance`` bits (2 or 4) are linked; ``component_id`` is the smallest
    id that links reach. Null and empty texts have fingerprint zero and are linked like any other. Equal texts
    and repeated rows have one fingerprint, hence one component. A null id never is a component's smallest unless
    its component has no other. An empty table gives an empty result; other columns are never read.
    """
    if distance not in (2, 4):
        raise ValueError("the index is laid out for distances 2 and 4")
    own = cut(fingerprints(docs, id_col, text_col, width))
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(_links(classes.select("fp"), distance, most_in_bucket))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(component, "root").select("fp", "component_id")
    return own.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id, a null id being the last.

    Linked are texts whose fingerprints are within ``distance`` bits and whose shingles of ``width`` words have a
    Jaccard similarity of ``percent`` or more. A document is an id with a text (told by its 64-bit hash): of rows
    with the same id, null or not, and different texts each is a document of its own, and repeats of a document's row
    are dropped. Null text counts as empty; texts without words are copies of each other. Other columns are never read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__h", F.xxhash64(text))
    texts = docs.select(F.xxhash64(text).alias("node"), text.cast("binary").alias("text")).dropDuplicates(["node"])
    roots = connected_components(similar_links(texts, distance, width, percent))
    rows = keyed.select(F.col(id_col).alias("__kept"), F.col("__h").alias("__of")).distinct()
    rows = rows.join(roots, rows["__of"] == roots["node"], "left").withColumn("root", F.coalesce("root", "__of"))
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col("__kept").isNull().alias("last"), "__kept", "__of")).alias("k")).select("k.__kept", "k.__of")
    return keyed.join(keep, keyed[id_col].eqNullSafe(keep["__kept"]) & (keyed["__h"] == keep["__of"]), "left_semi").dropDuplicates([id_col, "__h"]).drop("__h")


def op2_query(spark, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
