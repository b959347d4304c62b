"""The trie of conversations' prefixes, by MSD radix partitioning over dictionary-encoded turns.

Each distinct turn gets a number, each conversation is a row of numbers, and equal conversations become one row. A
bucket holds the rows with one prefix. A bucket of too many numbers is dealt out by its next turn, in which step its
node is aggregated with partial sums; this recurses until every bucket is small, and there a multikey quicksort
finishes it, writing a node wherever rows agree on a turn. Sums over subtrees climb from the buckets to the nodes
above them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: A bucket of at most so many turn numbers is finished by one task.
LOCAL_NUMBERS = 10_000
#: So many prefixes of large buckets at most are broadcast; beyond it they are joined by a shuffle.
MOST_BROADCAST = 50_000
#: A rebuilt conversation takes fewer than this many turns from another.
MOST_TAKEN = 9
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as numbers of distinct (role, text) with the bytes of the text."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), text_or_empty().alias("text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", said.alias("said"))
    rows = rows.withColumn("key", F.sha2(F.concat(F.length("said.role").cast("string"), F.lit("\n"), "said.role", "said.text"), 256))
    words = rows.groupBy("key").agg(F.min("said").alias("said")).select("key", "said", F.octet_length("said.text").alias("bytes"))
    # Numbers in the order of what is said, so that they alone decide between turns at one place.
    words = cut(words.orderBy("said").select("key", "bytes", F.monotonically_increasing_id().alias("number")))
    # A turn that very many conversations share is one row a conversation of the join's larger side.
    coded = rows.select("conv_id", "turn", "key").join(words, "key")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "number", "bytes")))
    return coded.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["number"].alias("number"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with its first turns exchanged for those of conversation ``c - c % 5``: as many as a checksum of its id says, fewer than nine."""
    c = F.col("conv_id")
    taken = (F.crc32(c.cast("string")) % MOST_TAKEN).cast("int")
    heads = convs.where(c % 5 == 0).select(c.alias("head_id"), F.slice("turns", 1, MOST_TAKEN - 1).alias("head"))
    own = convs.withColumns({"taken": taken, "head_id": c - c % 5}).join(heads, "head_id", "left")
    none = F.slice("turns", 1, 0)
    return own.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("taken")), F.slice("turns", F.col("taken") + 1, F.size("turns"))).alias("turns"))


def _joined(numbers: Column) -> Column:
    return F.array_join(numbers.cast("array<string>"), ",")


def distinct_rows(convs: DataFrame) -> DataFrame:
    """``first, n, ends, numbers, bytes``: each distinct row of turns once, with its smallest conversation, how many there are, and the hash of their ids.

    The ids of a group stream through one task in order, however many they are; the turns do not travel with them.
    """
    rows = convs.select("conv_id", F.col("turns.number").alias("numbers"), F.col("turns.bytes").alias("bytes"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n, digest = None, 0, 0, None
        done: list[tuple[int, int, str]] = []
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if n:
                        done.append((first, n, digest.hexdigest()))
                    key, first, n, digest = k, c, 0, hashlib.sha256()
                digest.update(f",{c}".encode() if n else str(c).encode())
                n += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["first", "n", "ends"])
                done = []
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, n, digest.hexdigest())], ["first", "n", "ends"])

    keyed = rows.select(F.sha2(_joined(F.col("numbers")), 256).alias("key"), "conv_id")
    groups = keyed.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(hashed, "first bigint, n bigint, ends string")
    return groups.join(rows.withColumnRenamed("conv_id", "first"), "first")


def _finish(rows: list[tuple], depth: int, parent: int | None) -> list[tuple]:
    """The nodes of one bucket: ``rows`` are distinct, have ``first, n, ends, numbers, bytes`` and agree on their first ``depth`` turns.

    A part of the rows that agree on one more turn is a node; the parts with smaller and larger numbers are sorted on
    the same turn. Parts wait on a stack, so that long conversations need no deep recursion.
    """
    nodes: list[list] = []  # conv_id, depth, parent's place, n_convs, children, leaves, saved, ends

    def node(part: list[tuple], at: int, above: int) -> None:
        n = sum(r[1] for r in part)
        ends = next((r[2] for r in part if len(r[3]) == at), NO_ENDS)
        here = len(nodes)
        nodes.append([min(r[0] for r in part), at, above, n, 0, 0, (n - 1) * part[0][4][at - 1] if at else 0, ends])
        if above >= 0:
            nodes[above][4] += 1
        more = [r for r in part if len(r[3]) > at]
        if more:
            waiting.append((more, at, here))

    waiting: list[tuple[list[tuple], int, int]] = []
    node(rows, depth, -1)
    while waiting:
        part, at, above = waiting.pop()
        pivot = part[len(part) // 2][3][at]
        equal = [r for r in part if r[3][at] == pivot]
        if len(equal) < len(part):
            for side in ([r for r in part if r[3][at] < pivot], [r for r in part if r[3][at] > pivot]):
                if side:
                    waiting.append((side, at, above))
        node(equal, at + 1, above)
    for x in reversed(nodes):  # a node comes after the one above it
        x[5] = x[5] or 1
        if x[2] >= 0:
            nodes[x[2]][5] += x[5]
            nodes[x[2]][6] += x[6]
    return [(x[0], x[1], nodes[x[2]][0] if x[2] >= 0 else parent, *x[3:]) for x in nodes]


def trie(distinct: DataFrame, local_numbers: int = LOCAL_NUMBERS) -> DataFrame:
    """The nodes of the trie of ``distinct_rows``."""
    numbers, size = F.col("numbers"), F.size("numbers")
    left = cut(distinct)
    small: list[DataFrame] = []
    large: list[DataFrame] = []
    depth = 0
    while True:
        # One step: buckets are the rows with one prefix of ``depth`` turns; all that are left come from large ones above.
        path = F.slice(numbers, 1, depth)
        told = left.withColumn("path", path)
        buckets = told.groupBy("path").agg(
            F.sum(size - depth + 1).alias("held"), F.count("*").alias("rows"), F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(size == depth, F.col("ends"))).alias("ends"),
            F.first(F.element_at("bytes", depth) if depth else F.lit(0)).cast("bigint").alias("last_bytes"),
        )
        big = cut(buckets.where((F.col("held") > local_numbers) & (F.col("rows") > 1)).drop("held", "rows"))
        n_big = big.count()
        if not n_big:
            small.append(told.withColumn("depth", F.lit(depth)))
            break
        keys = big.select(F.col("path").alias("big_path"))
        keys = F.broadcast(keys) if n_big <= MOST_BROADCAST else keys
        marked = told.join(keys, F.col("path") == F.col("big_path"), "left")
        small.append(marked.where("big_path is null").drop("big_path").withColumn("depth", F.lit(depth)))
        large.append(big.withColumn("depth", F.lit(depth)))
        left = cut(marked.where(F.col("big_path").isNotNull() & (size > depth)).select(*left.columns))
        depth += 1

    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    if not large:
        return _finished(rows.withColumn("parent", F.lit(None).cast("bigint"))).drop("path")

    tops = large[0]
    for more in large[1:]:
        tops = tops.unionByName(more)
    tops = cut(tops)
    # The bucket's node hangs below the node of a large bucket, whose prefix is one turn shorter.
    above = tops.select(F.col("path").alias("above"), F.col("conv_id").alias("parent"))
    above = F.broadcast(above) if above.count() <= MOST_BROADCAST else above
    prefix = F.when(F.col("depth") > 0, F.slice("path", F.lit(1), F.col("depth") - 1))
    finished = cut(_finished(rows.withColumn("above", prefix).join(above, "above", "left").drop("above")))

    roots = finished.where(F.size("path") == F.col("depth")).select("path", "n_leaves", "saved_tokens", F.lit(1).alias("bucket"))
    own = tops.select("path", F.lit(0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("last_bytes")).alias("saved_tokens"), F.lit(0).alias("bucket"))
    lengths = F.sequence(F.lit(0), F.size("path"))
    climbed = roots.unionByName(own).select(F.explode(F.transform(lengths, lambda k: F.struct(F.slice("path", F.lit(1), k).alias("to"), (k == F.size("path") - 1).alias("child")))).alias("up"), "n_leaves", "saved_tokens", "bucket")
    sums = climbed.groupBy(F.col("up.to").alias("path")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.sum(F.col("up.child").cast("bigint")).alias("n_children"))
    parents = tops.select(F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    upper = tops.withColumn("above", prefix).join(parents, "above", "left").join(sums, "path")
    upper = upper.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    return finished.drop("path").unionByName(upper)


def _finished(rows: DataFrame) -> DataFrame:
    """The nodes of all small buckets, each with its bucket's ``path``; a bucket's rows come to one task, one bucket after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in NODE.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()]

        def made(nodes: list[tuple], paths: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.list_(pa.int64())), *[pa.array(c, k) for c, k in zip(zip(*nodes, strict=True), kinds, strict=True)]], ["path", *names])

        held: list[tuple] = []
        head, out, paths = None, [], []
        for batch in batches:
            for path, depth, parent, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and path != head[0]:
                    nodes = _finish(held, *head[1:])
                    out += nodes
                    paths += [head[0]] * len(nodes)
                    held = []
                    if len(out) >= 5000:
                        yield made(out, paths)
                        out, paths = [], []
                head = path, depth, parent
                held.append(tuple(row))
        if held:
            nodes = _finish(held, *head[1:])
            yield made(out + nodes, paths + [head[0]] * len(nodes))

    columns = ["path", "depth", "parent", "first", "n", "ends", "numbers", "bytes"]
    return rows.select(*columns).repartition("path").sortWithinPartitions("path").mapInArrow(run, f"path array<bigint>, {NODE}")


def prefix_trie(turns: DataFrame, local_numbers: int = LOCAL_NUMBERS, rebuild: bool = True) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``conv_id, turn, role, text``, a row per turn. Turns are ordered by ``turn`` (null first), then role,
    then text; repeated rows are turns of their own. Null role and text count as empty. Rows without a ``conv_id``
    belong to no conversation and are not read further. The numbers of a conversation's turns (not their texts) stand
    in one row. An empty table has no conversation, so no root either. Other columns are never read.

    With ``rebuild`` the conversations are those of ``rebuilt``, else the ones given.
    """
    convs = cut(numbered(turns))
    convs = cut(rebuilt(convs)) if rebuild else convs
    return trie(distinct_rows(convs), local_numbers)


def op13_query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM t),
crc(c, k, v) AS (
  SELECT c, 0, 4294967295::BIGINT FROM ids
  UNION ALL SELECT c, k + 1, list_reduce([xor(v, ord(CAST(c AS VARCHAR)[k + 1])::BIGINT)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) FROM crc WHERE k < length(CAST(c AS VARCHAR))),
h AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM crc WHERE k = length(CAST(c AS VARCHAR))),
b AS (SELECT h.c, t.s, t.i FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.i <= h UNION ALL SELECT h.c, t.s, t.i FROM h JOIN t ON t.c = h.c AND t.i > h),
q AS (SELECT c, list(s ORDER BY i) AS q FROM b GROUP BY c UNION ALL SELECT c, [] FROM ids WHERE c NOT IN (SELECT c FROM b)),
m AS (SELECT c, q, unnest(range(len(q) + 1)) AS d FROM q),
n AS (SELECT q[1:d] AS p, d, min(c) AS c, count(*) AS n, string_agg(CASE WHEN len(q) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS e FROM m GROUP BY ALL),
w AS (SELECT *, CASE WHEN d > 0 THEN (n - 1) * octet_length(encode(p[d].t)) ELSE 0 END AS saved, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.p[1:n.d] = n.p) AS kids FROM n),
s AS (SELECT a.p, a.d, count(*) FILTER (z.kids = 0) AS leaves, sum(z.saved) AS saved FROM w a JOIN w z ON z.d >= a.d AND z.p[1:a.d] = a.p GROUP BY ALL)
SELECT w.c AS conv_id, w.d::BIGINT AS depth, u.c AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(w.e, '')) AS ends_sha256
FROM w JOIN s ON s.p = w.p AND s.d = w.d LEFT JOIN n u ON u.d = w.d - 1 AND u.p = w.p[1:w.d - 1]
"""
