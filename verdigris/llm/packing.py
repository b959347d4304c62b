"""Best-fit packing of token pieces into sequences of a fixed length, planned by bin completion.

How pieces share sequences depends on their lengths alone. So the plan is made from the number of pieces of each
length, at most ``capacity`` numbers for any corpus, and says which ranks of each length go where; a piece finds its
place by its rank among the pieces of its length. Ranks are counted where pieces are made, and by a running sum over
the parts of the table, so that a length of which there are very many is never gathered.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bin_completion import Step, complete
from .common import cut, text_or_empty

CAPACITY = 2048
#: Chunks longer than this are not kept in the table of chunks.
LONGEST_KEPT = 64
#: Marks that end a word, which they share no token with.
ENDS = frozenset(".,;:!?")


#: What a byte-level vocabulary writes bytes as: printable Latin-1 characters as themselves, the others as those from U+0100 on, in order.
SHOWN = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
SHOWN |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


class ChunkIds(dict):
    """Packed ids (little-endian unsigned 32 bits) of chunks, as the tokenizer gives them; called with a text, those of the whole text.

    A vocabulary that drops white space has nothing that reaches over a space, a tab or a line end, so what stands
    between those has the same ids everywhere: each such chunk is encoded once and kept. If it splits words from the
    marks behind them and folds capitals, a word in other company needs no encoding of its own, and small Latin letters
    go to the merges as they are. The table has two halves of bounded size: what is asked for again moves from the older
    to the newer, and when that is full it becomes the older.
    """

    def __init__(self, path: str, most_kept: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most_kept = Tokenizer.from_file(path), most_kept
        self.older: dict[str, bytes] = {}
        self[""] = b""
        said = lambda *parts: [i for p in parts for i in self.tokenizer.encode(p, add_special_tokens=False).ids]
        self.chunked = said("Two wörds, here.\n\tNext  one ") == said("Two", "wörds,", "here.", "Next", "one")
        self.simple = said("Éa, b.", "abc1.", "zürichàñß") == said("éa", ",", "b", ".", "abc1", ".") + self._merged("zürichàñß")

    def _merged(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(SHOWN))]

    def __missing__(self, chunk: str) -> bytes:
        latin = self.simple and max(chunk) < "\u0130"  # below, a small letter is what it is in any company
        if latin and (small := chunk.lower()) != chunk:
            again, ids = small in self, self[small]
        elif self.simple and chunk[-1] in ENDS and chunk[-2:-1].isalnum():
            again, ids = chunk[:-1] in self, self[chunk[:-1]] + self[chunk[-1]]
        else:
            again, ids = True, self.older.get(chunk)
            if ids is None:
                ids = array("I", self._merged(chunk) if latin and chunk.isalpha() else self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if again and len(chunk) <= LONGEST_KEPT:  # a word that came once has no other forms in the table
            if len(self) >= self.most_kept:
                self.older = dict(self)
                self.clear()
                self[""] = b""
            self[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.chunked:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


_CODERS: dict[str, ChunkIds] = {}


def coder_of(path: str) -> ChunkIds:
    """The tables of this worker, which its next task goes on with."""
    return _CODERS.get(path) or _CODERS.setdefault(path, ChunkIds(path))


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of each document's ids, cut where they exceed the capacity, with ``part, nth``: the piece's number among those of its length in its part of the table."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    outputs = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = coder_of(tokenizer_path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for begins in range(0, batch.num_rows, 500):
                at, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
                for i, text in enumerate(batch.column(1).slice(begins, 500)):
                    data = coder(text.as_py()) + end
                    for k, s in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[s : s + 4 * capacity]
                        n = len(own) // 4
                        at.append(begins + i)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        nth.append(seen[n])
                        seen[n] += 1
                        if with_ids:
                            ids.append(np.frombuffer(own, dtype="<u4").astype(np.int32))
                columns = {
                    "doc_id": batch.column(0).take(pa.array(at, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array([part] * len(at), pa.int32()), "nth": pa.array(nth, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint{outputs}")


def places(plan: list[Step]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``length, low, high, sequence, copies, place``: of the pieces of a length those with ranks from low to high (exclusive) go, so many copies each, to the sequences from that one on, the first of the copies at that place."""
    out, ranks, sequence = [], {}, 0
    for times, content in plan:
        place = 0
        for length in sorted(content, reverse=True):
            copies = content[length]
            low = ranks.get(length, 0)
            ranks[length] = low + times * copies
            out.append((length, low, ranks[length], sequence, copies, place))
            place += copies * length
        sequence += times
    return out


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, most_nodes: int = 4000, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    A document is its ids and then ``end_id``; one of over ``capacity`` ids is cut into pieces of that many, the last
    of which may be shorter. Sequences are numbered from 0; pieces stand in them without gaps.

    Null text counts as empty, and an empty document is the end id alone. Rows are independent: equal ids or repeated
    rows are documents of their own, a null id is kept. An empty table gives no rows. Other columns are never read.
    """
    spark = docs.sparkSession
    # Written, so that a part keeps its rows and numbers whatever is computed again later.
    pieces = cut(pieces_of(docs, tokenizer_path, capacity, end_id, with_ids))
    counts = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    # A step uses up a length or is one state of the search: the plan is bounded, and so is what is broadcast.
    plan = spark.createDataFrame(places(complete(histogram, capacity, most_nodes)), "of_length bigint, low bigint, high bigint, sequence bigint, copies bigint, place bigint")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    own = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(own / F.col("copies"))).cast("bigint").alias("sequence_id"),
        (F.col("place") + own % F.col("copies") * F.col("length")).alias("offset"), *["ids"] * with_ids,
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
