"""SentencePiece encoding and decoding through a table of distinct chunks.

In a vocabulary no piece of which has a white-space marker after another character, no merge crosses from one
marked word into the next: a marked word (its markers and what follows them) has the same ids wherever it stands.
Each Arrow batch's distinct marked words are segmented once, in one call, and ids are joined back by position.
Rows never move between tasks, so there is nothing to skew and a lost executor's batches are simply made again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


class ChunkEncoder:
    """Encodes whole texts as ``SentencePieceProcessor.encode(text, add_eos=True)`` does."""

    def __init__(self, model_path: str, table_limit: int = 200_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.table: dict[str, tuple[list[int], str]] = {}
        self.table_limit = table_limit
        sp = self.sp
        crossing = any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))
        probe = "ab  ﬁ c "  # any change to the characters would show
        self.chunked = not crossing and sp.decode(sp.encode(probe)) == probe
        self.table[MARK] = [sp.piece_to_id(MARK)], str(sp.piece_to_id(MARK))  # a text cannot ask for it: no text, no marker

    def _fill(self, chunks: set[str]) -> None:
        if len(self.table) > self.table_limit:  # a cache: what goes is only segmented again
            self.table = {MARK: self.table[MARK]}
        new = [c for c in chunks if c not in self.table]
        for c, ids in zip(new, self.sp.encode([c[1:] for c in new], num_threads=1), strict=True):
            self.table[c] = ids, " ".join(map(str, ids))

    @staticmethod
    def split(text: str) -> list[str]:
        """The marked words of the text as the model sees it; joined, they are the whole of it."""
        if not text:
            return []
        parts = (MARK + text.replace(" ", MARK)).split(MARK)[1:]
        if "" not in parts:
            return [MARK + p for p in parts]
        out, marks = [], ""
        for p in parts:
            marks += MARK
            if p:
                out.append(marks + p)
                marks = ""
        return out + [marks] if marks else out

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """For each text its ids with the end id last, and the same as decimal numbers joined by one space."""
        end = self.sp.eos_id()
        if not self.chunked:
            for ids in self.sp.encode(texts, num_threads=1):
                ids = [*ids, end]
                yield ids, " ".join(map(str, ids))
            return
        split = [self.split(t) for t in texts]
        self._fill(set(chain.from_iterable(split)))
        table = self.table
        for chunks in split:
            found = [table[c] for c in chunks]
            ids = list(chain.from_iterable([x[0] for x in found]))
            ids.append(end)
            yield ids, " ".join([*[x[1] for x in found], str(end)])


def _pieces_of(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about so many characters together, to bound what is held at once."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t)
        if held >= chars:
            yield run
            run, held = [], 0
    if run:
        yield run


def sentencepiece_roundtrip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_output: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` and ``decoded``.

    Null text counts as empty and has the end id alone. Rows are independent: ties and repeated rows each get
    their row, an empty table gives none, and columns other than the two named are never read. ``model_path`` is
    read on each executor.
    """
    outputs = ", ids array<int>, decoded string" if with_output else ""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkEncoder(model_path)
        for batch in batches:
            at = 0
            for texts in _pieces_of(batch.column(1).to_pylist()):
                n, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
                for ids, said in coder.encode(texts):
                    back = coder.sp.decode(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(said.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_output:
                        all_ids.append(ids)
                        decoded.append(back)
                columns = {"doc_id": batch.column(0).slice(at, len(texts)), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                if with_output:
                    columns |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
                at += len(texts)
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{outputs}")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_query(spark, sf_dir: str) -> DataFrame:
    return sentencepiece_roundtrip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model(), with_output=False)
