"""Token counts by trie-shared dynamic programming.

A text is cut into pre-tokens (a word with the marker of the space before it). The batch's distinct pre-tokens are
inserted into a trie; a depth-first walk keeps the best unigram score of every prefix on the path, so a prefix
shared by many words is scored once, and a terminal node stores the token count of its word.

Scores are log-probabilities of a unigram model. A merge vocabulary has no such scores, only the order in which its
pieces were made, most frequent first; the probability of its piece of rank r follows from the Zipf-Mandelbrot law,
proportional to 1 / (r + shift). Nothing is learned from the corpus, so counts do not change with it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MARK, default_model

PRE_TOKEN = re.compile(r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]")


class TrieCounter:
    """Counts of the best unigram segmentation, for sets of pre-tokens.

    A piece's score is the log-probability of its rank (``ranked``, for vocabularies of merges), or else the model's
    own score. A character can fall back to its UTF-8 bytes, each one token that is as likely as the last of 256
    further ranks. Of segmentations with equal scores that with fewer tokens counts.
    """

    def __init__(self, model_path: str, ranked: bool = True, shift: float = 2.7):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.longest = max(map(len, self.pieces))
        self.byte_score = min(self.pieces.values()) - 10.0
        if ranked:
            order = sorted(self.pieces, key=lambda p: (-self.pieces[p], p))
            weights = [1 / (rank + shift) for rank in range(1, len(order) + 257)]
            log_total = math.log(sum(weights))
            self.pieces = {p: math.log(w) - log_total for p, w in zip(order, weights, strict=False)}
            self.byte_score = math.log(weights[-1]) - log_total

    def counts(self, pre_tokens: set[str]) -> dict[str, int]:
        """The count of each pre-token. The trie's nodes are the distinct prefixes, visited in order."""
        out: dict[str, int] = {}
        score, count = [0.0], [0]  # of the prefixes on the path from the root
        before, pieces, longest = "", self.pieces, self.longest
        for word in sorted(pre_tokens):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode("utf-8", "surrogatepass"))
                best, tokens = score[end - 1] + n * self.byte_score, count[end - 1] + n
                for start in range(max(0, end - longest), end):
                    s = pieces.get(word[start:end])
                    if s is not None:
                        s += score[start]
                        if s > best or s == best and count[start] + 1 < tokens:
                            best, tokens = s, count[start] + 1
                score.append(best)
                count.append(tokens)
            out[word] = count[len(word)]
            before = word
        return out


def pre_tokens(text: str) -> list[str]:
    """Words, each with a marker in front; white space other than a single space before a word stands alone."""
    out, gap = [], True  # a text starts as after a space
    for part in PRE_TOKEN.findall(text):
        if part == " ":
            if gap:
                out.append(MARK)
            gap = True
        elif part.isspace() and part in "\t\n\x0b\x0c\r":
            if gap and out:
                out.append(MARK)
            out.append(part)
            gap = False
        else:
            out.append(MARK + part if gap else part)
            gap = False
    if gap and text:
        out.append(MARK)
    return out


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", table_limit: int = 300_000) -> DataFrame:
    """One row per input row: ``doc_id, n_pre_tokens, n_tokens``.

    Null and empty texts have no tokens. Words are counted whole, however long. Rows are independent, so repeated
    rows each get their row; an empty table gives none; columns other than the two named are never read. Counts of
    words seen before are kept between batches in a table of at most about ``table_limit`` words.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = TrieCounter(model_path), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                split = [Counter(pre_tokens(t)) for t in part.column(1).to_pylist()]
                if len(known) > table_limit:
                    known = {}
                known |= trie.counts(set().union(*split) - known.keys())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_pre_tokens": pa.array([sum(c.values()) for c in split], pa.int64()), "n_tokens": pa.array([sum(known[w] * n for w, n in c.items()) for c in split], pa.int64())})

    return rows.mapInArrow(run, f"doc_id {kind}, n_pre_tokens bigint, n_tokens bigint")


def op6_query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
