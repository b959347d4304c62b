"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech, other). Small transducers read the
symbols of a clause: one remembers a negation, one reported speech, one a target. Composed, their states say in
which reading an insult or threat stands; a clause scores its matches by reading, and a document's score is a
logistic function of its clauses' scores. Which words are insults, and the weights, are learned from labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
#: Words of the closed classes, for the four languages.
TARGETS = "you your yours u ur he she they them him her his their these those people du dich dir ihr euch sie tu toi vous te ton votre tú usted vosotros ustedes ti"
NEGATIONS = "not no never nobody isn aren wasn weren don doesn didn cannot nicht kein keine nie niemals pas jamais aucun nunca jamás ningún"
REPORTS = "said says say told tells called calls wrote writes quoted claims claimed allegedly sagte sagt schrieb dit disait écrit dijo dice escribió"
THREATS = "kill hurt destroy attack murder shoot stab burn beat töten verletzen schlagen tuer frapper détruire matar golpear destruir"
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


class Transducer:
    """States 0, 1, ..., from each of which a symbol leads to another; symbols not named stay."""

    def __init__(self, steps: dict[tuple[int, int], int], states: int = 2):
        self.steps, self.states = steps, states

    def step(self, state: int, symbol: int) -> int:
        return self.steps.get((state, symbol), state)


#: A second negation takes the first back; the other two stay on to the clause's end.
MACHINES = {"negated": Transducer({(0, NEGATION): 1, (1, NEGATION): 0}), "reported": Transducer({(0, REPORT): 1}), "targeted": Transducer({(0, TARGET): 1})}


def compose(machines: list[Transducer]) -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """The product machine: its states, and for each the next state by symbol."""
    states = list(product(*[range(m.states) for m in machines]))
    number = {s: i for i, s in enumerate(states)}
    return states, [[number[tuple(m.step(x, symbol) for m, x in zip(machines, s, strict=True))] for symbol in range(6)] for s in states]


STATES, STEPS = compose(list(MACHINES.values()))
READINGS = ("plain", "targeted", "negated", "reported")
FEATURES = tuple(f"{kind}_{r}" for kind in ("insult", "threat") for r in READINGS) + ("strongest", "rate", "hits", "log_words")


@dataclass
class Grammar:
    """Insult stems with their weights (the longest that begins a word counts), and the weights of a document's figures."""

    stems: dict[str, float]
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0
    means: list[float] = field(default_factory=list)
    scales: list[float] = field(default_factory=list)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - np.array(self.means)) / np.array(self.scales)) @ np.array(self.coefficients) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Reader:
    """Reads texts by a grammar. Words seen before are kept in a table of a bounded size."""

    def __init__(self, stems: dict[str, float], table_limit: int = 300_000):
        self.stems, self.limit, self.longest = stems, table_limit, max(map(len, stems), default=0)
        self.fixed = {w: (k, 1.0) for k, listed in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in listed.split()} | {x: (-1, 0.0) for x in ".!?;:\n"}
        self.table = dict(self.fixed)

    def _symbol(self, token: str) -> tuple[int, float]:
        if len(self.table) > self.limit:
            self.table = dict(self.fixed)
        marked = f"^{token}$"
        found = next((self.stems[marked[:k]] for k in range(min(len(marked), self.longest), 1, -1) if marked[:k] in self.stems), None)
        self.table[token] = out = (OTHER, 0.0) if found is None else (INSULT, found)
        return out

    def features(self, text: str) -> list[float]:
        tokens = TOKEN.findall(text.lower())
        table = self.table
        symbols = [table.get(t) or self._symbol(t) for t in tokens]
        totals, strongest, hits, words, state = [0.0] * 8, 0.0, 0, 0, 0
        clause: list[tuple[int, float, int]] = []
        for kind, weight in [*symbols, (-1, 0.0)]:
            if kind == OTHER:
                words += 1
            elif kind < 0:  # the clause ends: a target anywhere in it counts for all of its matches
                for match, w, at in clause:
                    negated, reported, _ = STATES[at]
                    reading = 3 if reported else 2 if negated else 1 if STATES[state][2] else 0
                    totals[reading + 4 * (match == THREAT)] += w
                    if match == INSULT and not (negated or reported):
                        strongest, hits = max(strongest, w), hits + 1
                clause, state = [], 0
            else:
                words += 1
                if kind in (INSULT, THREAT):
                    clause.append((kind, weight, state))
                state = STEPS[state][kind]
        evidence = totals[0] + totals[1]
        return [*[min(x, 40.0) ** 0.5 for x in totals], strongest, min(20.0, 100.0 * evidence / (words + 20.0)) ** 0.5, float(min(hits, 10)), float(np.log1p(words))]


def _stem_counts(labelled: DataFrame, longest: int, most_per_document: int) -> DataFrame:
    """``stem``, documents and (capped) occurrences by label: whole words and word beginnings of the labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                docs, times = (Counter(), Counter()), (Counter(), Counter())
                for toxic, text in zip(*map(pa.Array.to_pylist, batch.slice(at, 200).columns), strict=True):
                    stems: Counter = Counter()
                    for word, n in Counter(TOKEN.findall(text.lower())).items():
                        if len(word) > 1:
                            marked = f"^{word}$"
                            for k in range(4, min(len(marked), longest) + 1):
                                stems[marked[:k]] += n
                            if len(marked) > longest:
                                stems[marked] += n
                    docs[toxic].update(stems.keys())
                    times[toxic].update({s: min(n, most_per_document) for s, n in stems.items()})
                found = list(docs[0].keys() | docs[1].keys())
                yield pa.RecordBatch.from_pydict({"stem": pa.array(found, pa.string()), **{name: pa.array([c[k][s] for s in found], pa.int64()) for name, c in (("docs", docs), ("times", times)) for k in (0, 1) for name in [f"{name}{k}"]}})

    rows = labelled.select("toxic", "text").mapInArrow(run, "stem string, docs0 bigint, docs1 bigint, times0 bigint, times1 bigint")
    return rows.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("docs0", "docs1", "times0", "times1")])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, max_stems: int = 3000, least_docs: int = 4, least_odds: float = 2.0, longest: int = 10, ridge: float = 1.0) -> Grammar:
    """A grammar from labelled rows: ``labels`` has ``doc_id, toxic``.

    At most ``max_labelled`` labels, chosen by a hash of the id, take part; what comes to the driver is their
    figures (a dozen numbers each) and at most ``max_stems`` stems. Labels that are null, or of no document, are
    ignored; of an id's repeats one counts. With no labels of either kind every score is 0.5 at most.
    """
    named = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    labelled = cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id"))
    totals = {r["toxic"]: r for r in labelled.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    if set(totals) != {0, 1}:
        return Grammar({"": 0.0}, [0.0] * len(FEATURES), -5.0, [0.0] * len(FEATURES), [1.0] * len(FEATURES))
    # The base rate of a stem's occurrences: the two kinds' shares of all text.
    base = float(np.log((totals[1]["chars"] + 1) / (totals[0]["chars"] + 1)))
    odds = F.log((F.col("times1") + 0.5) / (F.col("times0") + 0.5)) - base
    spread = F.log((F.col("docs1") + 0.5) / (F.col("docs0") + 0.5)) - float(np.log((totals[1]["n"] + 1) / (totals[0]["n"] + 1)))
    counts = _stem_counts(labelled, longest, 3).where(F.col("docs1") >= least_docs).withColumns({"odds": odds, "spread": spread})
    best = counts.where((F.col("odds") >= least_odds) & (F.col("spread") >= 1.0)).orderBy(F.desc(F.col("odds") * F.sqrt("docs1")), "stem").limit(max_stems).collect()
    stems = {r["stem"]: min(6.0, r["odds"]) for r in best}
    rows = _featured(labelled, stems, ["toxic"]).collect()
    y = np.array([r["toxic"] for r in rows], float)
    x = np.array([r["features"] for r in rows], float)
    means, scales = x.mean(0), np.maximum(x.std(0), 1e-6)
    scales[x.std(0) < 1e-6] = 1.0
    z = np.c_[np.ones(len(y)), (x - means) / scales]
    w, penalty = np.zeros(z.shape[1]), np.r_[1e-6, np.full(z.shape[1] - 1, ridge)]
    for _ in range(50):  # Newton's method for ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Grammar(stems, w[1:].tolist(), float(w[0]), means.tolist(), scales.tolist())


def _featured(rows: DataFrame, stems: dict[str, float], keep: list[str]) -> DataFrame:
    rows = rows.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stems)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [reader.features(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.list_(pa.float64()))], [*keep, "features"])

    return rows.mapInArrow(run, f"{schema}, features array<double>")


def toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``doc_id, score, predicted``.

    Null text counts as empty; an empty text gets the score of a text without matches. Texts are read whole. Rows
    are independent, so equal and repeated rows get equal scores; an empty table gives none; other columns are
    never read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(grammar.stems)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = grammar.score(np.array([reader.features(t) for t in part.column(1).to_pylist()]).reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))})

    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Whether the id's CRC-32 is a multiple of five: such rows teach nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def taught(spark, sf_dir: str, docs: DataFrame | None = None) -> Grammar:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    return fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out()))


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = toxicity(docs, taught(spark, sf_dir, docs))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
