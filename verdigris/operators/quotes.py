"""Where quotations stand: containment and fuzzy tiers, with explicit ambiguity. ``matching`` puts the tiers in a row."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions import text as X
from ..functions.text import search_form
from .grams import gram_hits

GRAM = 6
#: Quotes up to so many characters together are sent to every task.
MOST_CHARS = 1_000_000
#: Of the similarity of windows: quotes and characters of texts held at a time, places counted together, by block and by stride, bins of characters, and pieces of a quote.
TOGETHER, CHARS_AT_ONCE, BLOCK, STRIDE, BINS, PIECES = 256, 1_000_000, 16, 4, 32, 8
#: For each byte its lower and its upper four bits, each in 16 bits of one number.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint16).view(np.uint64).T.copy()
PADS = ["\0" * n for n in range(BLOCK)]


def quote_hits(quotes: DataFrame, paras: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """``item_id, locator``: paragraphs whose normalised text contains the normalised quote, each pair once.

    Quotes of at most ``most_chars`` characters together go to every task, which reads its paragraphs once: nothing
    but hits is shuffled. Beyond that bound both sides meet by grams.
    """
    return places(quotes.select("item_id", "text"), paras.select("locator", "text"), most_chars).select("item_id", "locator").distinct()


def places(quotes: DataFrame, paras: DataFrame, most_chars: int = MOST_CHARS, along: tuple[str, ...] = (), bare: bool = False) -> DataFrame:
    """``item_id, locator``, the columns ``along`` of the paragraph, ``titled, has``: as ``quote_hits``, but repeated pairs stay.

    ``titled`` is whether the paragraph's ``in_title`` contains the quote's ``title``, ``has`` whether its text contains
    the quote's ``beside``, where there are such columns. With ``bare``, paragraphs lose their punctuation first.
    """
    for name in ("title", "beside"):
        quotes = quotes.withColumn(name, X.normalize_search(F.coalesce(name, F.lit(""))) if name in quotes.columns else F.lit(""))
    if "in_title" not in paras.columns:
        paras = paras.withColumn("in_title", F.lit(""))
    q = quotes.select("item_id", X.normalize_search(F.col("text")).alias("quote"), "title", "beside").where(F.length("quote") > 0)
    chars = q.agg(F.sum(F.length("quote") + F.length("title") + F.length("beside"))).first()[0] or 0
    if chars <= most_chars:
        return _hits_by_scan(q, paras, along, punctuation(q.sparkSession) if bare and chars else "")
    norm = X.normalize_search(F.col("text"))
    p = paras.select("locator", (X.normalize_search(X.strip_punctuation(norm)) if bare else norm).alias("norm")).where(F.length("norm") > 0)
    hits = _hits_by_gram(q.select("item_id", "quote"), p).join(q.drop("quote").distinct(), "item_id").join(paras.select("locator", *along, "in_title", norm.alias("norm")), "locator")
    titled = (F.col("title") != "") & F.contains(X.normalize_search(F.coalesce("in_title", F.lit(""))), F.col("title"))
    return hits.select("item_id", "locator", *along, titled.alias("titled"), ((F.col("beside") != "") & F.contains("norm", "beside")).alias("has"))


def punctuation(spark: SparkSession) -> str:
    """The characters that ``strip_punctuation`` takes away, as the JVM knows them."""
    known = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if (kind := unicodedata.category(c)) != "Cs" and (c < "\U00020000" or kind not in ("Cn", "Co")))
    return "".join(set(known).difference(spark.range(1).select(X.strip_punctuation(F.lit(known))).first()[0]))


def _hits_by_scan(q: DataFrame, paras: DataFrame, along: tuple[str, ...], dropped: str) -> DataFrame:
    """All quotes are looked for at once, by an automaton that each task builds from them."""
    items: dict[str, list] = {}
    for item, quote, title, beside in q.distinct().collect():
        items.setdefault(quote, []).append((item, title, beside))
    kind, told = q.schema["item_id"].dataType, ["locator", *along]
    arrow_kind = to_arrow_type(kind)
    flags = [StructField("titled", BooleanType()), StructField("has", BooleanType())]
    schema = StructType([StructField("item_id", kind), *(paras.schema[x] for x in told), *flags])
    if not items:
        return q.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ahocorasick import Automaton

        find, drop = Automaton(), dict.fromkeys(map(ord, dropped))
        for quote in items:
            find.add_word(quote, quote)
        find.make_automaton()
        for batch in batches:
            found, at, titled, has = [], [], [], []
            for i, (text, head) in enumerate(zip(batch.column("text").to_pylist(), batch.column("in_title").to_pylist(), strict=True)):
                whole = norm = search_form(text or "")
                if drop:
                    norm = search_form(norm.translate(drop))
                for quote in {x for _, x in find.iter(norm)}:
                    for item, title, beside in items[quote]:
                        found.append(item)
                        at.append(i)
                        titled.append(title != "" and title in search_form(head or ""))
                        has.append(beside != "" and beside in whole)
            rows = batch.select(told).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(found, arrow_kind), *rows.columns, pa.array(titled, pa.bool_()), pa.array(has, pa.bool_())], schema.names)

    return paras.select(*dict.fromkeys([*told, "text", "in_title"])).mapInArrow(run, schema)


def _hits_by_gram(q: DataFrame, p: DataFrame) -> DataFrame:
    """All texts are one book here."""
    items = q.withColumns({"target": F.sha2("quote", 256), "seed": F.lit(0)})
    targets = items.groupBy("target").agg(F.first("seed").alias("seed"), F.first("quote").alias("norm"))
    return gram_hits(targets, p.withColumn("seed", F.lit(0))).join(items.select("target", "item_id"), "target").select("item_id", "locator").distinct()


def quote_status(quotes: DataFrame, paras: DataFrame) -> DataFrame:
    """Exact if one paragraph has the quote, ambiguous if several, not-found if none, empty if nothing is left of it."""
    hits = quote_hits(quotes, paras).groupBy("item_id").agg(F.countDistinct("locator").alias("n"), F.min("locator").alias("first"))
    rows = quotes.select("item_id", F.length(X.normalize_search(F.col("text"))).alias("chars")).join(hits, "item_id", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("chars") == 0, "empty").when((n == 1) & (F.col("chars") >= GRAM), "exact").when(n >= 1, "ambiguous").otherwise("not-found")
    return rows.select("item_id", status.alias("status"), n.cast("bigint").alias("candidate_count"), F.when(n == 1, F.col("first")).alias("locator"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slots(codes: np.ndarray) -> np.ndarray:
    """For each window of three characters its one of 2^18 slots."""
    return (codes[:-2] * np.uint32(2654435761) + codes[1:-1] * np.uint32(2246822519) + codes[2:] * np.uint32(3266489917)) >> np.uint32(14)


def _letters(text: str) -> dict[str, int]:
    """For each character the places it has in the text, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(letters: dict[str, int], size: int, text: str, need: float = 0) -> int:
    """The length of the longest common subsequence: one addition of long numbers a character. Ends early, with 0, where ``need`` is out of reach."""
    whole = free = (1 << size) - 1
    get = letters.get
    for at in range(0, len(text), 32):
        for c in text[at : at + 32]:
            found = free & get(c, 0)
            free = (free + found | free - found) & whole
        if size - free.bit_count() + max(0, len(text) - at - 32) < need:
            return 0
    return size - free.bit_count()


class _Group:
    """Some quotes, held against many texts at once.

    A ratio of r over s characters (quote and window) has M = r*s/2 matched ones or more, in at most (1-r)*s+1 blocks,
    since an unmatched character stands between two blocks. A block of n has n-2 windows of three, so (2.5*r-2)*s-2 of
    these or more are preserved. All that follows counts no less than that, so no window that reaches r is lost:

    1. places of the text's window whose three characters the quote has too, counted by whole blocks of places;
    2. characters in common in any order, by bins and from stride to stride of places, which are M or more;
    3. as 1, but by pieces of the quote. What is matched at i in the quote stands from i-u to i+v in the window, with u
       and v the unmatched characters of either side, so a piece is looked for there alone, and counts its own length at most;
    4. the longest common subsequence, which is M or more.
    """

    def __init__(self, quotes: list[tuple], admit: float):
        self.quotes, self.admit = quotes, admit
        codes = [_codes(q) for _, q in quotes]
        slots = [_slots(c) for c in codes]
        known = np.unique(np.concatenate(slots))
        self.ids = np.zeros(1 << 18, np.uint16 if len(known) < 65_535 else np.int32)
        self.ids[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(quotes)), np.uint8)
        self.pieces = np.zeros((len(quotes), len(known) + 1), np.uint8)
        for k, x in enumerate(slots):
            self.table[self.ids[x], k] = 1
            for m, (low, high) in enumerate(_cuts(len(x))):
                self.pieces[k, self.ids[x[low:high]]] |= 1 << m
        kinds, n = np.unique(np.concatenate(codes), return_counts=True)
        often = kinds[np.argsort(-n, kind="stable")][: BINS - 1]
        self.bins = np.full(0x110000, BINS - 1, np.uint8)
        self.bins[often] = np.arange(len(often))
        self.lengths = [len(c) for c in codes]
        self.widths = [n + max(4, n // 5) for n in self.lengths]
        self.kind = np.uint16 if max(self.widths) < 60_000 else np.uint32
        self.bags = np.array([np.bincount(self.bins[c], minlength=BINS) for c in codes]).astype(self.kind)
        self.letters = [_letters(q) for _, q in quotes]

    def least(self, k: int, width):
        """Windows of three that are preserved between the k-th quote and a similar window of so many characters."""
        return np.maximum(np.ceil((2.5 * self.admit - 2) * (self.lengths[k] + width) - 2 - 1e-6), 0)

    def similar(self, texts: list[str]) -> list[tuple]:
        least = min(self.lengths) * self.admit / (2 - self.admit) - 1e-3
        out, some, chars = [], [], 0
        for i, t in enumerate(texts):
            if len(t) >= least and t:
                some.append(i)
                chars += len(t)
                if chars >= CHARS_AT_ONCE:
                    out += self._some(texts, some)
                    some, chars = [], 0
        return out + (self._some(texts, some) if some else [])

    def _some(self, texts: list[str], some: list[int]) -> list[tuple]:
        lens = np.array([len(texts[i]) for i in some], np.int64)
        blocks = -(-lens // BLOCK)
        first = np.cumsum(blocks) - blocks
        total, wide = int(blocks.sum()), _over(max(self.widths))
        codes = _codes("".join(texts[i] + PADS[-len(texts[i]) % BLOCK] for i in some) + "\0\0")  # each text begins a block
        ids = self.ids[_slots(codes)].reshape(total, BLOCK)
        # Per quote, how many places before each block are of the quote.
        sums = np.empty((len(self.quotes), total), np.uint8)
        held = np.empty((256 * BLOCK, len(self.quotes)), np.uint8)
        for at in range(0, total, 256):
            part = ids[at : at + 256].ravel()
            np.take(self.table, part, axis=0, out=held[: len(part)], mode="clip")
            sums[:, at : at + 256] = np.add.reduce(held[: len(part)].reshape(-1, BLOCK, len(self.quotes)), axis=1, dtype=np.uint8).T
        before = np.zeros((len(self.quotes), total + 1 + wide), self.kind)
        np.cumsum(sums, axis=1, dtype=self.kind, out=before[:, 1 : total + 1])
        before[:, total + 1 :] = before[:, total : total + 1]
        del sums, held
        bags, bins = np.zeros((total * BLOCK // STRIDE + 1, BINS), self.kind), self.bins[codes[:-2]]
        for i in range(STRIDE):
            bags[np.arange(1, len(bags)), bins[i::STRIDE]] += 1
        np.cumsum(bags, axis=0, dtype=self.kind, out=bags)
        ids, of_block = np.r_[ids.ravel(), np.zeros(max(self.widths), np.int64)], np.repeat(np.arange(len(some)), blocks)
        order = np.argsort(lens, kind="stable")
        ranked = lens[order]
        out = []
        for k, (item, _) in enumerate(self.quotes):
            width = self.widths[k]
            # Shorter texts are one window each; of the others, the windows that begin in a block with enough after it.
            low, high = np.searchsorted(ranked, [self.lengths[k] * self.admit / (2 - self.admit) - 1e-3, width])
            which = order[low:high]
            which = which[(before[k, first[which] + blocks[which]] - before[k, first[which]]) >= self.least(k, lens[which])]
            starts, widths = np.zeros(len(which), np.int64), lens[which]
            if ranked[-1] >= width:
                over = _over(width)
                hit = np.flatnonzero(before[k, over : total + over] - before[k, :total] >= self.kind(self.least(k, width)))
                whole, begin = self._starts(k, hit, of_block, first, lens)
                which, starts, widths = np.concatenate([which, whole]), np.concatenate([starts, begin]), np.concatenate([widths, np.full(len(whole), width)])
            out += [(item, some[i], raw) for i, raw in self._best(k, which, starts, widths, texts, some, first, ids, bags).items() if raw >= self.admit]
        return out

    def _starts(self, k: int, hit: np.ndarray, of_block: np.ndarray, first: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that begin in these blocks: texts, and places in them."""
        which, step = of_block[hit], max(1, self.lengths[k] // 6)
        at, last = (hit - first[which]) * BLOCK, lens[which] - self.widths[k]
        found = [(last >= at) & (last < at + BLOCK) & (last % step != 0)]
        starts = [last[found[0]]]
        for i in range(-(-BLOCK // step)):
            s = (-(-at // step) + i) * step
            found.append((s < at + BLOCK) & (s <= last))
            starts.append(s[found[-1]])
        return np.concatenate([which[x] for x in found]), np.concatenate(starts)

    def _best(self, k: int, which: np.ndarray, starts: np.ndarray, widths: np.ndarray, texts: list[str], some: list[int], first: np.ndarray, ids: np.ndarray, bags: np.ndarray) -> dict[int, float]:
        """By text, the best ratio of the k-th quote to those of these windows that can be similar."""
        at, best = first[which] * BLOCK + starts, {}
        needs = (self.admit - 1e-9) * (self.lengths[k] + widths) / 2
        rows = np.flatnonzero(_dealt(lambda x: self._in_common(k, at[x], widths[x], bags), len(at), 2048) >= needs)
        if not len(rows):
            return best
        at, which, starts, widths, needs = at[rows], which[rows], starts[rows], widths[rows], needs[rows]
        rows = np.flatnonzero(_dealt(lambda x: self._pieces_held(k, at[x], widths[x], needs[x], ids), len(at), 512) >= self.least(k, widths))
        q = self.quotes[k][1]
        for i, s, width, need in zip(which[rows].tolist(), starts[rows].tolist(), widths[rows].tolist(), needs[rows].tolist(), strict=True):
            window = texts[some[i]][s : s + width]
            if _common(self.letters[k], len(q), window, need) >= need:
                best[i] = max(best.get(i, 0.0), SequenceMatcher(None, q, window).ratio())
        return best

    def _in_common(self, k: int, at: np.ndarray, widths: np.ndarray, bags: np.ndarray) -> np.ndarray:
        both = bags[(at + widths + STRIDE - 1) // STRIDE]
        both -= bags[at // STRIDE]
        np.minimum(both, self.bags[k], out=both)
        # Several bins are added at once: no sum is more than the quote's length, which fits into its place.
        return both.view(np.uint64).sum(1).view(self.kind).reshape(len(at), -1).sum(1)

    def _pieces_held(self, k: int, at: np.ndarray, widths: np.ndarray, needs: np.ndarray, ids: np.ndarray) -> np.ndarray:
        places = int(widths.max()) - 2
        if places < 1 or places > 60_000:
            return np.full(len(at), self.lengths[k])
        held = sliding_window_view(ids, places)[at]
        cuts = np.array(_cuts(max(0, self.lengths[k] - 2)))
        last = np.maximum(widths - 2, 0)[:, None]
        low = np.clip(cuts[:, 0] - np.ceil(self.lengths[k] - needs).astype(np.int64)[:, None], 0, last)
        high = np.clip(cuts[:, 1] + np.ceil(widths - needs).astype(np.int64)[:, None], 0, last)
        out, rows, shift = np.zeros(len(at), np.int64), np.arange(len(at))[:, None], np.arange(4, dtype=np.uint64) * np.uint64(16)
        upto = np.zeros((len(at), places + 1), np.uint64)
        for some, spread in ((slice(0, 4), SPREAD[0][self.pieces[k]]), (slice(4, 8), SPREAD[1][self.pieces[k]])):
            # Four counts in each number: they are added, and subtracted, all at once.
            np.cumsum(spread[held], axis=1, out=upto[:, 1:])
            found = upto[rows, high[:, some]] - upto[rows, low[:, some]] >> shift & np.uint64(0xFFFF)
            out += np.minimum(found.astype(np.int64), cuts[some, 1] - cuts[some, 0]).sum(1)
        return out


def _over(width: int) -> int:
    """How many blocks hold the windows of three of any window that begins in the first of them."""
    return (width + BLOCK - 4) // BLOCK + 1


def _dealt(f: Callable[[slice], np.ndarray], n: int, most: int) -> np.ndarray:
    """``f`` of so many rows at a time."""
    return np.concatenate([np.zeros(0, np.int64), *(f(slice(x, x + most)) for x in range(0, n, most))])


def _cuts(n: int) -> list[tuple[int, int]]:
    return [(n * m // PIECES, n * (m + 1) // PIECES) for m in range(PIECES)]


def grouped(quotes: list[tuple], admit: float) -> list[_Group]:
    """The quotes, of which none is empty, made ready for ``similar``."""
    return [_Group(quotes[k : k + TOGETHER], admit) for k in range(0, len(quotes), TOGETHER)]


def similar_windows(quotes: list[tuple], texts: list[str], admit: float) -> list[tuple]:
    """``item, i, raw`` for all pairs of a quote (item and text) and the i-th text whose best window has a ratio of ``admit`` or more."""
    return [x for group in grouped(quotes, admit) for x in group.similar(texts)]


def _similar(paras: DataFrame, kind, quotes: list[tuple], admit: float) -> DataFrame:
    """``item_id, locator, raw``: all similar pairs. Texts take their search form in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = grouped(quotes, admit)
        for batch in batches:
            texts = [search_form(t or "") for t in batch.column(1).to_pylist()]
            found = [x for group in groups for x in group.similar(texts)]
            items, places, raws = ([f[i] for f in found] for i in range(3))
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(items, to_arrow_type(kind)), "locator": batch.column(0).take(pa.array(places, pa.int64())), "raw": pa.array(raws, pa.float64())})

    return paras.select("locator", "text").mapInArrow(run, f"item_id {kind.simpleString()}, locator string, raw double")


def quote_fuzzy(quotes: DataFrame, paras: DataFrame, admit: float = 0.88, accept: float = 0.94, lead: float = 0.05, kept: int = 10, most_chars: int = MOST_CHARS) -> DataFrame:
    """Paragraphs similar to quotes of twelve characters or more: ranked, ten kept, the top one accepted if it leads.

    Every paragraph is held against every quote. Similarity is measured on the windows that can reach ``admit``.
    """
    q = quotes.select("item_id", X.normalize_search(F.col("text")).alias("quote")).where(F.length("quote") >= 12)
    blocks, chars = [[]], 0
    for r in q.toLocalIterator():
        chars += len(r["quote"])
        if blocks[-1] and chars > most_chars:
            blocks.append([])
            chars = len(r["quote"])
        blocks[-1].append((r["item_id"], r["quote"]))
    scored = reduce(DataFrame.unionByName, [_similar(paras, q.schema["item_id"].dataType, some, admit) for some in blocks]).distinct()
    # Scores are rounded before they are compared; of equal ones the earlier place is the better.
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "locator")
    rounded = scored.select("item_id", "locator", F.bround("raw", 4).alias("score"))
    ranked = rounded.select("*", F.row_number().over(order).alias("rank"), F.lead("score").over(order).alias("next"))
    won = (F.col("rank") == 1) & (F.col("score") >= accept) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= lead)
    return ranked.where(F.col("rank") <= kept).select("item_id", "locator", "score", "rank", won.alias("accepted"))


def match_partition(notes: DataFrame, matches: DataFrame) -> DataFrame:
    """Notes by what their match allows: routed (one sure place), unlocated, or not locatable."""
    joined = notes.join(matches, "item_id", "left")
    route = F.when(F.col("status").isNull() | (F.col("status") == "empty"), "non-locatable").when(F.col("status").isin("exact", "high-confidence") & (F.col("candidate_count") == 1), "routed").otherwise("unlocated")
    return joined.select("item_id", route.alias("route"))
