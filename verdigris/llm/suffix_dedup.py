"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts in an earlier document go.

1. Each window of ``length`` bytes chooses an anchor, the gram in it with the least hash: equal windows have equal
   anchors. A run of windows with one anchor is a segment. Only numbers are sent, packed: a segment's anchor, a
   digest of its bytes, its document and its place there. Equal segments of one batch are combined before that: all
   but those of the smallest id are known to go.
2. Dealt out by anchor, equal segments meet: those of a larger id than the smallest go. Where an anchor has
   different segments in different documents, the bytes of each one's first document are asked for.
3. These are sorted by their suffixes (linear grouping construction); windows that stand next to each other in that
   order and are equal get the smallest id of all of them. All windows of an anchor contain its gram, so the gram
   is one symbol of the sorted string. An anchor with very many different segments is sorted in blocks, and equal
   windows of its blocks are then merged.
4. A document loses the windows whose smallest id is below its own; its runs are merged and cut out.

Nothing but the documents themselves, once, and the bytes asked for is shuffled as text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import in_bitmap, repeated_bitmap
from .suffix_grouping import suffix_order

#: Bytes of the grams that windows choose from, and of a document handled at a time.
GRAM, PIECE = 24, 1 << 20
#: Segments that a batch combines before it sends them, and bytes of text whose segments are matched in one group.
COMBINED, BUCKET = 1_000_000, 8 << 20
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 2**63, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_BYTES = _rng.integers(0, 2**63, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 24) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD[7]
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every GRAM bytes: hashes of 2, 4, 8 and 16 bytes by doubling, and of 24 from 16 and 8."""
    h, width = _TABLE[data], 1
    eight = h
    while width < 16:
        h = h[:-width] * _ODD[width.bit_length()] + h[width:]
        width *= 2
        eight = h if width == 8 else eight
    return _mixed(h[: len(data) - GRAM + 1] * _ODD[6] + eight[16 : 16 + len(data) - GRAM + 1])


class Segments:
    """The runs of windows with one anchor, piece by piece."""

    def __init__(self, length: int):
        self.length, self.span = length, length - GRAM + 1
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.powers) < n:
            n = min(2 * n, PIECE + self.length)
            for name, base in (("powers", int(_ODD[0])), ("inverse", pow(int(_ODD[0]), -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, text: bytes, digests: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """For each piece of the text: its offset, and for each segment there the first window, the last, the anchor's place and hash, and the digest."""
        length, span = self.length, self.span
        for base in range(0, max(len(text) - length + 1, 0), PIECE):
            data = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - base), base)
            h = gram_hashes(data)
            least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while width * 2 <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
            anchor = (least & _LOW).astype(np.int64)
            first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            last = np.r_[first[1:] - 1, len(anchor) - 1]
            made = None
            if digests:
                self._powers(len(data))
                sums = np.cumsum(_BYTES[data] * self.powers[: len(data)])
                before = np.where(first > 0, sums[first - 1], 0)
                made = (sums[last + length - 1] - before) * self.inverse[first] + (last - first).astype(np.uint64) * _ODD[1]
                made = _mixed(made ^ (made >> np.uint64(31)))
            yield base, first, last, anchor[first], h[anchor[first]], made


def _small(x: np.ndarray) -> bytes:
    """Numbers of which neighbours are alike, packed."""
    return zlib.compress(np.diff(x.astype(np.int64), prepend=0).tobytes(), 1)


def _wide(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(x), np.int64))


def _joined(table: pa.Table | pa.RecordBatch, name: str, unpack) -> np.ndarray:
    return np.concatenate([unpack(x.as_py()) for x in table.column(name)])


def _dealt(keys: np.ndarray, columns: dict[str, tuple[np.ndarray | None, bool]]) -> Iterator[pa.RecordBatch]:
    """One row per key with each column's numbers packed (as small differences if its flag is set, else raw); nothing where there are none."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[at[1:], len(keys)]
    moved = {name: (None if x is None else x[order], small) for name, (x, small) in columns.items()}
    for i in range(0, len(at), 64):
        spans = list(zip(at[i : i + 64].tolist(), ends[i : i + 64].tolist(), strict=True))
        packed = {name: pa.array([b"" if x is None else _small(x[a:b]) if small else x[a:b].tobytes() for a, b in spans], pa.binary()) for name, (x, small) in moved.items()}
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys[at[i : i + 64]], pa.int64()), **packed})


_PACKED = "key bigint, grams binary, digests binary, docs binary, tags binary, places binary"
_ASKED = "key bigint, docs binary, tags binary, places binary, parts binary"
_FOUND = "doc_id bigint, tag bigint, places binary, parts binary"


def _segments_of(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Packed segments, by anchor bucket; under keys below zero those that are known to go, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(length)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text, seen = text.as_py(), 0
                for _, first, _, _, h, made in segments(text, True):
                    n = len(first)
                    held.append((h, made, np.full(n, doc), np.full(n, tag), np.arange(seen, seen + n)))
                    seen += n
                    size += n
                if size > COMBINED:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, made, doc, tag, place = map(np.concatenate, zip(*held, strict=True))
        order = np.argsort(h + made * _ODD[2], kind="stable")
        x, y = h[order], made[order]
        start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        low = np.empty(len(h), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(doc[order], start), np.diff(np.r_[start, len(h)]))
        first = doc == low
        yield from _dealt((h[first] >> np.uint64(32)).astype(np.int64) % buckets, {
            "grams": ((h[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32), False), "digests": (made[first], False),
            "docs": (doc[first], True), "tags": (tag[first], True), "places": (place[first], True),
        })
        rest = ~first
        yield from _dealt(-1 - doc[rest] % buckets, {"grams": (None, False), "digests": (None, False), "docs": (doc[rest], True), "tags": (tag[rest], True), "places": (place[rest], True)})

    return rows.mapInArrow(run, _PACKED)


def _matched(packed: DataFrame, buckets: int, most_segments: int) -> DataFrame:
    """``doc_id, tag, places, parts``, one row per document: its segments that go (part -1) and that are asked for (part 0, of a crowded anchor 1, 2, ...)."""

    def match(table: pa.Table) -> pa.Table:
        doc, tag, place = (_joined(table, c, _wide) for c in ("docs", "tags", "places"))
        if table.column("key")[0].as_py() < 0:
            part = np.full(len(doc), -1)
        else:
            gram = _joined(table, "grams", lambda x: np.frombuffer(x, np.uint32))
            made = _joined(table, "digests", lambda x: np.frombuffer(x, np.uint64))
            order = np.lexsort((made, gram))
            gram, made, doc, tag, place = gram[order], made[order], doc[order], tag[order], place[order]
            new_gram = np.r_[True, gram[1:] != gram[:-1]]
            kinds = np.flatnonzero(new_gram | np.r_[True, made[1:] != made[:-1]])  # where each different segment starts
            low = np.minimum.reduceat(doc, kinds)
            anchors = np.flatnonzero(new_gram[kinds])
            n = np.diff(np.r_[anchors, len(kinds)])
            several = np.minimum.reduceat(low, anchors) != np.maximum.reduceat(low, anchors)
            rank = np.arange(len(kinds)) - np.repeat(anchors, n)
            wanted = np.where(np.repeat(several, n), np.where(np.repeat(n > most_segments, n), 1 + rank // most_segments, 0), -2)
            sizes = np.diff(np.r_[kinds, len(doc)])
            part = np.where(doc > np.repeat(low, sizes), -1, np.repeat(wanted, sizes))
            keep = part > -2
            doc, tag, place, part = doc[keep], tag[keep], place[keep], part[keep]
            order = np.argsort(doc, kind="stable")
            doc, tag, place, part = doc[order], tag[order], place[order], part[order]
        made = list(_dealt(doc % buckets, {"docs": (doc, True), "tags": (tag, True), "places": (place, True), "parts": (part, True)}))
        return pa.Table.from_batches(made, _schema(_ASKED))

    def gather(table: pa.Table) -> pa.Table:
        doc, tag, place, part = (_joined(table, c, _wide) for c in ("docs", "tags", "places", "parts"))
        order = np.lexsort((place, tag, doc))
        doc, tag, place, part = doc[order], tag[order], place[order], part[order]
        at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        ends = np.r_[at[1:], len(doc)]
        spans = list(zip(at.tolist(), ends.tolist(), strict=True))
        return pa.table({"doc_id": pa.array(doc[at], pa.int64()), "tag": pa.array(tag[at], pa.int64()), "places": pa.array([_small(place[a:b]) for a, b in spans], pa.binary()), "parts": pa.array([_small(part[a:b]) for a, b in spans], pa.binary())})

    return packed.groupBy("key").applyInArrow(match, _ASKED).groupBy("key").applyInArrow(gather, _FOUND)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _spans(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that windows of ``width`` bytes at the ordered places ``at`` cover."""
    new = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + width])
    return at[new], at[np.r_[new[1:], len(at)] - 1] + width


_SEGMENT = "key bigint, part int, doc_id bigint, tag bigint, gram int, segment binary, starts binary"


def _fetched(wanted: DataFrame, length: int) -> DataFrame:
    """Rows of ``doc_id, tag, text, places, parts`` to the segments asked for (with where in them the gram is, and all their starts), and a row with the spans that go at once (part -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, out, size = Segments(length), [], 0
        for batch in batches:
            for doc, tag, text, places, parts in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                place, part = _wide(places), _wide(parts)
                found = [(base + first, base + last, base + anchor, h) for base, first, last, anchor, h, _ in segments(text)]
                first, last, anchor, h = (np.concatenate(x)[place] for x in zip(*found, strict=True))
                gone = part == -1
                if gone.any():
                    a, n = first[gone], (last - first)[gone] + length
                    new = np.flatnonzero(np.r_[True, a[1:] > (a + n)[:-1]])  # a segment starts one byte after the one before, so ends are in order too
                    ends = (a + n)[np.r_[new[1:], len(a)] - 1]
                    out.append((doc, -1, doc, tag, 0, None, np.r_[a[new], ends].tobytes()))
                asked: dict[tuple[int, int, int, bytes], list[int]] = {}
                left = ~gone
                for a, b, q, x, p in zip(first[left].tolist(), last[left].tolist(), anchor[left].tolist(), h[left].view(np.int64).tolist(), part[left].tolist(), strict=True):
                    asked.setdefault((x, p, q - a, text[a : b + length]), []).append(a)
                out += [(x, p, doc, tag, q, segment, np.array(starts).tobytes()) for (x, p, q, segment), starts in asked.items()]
                size += len(text)
                if size > 4 << 20:
                    yield rows(out)
                    out, size = [], 0
        if out:
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        schema = _schema(_SEGMENT)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return wanted.mapInArrow(run, _SEGMENT)


def window_owners(parts: list[tuple[int, bytes, int, int]], length: int) -> list[np.ndarray]:
    """For each segment (number of its group, bytes, where its gram is, id), the smallest id that each of its windows has in any of its group: one suffix order of all, in which equal windows are neighbours."""
    width, whole, owner, starts, places = length - GRAM + 1, [], [], [], []
    for group, p, q, doc in parts:
        n = len(p) - length + 1
        places.append((len(owner), n))
        starts.append(np.arange(len(whole), len(whole) + n))
        owner.append(doc)
        whole += p[:q]
        whole.append(256 + group)
        whole += p[q + GRAM :]
        whole.append(255)  # in no UTF-8
    n = np.array([n for _, n in places])
    owners = np.repeat(np.array(owner, np.int64), n)
    at = np.concatenate(starts)
    text = np.array(whole, np.int32)
    number = np.full(len(text), -1)
    number[at] = np.arange(len(at))
    order = number[np.array(suffix_order(whole, 257 + max(p[0] for p in parts)))]
    order = order[order >= 0]
    windows = np.lib.stride_tricks.sliding_window_view(text, width)[at[order]]
    run = np.flatnonzero(np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)])
    least = np.empty(len(at), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owners[order], run), np.diff(np.r_[run, len(order)]))
    return np.split(least, np.cumsum(n)[:-1])


def _trimmed(group: list[tuple], length: int) -> list[tuple[bytes, int, int, int]]:
    """``segment, gram, offset, row``: what of the group's segments another one can have as well.

    A window has half of what is beside its gram on one side at least; a segment has no window in common with
    another unless it has the gram with that much on its left, or on its right, in common with one.
    """
    beside = length - GRAM
    half = beside // 2
    lefts = [s[q - half : q + GRAM] if q >= half else None for *_, q, s, _ in group]
    rights = [s[q : q + GRAM + beside - half] if len(s) - q - GRAM >= beside - half else None for *_, q, s, _ in group]
    left_n, right_n = Counter(lefts), Counter(rights)
    out = []
    for i, (x, y, row) in enumerate(zip(lefts, rights, group, strict=True)):
        q, s = row[4], row[5]
        left, right = x is not None and left_n[x] > 1, y is not None and right_n[y] > 1
        cut = max(0, q - half) if right and not left else 0
        s = s[cut : q + GRAM + beside - half] if left and not right else s[cut:]
        if (left or right) and len(s) >= length:
            out.append((s, q - cut, cut, i))
    return out


_SOLVED = "key bigint, docs binary, tags binary, starts binary, ends binary, lows binary, high binary, low binary"


def _solved(segments: DataFrame, length: int, buckets: int, block: int) -> DataFrame:
    """Spans that go, packed by document (keys below zero), and windows of crowded anchors, packed by their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[tuple, tuple[bytes, int, int, int]]] = []  # row, and what is left of it
        numbers: list[int] = []
        group: list[tuple] = []
        size = groups = 0
        done: list[tuple[np.ndarray, ...]] = []  # doc, tag, start, end
        open_: list[tuple[np.ndarray, ...]] = []  # doc, tag, start, low, digest halves

        def solve() -> None:
            nonlocal ready, numbers, size, groups
            if ready:
                owners = window_owners([(g, s, q, row[2]) for g, (row, (s, q, _, _)) in zip(numbers, ready, strict=True)], length)
                for (row, (s, _, cut, _)), low in zip(ready, owners, strict=True):
                    doc, tag, starts = row[2], row[3], np.frombuffer(row[6], np.int64) + cut
                    if row[1]:
                        digests = np.frombuffer(b"".join(hashlib.md5(s[k : k + length]).digest() for k in range(len(low))), np.uint64).reshape(-1, 2)
                        at = (starts[:, None] + np.arange(len(low))).ravel()
                        many = np.tile(np.arange(len(low)), len(starts))
                        open_.append((np.full(len(at), doc), np.full(len(at), tag), at, low[many], digests[many, 0], digests[many, 1]))
                    else:
                        at = np.flatnonzero(low < doc)
                        if len(at):
                            a, e = _spans(at, length)
                            a, e = (starts[:, None] + a).ravel(), (starts[:, None] + e).ravel()
                            done.append((np.full(len(a), doc), np.full(len(a), tag), a, e))
            ready, numbers, size, groups = [], [], 0, 0

        def close() -> None:
            nonlocal size, groups, group
            if len(group) > 1 or group and group[0][1]:
                kept = [(s, q, 0, i) for i, (*_, q, s, _) in enumerate(group)] if group[0][1] else _trimmed(group, length)
                grams: dict[bytes, int] = {}  # one, unless hashes meet by chance
                for x in kept:
                    ready.append((group[x[3]], x))
                    numbers.append(groups + grams.setdefault(x[0][x[1] : x[1] + GRAM], len(grams)))
                    size += len(x[0])
                groups += len(grams)
            group = []
            if size >= block:
                solve()

        def flush() -> Iterator[pa.RecordBatch]:
            if done:
                doc, tag, a, e = map(np.concatenate, zip(*done, strict=True))
                yield from _dealt(-1 - doc % buckets, {"docs": (doc, True), "tags": (tag, True), "starts": (a, True), "ends": (e, True), "lows": (None, False), "high": (None, False), "low": (None, False)})
            if open_:
                doc, tag, a, low, x, y = map(np.concatenate, zip(*open_, strict=True))
                yield from _dealt((x >> np.uint64(1)).astype(np.int64) % buckets, {"docs": (doc, True), "tags": (tag, True), "starts": (a, True), "ends": (None, False), "lows": (low, True), "high": (x, False), "low": (y, False)})
            done.clear()
            open_.clear()

        now = None
        for batch in batches:
            for row in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                if row[1] == -1:
                    spans = np.frombuffer(row[6], np.int64)
                    a, e = spans[: len(spans) // 2], spans[len(spans) // 2 :]
                    done.append((np.full(len(a), row[2]), np.full(len(a), row[3]), a, e))
                    continue
                if row[:2] != now:
                    close()
                    now = row[:2]
                group.append(row)
            if len(done) + len(open_) > 50_000:
                yield from flush()
        close()
        solve()
        yield from flush()

    return segments.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, _SOLVED)


_SPANS = "doc_id bigint, tag bigint, starts binary, ends binary"


def _merged(solved: DataFrame, length: int) -> DataFrame:
    """``doc_id, tag, starts, ends``: spans that go, some rows per document; equal windows of a crowded anchor's blocks meet here."""

    def run(table: pa.Table) -> pa.Table:
        doc, tag, a = (_joined(table, c, _wide) for c in ("docs", "tags", "starts"))
        if table.column("key")[0].as_py() < 0:
            e = _joined(table, "ends", _wide)
        else:
            low = _joined(table, "lows", _wide)
            x, y = (_joined(table, c, lambda b: np.frombuffer(b, np.uint64)) for c in ("high", "low"))
            order = np.lexsort((y, x))
            start = np.flatnonzero(np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])
            least = np.empty(len(low), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(low[order], start), np.diff(np.r_[start, len(low)]))
            gone = least < doc
            doc, tag, a = doc[gone], tag[gone], a[gone]
            e = a + length
        order = np.lexsort((a, tag, doc))
        doc, tag, a, e = doc[order], tag[order], a[order], e[order]
        at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]) if len(doc) else np.zeros(0, np.int64)
        spans = list(zip(at.tolist(), np.r_[at[1:], len(doc)].tolist(), strict=True)) if len(at) else []
        return pa.table({"doc_id": pa.array(doc[at], pa.int64()), "tag": pa.array(tag[at], pa.int64()), "starts": pa.array([_small(a[i:j]) for i, j in spans], pa.binary()), "ends": pa.array([_small(e[i:j]) for i, j in spans], pa.binary())})

    return solved.groupBy("key").applyInArrow(run, _SPANS)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, buckets: int | None = None, most_segments: int = 2_000, block: int = 4_000) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary, what is left of the text).

    Texts are taken as UTF-8 bytes, null as empty; matches never cross documents and are judged on the input. Ids
    must be whole numbers. Rows of one id never take from each other, and each loses what smaller ids have. Rows
    with a null id are returned whole, and take no part. Texts under ``length`` bytes (at least 28) lose nothing. An
    empty table gives an empty result; other columns are never read.

    ``most_segments`` is how many different segments of one anchor are sorted together; blocks of an anchor with more
    are merged by the digests (MD5) of their windows. Equal segments are told by an anchor and a digest of 64 bits.
    """
    if length < GRAM + 4:
        raise ValueError(f"strings must have at least {GRAM + 4} bytes")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError("ids must be whole numbers")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    buckets = buckets or 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET
    again = repeated_bitmap(rows.where("doc_id is not null").select("doc_id"), ["doc_id"])
    named = in_bitmap(rows.where("doc_id is not null"), again, ["doc_id"], "__again")
    named = named.select("doc_id", F.when(F.col("__again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("tag"), "text")  # rows of a repeated id are told by their texts
    found = _matched(_segments_of(named, length, buckets), buckets, most_segments)
    wanted = named.join(found.hint("merge"), ["doc_id", "tag"], "left").where("places is not null").select("doc_id", "tag", "text", "places", "parts")
    spans = _merged(_solved(_fetched(wanted, length), length, buckets, block), length)
    spans = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("starts", "ends")).alias("spans"))
    result = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [_without(text.as_py(), found.as_py() or []) for text, found in zip(part.column(1), part.column(2), strict=True)]
                n_bytes, removed, runs, kept = map(list, zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary())})

    whole = F.octet_length("text").cast("bigint")
    unnamed = rows.where("doc_id is null").select("doc_id", whole.alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.col("text").alias("kept"))
    return named.join(spans.hint("merge"), ["doc_id", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(run, result).unionByName(unnamed)


def _without(text: bytes, found: list[dict]) -> tuple[int, int, int, bytes]:
    """Bytes, bytes removed, runs removed, and what is left."""
    if not found:
        return len(text), 0, 0, text
    edge = np.zeros(len(text) + 1, np.int32)
    for x in found:
        np.add.at(edge, _wide(x["starts"]), 1)
        np.add.at(edge, _wide(x["ends"]), -1)
    gone = np.cumsum(edge)[: len(text)] > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), len(text) - len(kept), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), kept


def op4_query(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
