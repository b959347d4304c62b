"""WARC archives, and capture histories by an external merge of index runs.

Records are written by Spark's own text writer, so archives can be in any store that Spark writes and a failed
task's file never shows. Each archive is inflated record by record and gives a run of index entries, sorted where it
was read. Runs are dealt out by ranges of (URL key, time, id, place), as many as keep a range at a bounded number of
entries, however many captures a URL has; Spark's own sort, which spills, lays the parts of the runs out one after the
other, and a loser tree merges each range from them.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_same, shared_folder

NEWLINE = "\r\n"
#: Payloads from this many bytes on are stored once.
LEAST_BYTES = 100
#: So many rows at most are broadcast when equal payloads are looked up; beyond it the lookup is a shuffle join.
MOST_BROADCAST = 50_000
#: About so many index entries make a range, which one task holds: more entries make more ranges.
ENTRIES_PER_RANGE = 200_000


class LoserTree:
    """Merges sorted runs: each match's loser stays in the tree, so an entry costs one comparison a level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.next = [0] * self.k
        self.losers = [-1] * max(1, self.k)
        if self.k:
            self.winner = self._build(1)

    def _key(self, run: int) -> tuple:
        i = self.next[run]
        return (0, self.runs[run][i]) if i < len(self.runs[run]) else (1,)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._key(b) < self._key(a):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        if not self.k:
            return
        while self.next[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield self.runs[run][self.next[run]]
            self.next[run] += 1
            node = (run + self.k) // 2
            while node:
                if self._key(self.losers[node]) < self._key(run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def url_key(url: str) -> str:
    """The host's labels in reverse, then port and path; scheme, ``www.``, case of the host, fragment and a last slash do not count."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:www\d*\.)?([^/:?#]*)(:\d+)?([^#]*)", url)
    host, port, path = m[1].lower(), m[2] or "", m[3]
    return f"{','.join(reversed(host.split('.')))}{port}){path.rstrip('/') or '/'}"


def _header(value: Column) -> Column:
    """A header's value on one line."""
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def described(pages: DataFrame) -> DataFrame:
    """Adds to ``page_id, url, html`` the payload's size and digest, ``record_type`` and ``refers_to``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"payload_bytes": F.octet_length("html").cast("bigint"), "payload_digest": F.sha2("html", 256)})
    equal = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first_id")
    equal = cut(equal)
    equal = F.broadcast(equal) if equal.count() <= MOST_BROADCAST else equal
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(equal, "payload_digest", "left").select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, records_per_file: int = 4000) -> None:
    """One record per row of ``page_id, url, html`` to gzip-compressed archives below ``path``.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of at least 100 bytes that with the
    smallest id is a response; the others are revisits without payload that name it. Rows repeated with the same id
    and payload are responses all, as are rows without an id that no other row has the payload of. A null url is an
    empty one; line ends in it are percent-encoded. A page's time follows from its id. Other columns are never read.
    """
    rows = described(pages)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{NEWLINE}Content-Type: text/html; charset=utf-8{NEWLINE}Content-Length: "), F.col("payload_bytes"), F.lit(NEWLINE * 2))
    block = F.when(F.col("record_type") == "revisit", head).otherwise(F.concat(head, "html"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    name_of = lambda c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(":", F.lit("record"), number(c), "payload_digest")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))
    fields = [
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", name_of("page_id")), ("WARC-Date", stamp), ("WARC-Target-URI", _header(F.col("url"))),
        ("WARC-Refers-To", F.when(F.col("record_type") == "revisit", name_of("refers_to"))), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), ("X-Page-ID", number("page_id")), ("X-Refers-To-Page-ID", number("refers_to")),
        ("WARC-Profile", F.when(F.col("record_type") == "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length("block").cast("string")),
    ]
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v, F.lit(NEWLINE))).otherwise(F.lit("")) for name, v in fields]
    record = F.concat(F.lit(f"WARC/1.1{NEWLINE}"), *lines, F.lit(NEWLINE), "block", F.lit(NEWLINE))
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", NEWLINE).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of one archive, by their content lengths; of the inflated archive one record is in memory at a time.

    A response whose payload has another digest than it says is an error, as is an archive that ends within a record.
    """
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    at = 0
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        lines, read = [], len(version)
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"the record at byte {at} is cut off")
            lines.append(line.removesuffix(b"\r\n"))
            read += len(line)
        fields = {k.decode().lower(): v.decode() for k, _, v in (line.partition(b": ") for line in lines)}
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"the record at byte {at} is cut off")
        head, _, payload = block.partition(b"\r\n\r\n")
        digest = fields["warc-payload-digest"].partition(":")[2]
        said = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        if fields["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != said):
            raise ValueError(f"the payload of the record at byte {at} is damaged")
        yield {"offset": at, "fields": fields, "payload": payload, "payload_bytes": said, "payload_digest": digest}
        at += read + 2 + size + len(stream.read(4))


ENTRY = "url_key string, captured_at string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, archive string, offset bigint"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below ``path``, each archive's sorted and numbered (``seq``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                archive = archive.as_py()
                rows = []
                for r in parse_warc(content.as_py()):
                    f = r["fields"]
                    number = lambda k: int(f[k]) if f.get(k) else None  # noqa: B023, E731
                    rows.append((url_key(f["warc-target-uri"]), f["warc-date"], number("x-page-id"), f["warc-target-uri"], f["warc-type"], number("x-refers-to-page-id"), r["payload_bytes"], r["payload_digest"], archive, r["offset"]))
                rows.sort(key=_order)
                if rows:
                    yield pa.Table.from_pandas(pd.DataFrame(rows, columns=NAMES).assign(seq=range(len(rows))).astype({"page_id": "Int64", "refers_to": "Int64"}), preserve_index=False).to_batches()[0]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"{ENTRY}, seq bigint")


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[8], entry[9]


def capture_histories(spark: SparkSession, path: str, ranges: int | None = None) -> DataFrame:
    """All index entries in global order (URL key, time, id, place): partition after partition, each merged from its runs."""
    entries = cut(index_runs(spark, path))
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // ENTRIES_PER_RANGE))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                runs.setdefault(row[8], []).append((_order(row), row))
        done: list[tuple] = []
        for _, row in LoserTree(list(runs.values())):
            done.append(row[:10])
            if len(done) == 5000:
                yield batch_of(done)
                done = []
        if done:
            yield batch_of(done)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

    dealt = entries.repartitionByRange(ranges, "url_key", "captured_at", "page_id", "archive", "offset")
    return dealt.sortWithinPartitions("archive", "seq").mapInArrow(merge, ENTRY)


def op10_query(spark, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return capture_histories(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM q
"""
