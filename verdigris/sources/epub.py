"""E-books in ZIP containers: admission within limits, package, spine and the documents in reading order."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .html import blocks_of, title_of

#: The limits of a container, and the media types of readable documents.
MOST_BYTES, MOST_MEMBERS, MOST_MEMBER_BYTES, MOST_TOTAL = 200 << 20, 20_000, 100 << 20, 750 << 20
READABLE = ("application/xhtml+xml", "text/html")
CONTAINER = "META-INF/container.xml"
FALLBACKS = ("utf-8-sig", "utf-8", "gb18030")


class Refused(ValueError):
    """Why a container is not read."""


def decode_xml(data: bytes) -> tuple[str, bool]:
    """The text, and whether characters were lost: the declared encoding, a UTF-16 mark, then the usual ones in turn."""
    declared = re.match(rb"\s*<\?xml[^>]*encoding=[\"']([^\"']+)", data[:300], re.I)
    tried = [declared[1].decode("ascii", "ignore")] if declared else []
    tried += ["utf-16"] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else []
    for name in (*tried, *FALLBACKS):
        try:
            return data.decode(name), False
        except (LookupError, UnicodeDecodeError):
            pass
    return data.decode("utf-8", "replace"), True


def _tree(data: bytes) -> list[tuple[str, dict[str, str], str]]:
    """All elements in order: name without namespace, attributes, own text."""
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", decode_xml(data)[0].lstrip("﻿"))
    try:
        root = ElementTree.fromstring(text.lstrip())
    except ElementTree.ParseError as e:
        raise Refused("invalid-xml") from e
    return [(x.tag.rpartition("}")[2], x.attrib, (x.text or "").strip()) for x in root.iter() if isinstance(x.tag, str)]


def admitted(data: bytes) -> zipfile.ZipFile:
    """The opened container, if it keeps all limits; nothing is inflated to find out."""
    if len(data) > MOST_BYTES:
        raise Refused("too-large")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Refused("not-a-zip") from e
    members = archive.infolist()
    paths = [posixpath.normpath(m.filename.replace("\\", "/")) if ".." not in m.filename.replace("\\", "/").split("/") else "/" for m in members]
    for reason, broken in (
        ("too-many-members", len(members) > MOST_MEMBERS), ("unsafe-path", any(p.startswith("/") for p in paths)), ("member-too-large", any(m.file_size > MOST_MEMBER_BYTES for m in members)),
        ("inflates-too-much", sum(m.file_size for m in members) > MOST_TOTAL), ("no-package", not any(m.filename == CONTAINER or m.filename.lower().endswith(".opf") for m in members)),
    ):
        if broken:
            raise Refused(reason)
    return archive


def package_path(archive: zipfile.ZipFile) -> str:
    """The first root file of the container document that exists, else the first package by name."""
    names = archive.namelist()
    if CONTAINER in names:
        roots = [unquote(a["full-path"]) for name, a, _ in _tree(archive.read(CONTAINER)) if name == "rootfile" and a.get("full-path")]
        there = [r for r in roots if r in names]
        if there:
            return there[0]
    packages = sorted(n for n in names if n.lower().endswith(".opf"))
    if not packages:
        raise Refused("no-package")
    return packages[0]


@dataclass
class Package:
    title: str
    authors: list[str]
    language: str | None
    identifiers: list[str]
    items: list[tuple[str, str, str, str]]  # id, href, media type, properties, in manifest order
    spine: list[str]


def package(archive: zipfile.ZipFile) -> Package:
    path = package_path(archive)
    elements = _tree(archive.read(path))
    said = lambda wanted: [text for name, _, text in elements if name == wanted and text]
    place = lambda href: posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote(href.partition("#")[0])))
    items = [(a["id"], place(a["href"]), a.get("media-type", ""), a.get("properties", "")) for name, a, _ in elements if name == "item" and a.get("id") and a.get("href")]
    return Package((said("title") or ["Untitled"])[0], said("creator"), (said("language") or [None])[0], said("identifier"), items, [a["idref"] for name, a, _ in elements if name == "itemref" and a.get("idref")])


_PARTS = "path string, status string, reason string, kind string, position int, id string, href string, media_type string, properties string, title string, authors array<string>, language string, identifiers array<string>"


def epub_parts(files: DataFrame) -> DataFrame:
    """Manifest items and spine references of each container (``path, content``), with the book's own metadata; a row with the reason for one that is refused."""

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        try:
            if not path.lower().endswith(".epub"):
                raise Refused("not-an-epub")
            p = package(admitted(data))
        except (Refused, KeyError, zipfile.BadZipFile) as e:
            yield (path, "rejected", str(e) if isinstance(e, Refused) else "unreadable", *[None] * 10)
            return
        book = (p.title, p.authors, p.language, p.identifiers)
        for i, item in enumerate(p.items):
            yield (path, "accepted", None, "item", i, *item, *book)
        for i, ref in enumerate(p.spine):
            yield (path, "accepted", None, "ref", i, ref, None, None, None, *book)

    return _read(files, rows, _PARTS)


def _read(files: DataFrame, rows, ddl: str) -> DataFrame:
    schema = files.sparkSession.createDataFrame([], ddl).schema
    names = schema.names
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a container at a time: each can be large
                found = list(rows(*[c[i].as_py() for c in batch.columns]))
                columns = zip(*found, strict=True) if found else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select(F.col("path"), F.coalesce("content", F.lit("").cast("binary")).alias("content")).mapInArrow(run, schema)


def reading_order(parts: DataFrame) -> DataFrame:
    """``path, spine_index, id, href``: spine joined to manifest, each href once at its first place; without any, the manifest's readable documents but for the navigation."""
    good = parts.where("status = 'accepted'")
    items = good.where("kind = 'item'").select("path", "id", "href", "media_type", "properties", F.col("position").alias("item_position"))
    items = items.groupBy("path", "id").agg(F.max_by(F.struct("href", "media_type", "properties", "item_position"), "item_position").alias("x"), F.min("item_position").alias("listed")).select("path", "id", "x.href", "x.media_type", "x.properties", "listed")
    spine = good.where("kind = 'ref'").select("path", "id", "position").join(items, ["path", "id"]).select("path", "id", "href", "position")
    spine = spine.withColumn("n", F.row_number().over(Window.partitionBy("path", "href").orderBy("position"))).where("n = 1").drop("n")
    readable = items.where(F.col("media_type").isin(*READABLE) & ~F.array_contains(F.split("properties", "\\s+"), "nav"))
    rest = readable.join(spine.select("path").distinct(), "path", "left_anti").select("path", "id", "href", F.col("listed").alias("position"))
    order = F.row_number().over(Window.partitionBy("path").orderBy("position")) - 1
    return spine.unionByName(rest).select("path", order.alias("spine_index"), "id", "href")


def epub_documents(files: DataFrame) -> DataFrame:
    """``path, spine_index, href, title, lossy, blocks``: the documents of accepted containers in reading order; those without text are kept, with no blocks."""
    order = reading_order(epub_parts(files)).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("spine_index", "href"))).alias("spine"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data, spine in zip(*batch.columns, strict=True):
                archive, names = admitted(data.as_py()), None
                names = set(archive.namelist())
                for x in spine.as_py():
                    text, lossy = decode_xml(archive.read(x["href"])) if x["href"] in names else ("", False)
                    found = blocks_of(text)
                    yield pa.RecordBatch.from_pydict({
                        "path": pa.array([path.as_py()]), "spine_index": pa.array([x["spine_index"]], pa.int32()), "href": pa.array([x["href"]]), "title": pa.array([title_of(found)], pa.string()),
                        "lossy": pa.array([lossy]), "blocks": pa.array([[t for _, t in found]], pa.list_(pa.string())),
                    })

    joined = files.select("path", "content").join(order, "path")
    return joined.mapInArrow(run, "path string, spine_index int, href string, title string, lossy boolean, blocks array<string>")
