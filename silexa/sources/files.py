"""Feeds and books in files, read through Spark data sources: a partition for each file, whose entries or chapters are read one after another.

    files.register(spark)
    spark.read.format("silexa_feed").load("file:///feeds")
    spark.read.format("silexa_book").load("hdfs:///books")

``path`` is a file, or a folder with all that is below it (names that begin with ``.`` or ``_`` are left out), on any file system that Arrow opens by its address.
The list of the files is made by the driver, names only. A file that cannot be read to its end gives what stands before the damage and then a row with ``error``; with the option
``mode`` set to ``FAILFAST`` it fails the query. An empty folder gives an empty result.
"""

from __future__ import annotations

import posixpath
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from silexa.session import shared_folder

#: Fixed names of the formats' parts.
_ENTRIES = {"item", "entry"}
_CONTAINER = "META-INF/container.xml"
#: What a damaged file raises; other faults, those of the file system among them, fail the task so that Spark runs it again.
_DAMAGE = (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, KeyError, pa.ArrowInvalid)


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """File system and place of an address; ``file:/x`` and ``file:///x`` are the same."""
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)


class File(InputPartition):
    """One file below the address of a read."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FileReader(DataSourceReader):
    """Rows (path, pos, ...) of one file in a task; ``parts`` gives what follows them."""

    def __init__(self, options: dict[str, str], width: int):
        self.address, self.strict, self.width = options["path"], options.get("mode", "").upper() == "FAILFAST", width

    def partitions(self) -> list[File]:
        system, place = opened(self.address)
        if system.get_file_info(place).is_file:
            return [File(place)]
        found = system.get_file_info(fs.FileSelector(place, recursive=True))
        hidden = lambda p: any(n[:1] in "._" for n in posixpath.relpath(p, place).split("/"))
        # A reader must have a partition: one without a file gives no rows.
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not hidden(f.path)] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.path:
            return
        pos = 0
        try:
            with opened(self.address)[0].open_input_file(partition.path) as file:
                for row in self.parts(file):
                    yield (partition.path, pos, *row, None)
                    pos += 1
        except _DAMAGE as damage:
            if self.strict:
                raise
            yield (partition.path, pos, *[None] * self.width, str(damage))

    def parts(self, file) -> Iterator[tuple]:
        raise NotImplementedError


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _day(written: str) -> str | None:
    """The day of a time as either kind of feed writes it, in UTC where it names a zone."""
    if written[:4].isdigit():
        return written[:10]
    try:
        when = parsedate_to_datetime(written)
    except ValueError:
        return None
    return (when - when.utcoffset() if when.utcoffset() else when).date().isoformat()


class FeedReader(FileReader):
    def parts(self, file) -> Iterator[tuple]:
        above: list = []
        for event, element in ElementTree.iterparse(file, events=("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if _name(element.tag) not in _ENTRIES:
                continue
            have: dict[str, str] = {}
            for child in element:
                name = _name(child.tag)
                have.setdefault(name, child.text or (child.get("href", "") if name == "link" else ""))
            # What has been read is let go, so that a feed may have any number of entries.
            for e in above:
                e.clear()
            title, link, video, day = (have.get(n, "").strip() for n in ("title", "link", "videoId", "published" if "published" in have else "pubDate"))
            if title and (link or video):
                yield link or None, title, video or None, _day(day) if day else None, have.get("description") or have.get("summary")


class BookReader(FileReader):
    def parts(self, file) -> Iterator[tuple]:
        with zipfile.ZipFile(file) as z:
            root = next((e.get("full-path") for e in ElementTree.fromstring(z.read(_CONTAINER)).iter() if _name(e.tag) == "rootfile"), None)
            if root is None:
                raise KeyError("no package in " + _CONTAINER)
            package = list(ElementTree.fromstring(z.read(root)).iter())
            places = {e.get("id"): e.get("href") for e in package if _name(e.tag) == "item"}
            for e in package:
                if _name(e.tag) == "itemref" and e.get("idref") in places:
                    yield (z.read(posixpath.join(posixpath.dirname(root), places[e.get("idref")])).decode("utf-8", "replace"),)


class FeedSource(DataSource):
    """Entries of RSS and Atom files that have a title and a link or video id."""

    @classmethod
    def name(cls) -> str:
        return "silexa_feed"

    def schema(self) -> str:
        return "path string, pos int, link string, title string, video_id string, published string, description string, error string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options, 5)


class BookSource(DataSource):
    """Chapters of EPUB files in reading order, as html."""

    @classmethod
    def name(cls) -> str:
        return "silexa_book"

    def schema(self) -> str:
        return "path string, pos int, html string, error string"

    def reader(self, schema) -> BookReader:
        return BookReader(self.options, 1)


def register(spark: SparkSession) -> None:
    for source in (FeedSource, BookSource):
        spark.dataSource.register(source)


def xml_text(c: Column) -> Column:
    """Text as it stands in XML; characters that XML cannot hold go, line ends stay what they are."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def write_files(files: DataFrame, kind: str) -> str:
    """``files`` (name, content as binary) written by the tasks to a new folder of the shared one; gives its address.

    A file appears under its name only when it is whole, so a task that is run again leaves nothing half written.
    """
    base = f"{shared_folder(files.sparkSession)}/{kind}/{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = opened(base)
        system.create_dir(place, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{place}/_{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{place}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    files.select("name", "content").mapInArrow(run, "name string").count()
    return base


def as_feeds(items: DataFrame, atom: Column) -> DataFrame:
    """(name, content): a feed for each ``feed`` of ``items`` (feed, pos, link, title, published, description), Atom where ``atom`` of the feed holds, else RSS."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), xml_text(c), F.lit(f"</{name}>"))
    head, rest = tag("title", F.col("title")), F.col("description")
    entry = F.concat(F.lit("<entry>"), head, F.lit('<link href="'), F.replace(xml_text(F.col("link")), F.lit('"'), F.lit("&quot;")), F.lit('"/>'), tag("published", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'")), tag("summary", rest), F.lit("</entry>"))
    day = F.concat(F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    item = F.concat(F.lit("<item>"), head, tag("link", F.col("link")), tag("pubDate", day), tag("description", rest), F.lit("</item>"))
    rows = items.select("feed", atom.alias("atom"), F.struct("pos", F.when(atom, entry).otherwise(item).alias("x")).alias("x"))
    rows = rows.groupBy("feed", "atom").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["x"]), "\n").alias("body"))
    whole = F.when(F.col("atom"), F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "body", F.lit("</feed>"))).otherwise(F.concat(F.lit("<rss><channel>"), "body", F.lit("</channel></rss>")))
    return rows.select(F.concat("feed", F.lit(".xml")).alias("name"), F.encode(whole, "UTF-8").alias("content"))


def as_books(chapters: DataFrame) -> DataFrame:
    """(name, content): an EPUB file for each ``book`` of ``chapters`` (book, pos, html)."""

    @F.pandas_udf("binary")
    def packed(books):
        import io

        import pandas as pd

        def one(pages) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(_CONTAINER, '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
                items = "".join(f'<item id="c{i}" href="c{i}.xhtml"/>' for i in reversed(range(len(pages))))
                z.writestr("OPS/book.opf", f"<package><manifest>{items}</manifest><spine>{''.join(f'<itemref idref="c{i}"/>' for i in range(len(pages)))}</spine></package>")
                for i, page in enumerate(pages):
                    z.writestr(f"OPS/c{i}.xhtml", page or "")
            return out.getvalue()

        return pd.Series([one(b) for b in books])

    rows = chapters.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("pos", "html"))).alias("c"))
    return rows.select(F.concat("book", F.lit(".epub")).alias("name"), packed(F.transform("c", lambda x: x["html"])).alias("content"))
