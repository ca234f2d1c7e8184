"""Feeds, files and captions as sources: what they hold as rows; nothing here opens a network connection."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silexa.functions import passages as P
from silexa.functions import text as X
from silexa.session import shared_folder

#: Where pages name their video, in order (fixed patterns).
VIDEO_PLACES = (r"youtube\.com/embed/([a-zA-Z0-9_-]{11})", r"youtu\.be/([a-zA-Z0-9_-]{11})", r"youtube\.com/watch\?v=([a-zA-Z0-9_-]{11})", r"\"videoId\"\s*:\s*\"([a-zA-Z0-9_-]{11})\"")
_SEGMENTS = "array<struct<text string, turn bigint, start string, dur string>>"


def _tag(c: Column, name: str) -> Column:
    inner = F.regexp_extract(c, rf"(?s)<{name}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
    return F.nullif(inner, F.lit(""))


def atom_entries(pages: DataFrame, key: str) -> DataFrame:
    """(key, video_id, title, published) of the entries that have id and title."""
    rows = pages.select(key, F.explode(F.slice(F.split("xml", "<entry>"), 2, 1 << 30)).alias("e"))
    rows = rows.select(key, _tag(F.col("e"), "yt:videoId").alias("video_id"), X.decoded(_tag(F.col("e"), "title")).alias("title"), F.substring(_tag(F.col("e"), "published"), 1, 10).alias("published"))
    return rows.filter("video_id IS NOT NULL AND title IS NOT NULL")


def rss_items(pages: DataFrame, key: str) -> DataFrame:
    """(link, title, key): each link once, as its first page in the order of the key has it first."""
    rows = pages.select(key, F.posexplode(F.slice(F.split("xml", "<item>"), 2, 1 << 30)).alias("pos", "e")).select(key, "pos", _tag(F.col("e"), "link").alias("link"), X.decoded(_tag(F.col("e"), "title")).alias("title"))
    return rows.filter("link IS NOT NULL").groupBy("link").agg(F.min(F.struct(key, "pos", "title")).alias("f")).select("link", "f.title", f"f.{key}")


def episodes(pages: DataFrame) -> DataFrame:
    """Pages (page_id, title, html) with a number in front, and the first video they name."""
    video = F.coalesce(*[F.nullif(F.regexp_extract("html", p, 1), F.lit("")) for p in VIDEO_PLACES])
    return pages.filter(F.rlike("title", F.lit(r"^#\d+"))).select("page_id", F.regexp_extract("title", r"^#(\d+)", 1).cast("int").alias("number"), video.alias("video_id"))


def caption_payload(reply: Column) -> Column:
    """The captions of a reply: those of its first track, else its own, else its texts, else none."""
    found = F.coalesce(*[F.get_json_object(reply, p) for p in ("$.tracks[0].transcript", "$.transcript", "$.text")], F.lit("[]"))
    return F.coalesce(F.from_json(found, _SEGMENTS), F.array().cast(_SEGMENTS))


def normal_captions(segments: Column) -> Column:
    """Captions (text, start, dur in seconds, as text) with text and milliseconds; those without text or time drop out."""
    half_up = lambda c: F.floor(c * 1000 + 0.5).cast("long")
    def one(s: Column) -> Column:
        start = F.greatest(F.lit(0), half_up(s["start"].try_cast("double")))
        return F.struct(F.trim(s["text"]).alias("text"), start.cast("long").alias("start_ms"), (start + F.greatest(F.lit(0), F.coalesce(half_up(s["dur"].try_cast("double")), F.lit(0)))).cast("long").alias("end_ms"))
    return F.transform(F.filter(segments, lambda s: (F.trim(s["text"]) != "") & s["start"].try_cast("double").isNotNull()), one)


def timed_chunks(captions: DataFrame, size: int, overlap: int) -> DataFrame:
    """(conv_id, pos, passage, start_ms, end_ms): the passages of each transcript with the times of the captions they overlap.

    A transcript is one row; a task holds one at a time.
    """
    rows = captions.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "start_ms", "end_ms"))).alias("c"))

    @F.pandas_udf("array<struct<passage string, start_ms bigint, end_ms bigint>>")
    def run(lists):
        import pandas as pd

        def one(c):
            own = [(x["text"], int(x["start_ms"]), int(x["end_ms"])) for x in c]
            parts = P.chunks(" ".join(x[0] for x in own), size, overlap)
            return [{"passage": p, "start_ms": None if w is None else w[0], "end_ms": None if w is None else w[1]} for p, w in zip(parts, P.timings(parts, own), strict=True)]

        return pd.Series([one(c) for c in lists])

    return rows.select("conv_id", F.posexplode(run("c")).alias("pos", "x")).select("conv_id", "pos", "x.*")


def one_section(claims: DataFrame, assigned: DataFrame, rest: int) -> DataFrame:
    """Each claim (claim_id) in one section: the first of ``assigned`` (claim_id, section, pos) that names it, else ``rest``."""
    first = assigned.groupBy("claim_id").agg(F.min(F.struct("section", "pos")).alias("f")).select("claim_id", F.col("f.section").alias("section"))
    return claims.join(first, "claim_id", "left").select("claim_id", F.coalesce("section", F.lit(rest)).alias("section"))


def csv_round_trip(rows: DataFrame) -> DataFrame:
    """``rows`` as a CSV file with all cells quoted, read back; columns are found by name whatever its case."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/csv/{uuid.uuid4().hex}"
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select(*[F.col(c).cast(t).alias(c.lower()) for c, t in rows.dtypes])


def extracted(files: DataFrame) -> DataFrame:
    """``files`` (type, name, content) with ``text``: pages without their marks, page-wise text in paragraphs, all else as it is."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    ends = lambda *e: F.rlike(F.lower(F.coalesce("name", F.lit(""))), F.lit(rf"\.({'|'.join(e)})$"))
    page = (kind == "text/html") | ((kind == "") & ends("html", "htm"))
    paged = (kind == "application/pdf") | ((kind == "") & ends("pdf"))
    return files.withColumn("text", F.when(page, X.html_text(F.col("content"))).when(paged, X.pdf_text(F.col("content"))).otherwise(F.col("content")))


def created(sources: DataFrame) -> DataFrame:
    """New sources that have kind and title, with their default tier and state."""
    ok = sources.filter(F.col("kind").isNotNull() & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    return ok.withColumn("tier", F.coalesce("tier", F.when(F.col("kind") == "article", "peer_reviewed").otherwise("expert"))).withColumn("status", F.lit("pending"))
