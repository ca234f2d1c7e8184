"""Text functions over documents, pages, conversations and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silexa.functions import text as X
from silexa.operators import quotes
from silexa.sources.tables import Tables

from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
_BLANK = r"[ \t\n\r\f\x0B]+"


@_R.add(rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '{_BLANK}', ' ', 'g')) AS text FROM pages""", model=False)
def src_02_html_text(t: Tables) -> DataFrame:
    """Text of each page."""
    return t.raw("pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@_R.add("SELECT doc_id FROM documents WHERE length(text) >= 2000 AND doc_id NOT IN (SELECT doc_id FROM labels)", model=False)
def src_12_ingest_gate(t: Tables) -> DataFrame:
    """Long enough and not there yet."""
    return t.raw("documents").filter(F.length("text") >= 2000).join(t.raw("labels"), "doc_id", "left_anti").select("doc_id")


@_R.add("SELECT doc_id FROM documents WHERE length(trim(text)) < 30 OR " + " OR ".join(f"regexp_matches(text, '{p}', 'i')" for p in X.LOW_VALUE), model=False)
def fil_10_low_value(t: Tables) -> DataFrame:
    """Texts that are worthless as statements."""
    return t.raw("documents").filter(X.is_low_value(F.col("text"))).select("doc_id")


@_R.add("SELECT conv_id, turn, 'seg-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS locator FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)", model=False)
def prj_02_locators(t: Tables) -> DataFrame:
    """Numbered places of the turns of a conversation."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.raw("conversations").select("conv_id", "turn", F.format_string("seg-%03d", n).alias("locator"))


@_R.add("SELECT doc_id, substr(regexp_replace(regexp_replace(trim(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM documents", model=False)
def str_01_slugs(t: Tables) -> DataFrame:
    """Address parts from texts."""
    return t.raw("documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


@_R.add("SELECT doc_id, 't:' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS fingerprint FROM documents", model=False)
def str_08_fingerprints(t: Tables) -> DataFrame:
    """Fingerprints of titles."""
    return t.raw("documents").select("doc_id", F.concat(F.lit("t:"), X.normal_title(F.col("text"))).alias("fingerprint"))


@_R.add(r"SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(text, '([0-9]),([0-9]{3})', '\1\2', 'g'), '([0-9]),([0-9]{3})', '\1\2', 'g'), '[0-9]+(?:\.[0-9]+)?'), '|') AS numbers FROM documents", model=False)
def str_10_numbers(t: Tables) -> DataFrame:
    """Number literals of texts, without thousands commas."""
    return t.raw("documents").select("doc_id", F.array_join(X.numbers(F.col("text")), "|").alias("numbers"))


@_R.add(r"SELECT doc_id, CAST(len(regexp_split_to_array(trim(text), '[ \t\n\r]+')) AS BIGINT) AS words FROM documents", model=False)
def str_12_words(t: Tables) -> DataFrame:
    """Word counts."""
    return t.raw("documents").select("doc_id", X.words(F.col("text")).alias("words"))


@_R.add(r"SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), '[^.!?]+[.!?]+|[^.!?]+$')) AS BIGINT) AS sentences FROM documents", model=False)
def str_13_sentences(t: Tables) -> DataFrame:
    """Sentence counts."""
    return t.raw("documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("sentences"))


@_R.add("SELECT page_id, lpad(page_id::VARCHAR, 11, '0') AS video_id, 'https://www.youtube.com/watch?v=' || lpad(page_id::VARCHAR, 11, '0') || '&t=' || (page_id * 7) AS link FROM pages", model=False)
def str_16_video_links(t: Tables) -> DataFrame:
    """Ids of video addresses, and links to a moment."""
    url = F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(F.col("page_id").cast("string"), 11, "0"))
    moment = F.floor(F.col("page_id") * 7000 / 1000)
    return t.raw("pages").select("page_id", X.video_id(url).alias("video_id"), F.concat(url, F.lit("&t="), moment).alias("link"))


@_R.add("SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS clock FROM (SELECT event_id, event_id * 777 // 1000 AS s FROM events)", model=False)
def str_18_clock(t: Tables) -> DataFrame:
    """Milliseconds as a clock shows them."""
    return t.raw("events").select("event_id", X.clock(F.col("event_id") * 777).alias("clock"))


@_R.add("SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) AS transcript FROM conversations WHERE trim(text) <> '' GROUP BY 1", model=False)
def arr_04_transcripts(t: Tables) -> DataFrame:
    """Turns joined in order, blank ones left out."""
    rows = t.raw("conversations").filter(F.trim("text") != "").select("conv_id", F.struct("turn", F.trim("text").alias("text")).alias("s"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), " ").alias("transcript"))


@_R.add("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)", model=False)
def str_04_exact_quotes(t: Tables) -> DataFrame:
    """Documents that hold a passage, character for character."""
    return quotes.exact(t.raw("documents").select("doc_id", "text"), t.raw("benchmark").select("item_id", "text"))
