"""Text functions, sources and documents, second part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silexa.functions import passages as P
from silexa.functions import text as X
from silexa.sources import feeds, files
from silexa.sources.tables import Tables

from .registry import Registry
from .texts import ORACLE_SQL as _TEXTS

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
HOST = "Jane Roe"


def _text(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", "text")


@_R.add("SELECT doc_id, slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug FROM (SELECT doc_id, slug, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS n FROM (SELECT doc_id, 'd-' || substr(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 1, 2) AS slug FROM documents))", model=False)
def str_02_unique_slugs(t: Tables) -> DataFrame:
    """Slugs with a number behind all but the first of each."""
    slug = F.concat(F.lit("d-"), F.substring(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""), 1, 2))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("doc_id"))
    rows = _text(t).select("doc_id", slug.alias("slug")).withColumn("n", n)
    return rows.select("doc_id", F.concat("slug", F.when(F.col("n") > 1, F.concat(F.lit("-"), "n")).otherwise("")).alias("slug"))


@_R.add()
def str_03_chunks(t: Tables) -> DataFrame:
    """Every text as overlapping passages."""
    return _text(t).select("doc_id", F.posexplode(P.chunk_udf()("text")).alias("pos", "passage"))


# The quote's words with any blanks between them, marks of one kind alike.
_QUOTED = r"""q AS (SELECT doc_id, text, regexp_replace(regexp_replace(substr(text, 20, 120), '\s+', '  ', 'g'), '^\s+|\s+$', '', 'g') AS quote FROM documents WHERE length(text) > 150),
w AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(quote, '([!#-&(-,./:-@\[-`{-~])', '\\\1', 'g'), '[''‘’]', '[''‘’]', 'g'), '["“”]', '["“”]', 'g'), '[-–—]', '[\\-–—]', 'g'), '\s+', '\\s+', 'g') AS pattern FROM q),
f AS (SELECT *, CASE WHEN contains(text, quote) THEN quote ELSE regexp_extract(text, pattern) END AS found FROM w)"""


@_R.add(f'WITH {_QUOTED} SELECT doc_id, CASE WHEN quote <> \'\' THEN quote END AS text, CASE WHEN quote <> \'\' THEN strpos(text, found) - 1 END AS start_char, CASE WHEN quote <> \'\' THEN strpos(text, found) - 1 + length(found) END AS end_char FROM f', model=False)
def str_04_quotes(t: Tables) -> DataFrame:
    """Where a quote with changed blanks and marks stands in its text: characters 20 to 140 of each text."""
    rows = _text(t).filter(F.length("text") > 150)
    quote = F.regexp_replace(F.substring("text", 20, 120), r"\s+", "  ")
    return rows.select("doc_id", P.resolve_udf("text", quote).alias("q")).select("doc_id", "q.text", F.col("q.start").alias("start_char"), F.col("q.end").alias("end_char"))


_SPEAKERS = "CASE c_custkey % 6 WHEN 0 THEN 'Host' WHEN 1 THEN 'dr. jane  roe, M.D.' WHEN 2 THEN '  ' || c_name WHEN 3 THEN 'N/A' WHEN 4 THEN repeat('x', 81) ELSE 'Guests' END"


@_R.add(f"SELECT id, CASE WHEN length(n) BETWEEN 1 AND 80 AND NOT regexp_matches(n, '^({X.ROLES})s?$', 'i') THEN CASE WHEN regexp_matches(n, '^(dr\\.?\\s+)?jane\\s+roe(,?\\s+m\\.?d\\.?)?$', 'i') THEN '{HOST}' ELSE n END END AS speaker FROM (SELECT c_custkey AS id, trim({_SPEAKERS}) AS n FROM customer)", model=False)
def str_05_speakers(t: Tables) -> DataFrame:
    """Speakers' names."""
    return t.raw("customer").select(F.col("c_custkey").alias("id"), X.speaker(F.expr(_SPEAKERS), HOST).alias("speaker"))


_MARKS = r"""m AS (SELECT doc_id, text, regexp_replace(substr(coalesce(l[1], ''), 1, 30), '^\s+|\s+$', '', 'g') AS a, regexp_replace(substr(coalesce(l[2], ''), 1, 30), '^\s+|\s+$', '', 'g') AS z FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)),
p AS (SELECT *, strpos(text, a) AS i FROM m),
e AS (SELECT *, CASE WHEN length(z) < 12 THEN i + length(a) WHEN strpos(substr(text, i), z) > 0 THEN i + strpos(substr(text, i), z) - 1 + length(z) END AS stop FROM p)"""


@_R.add(rf"WITH {_MARKS} SELECT doc_id, CASE WHEN length(text) >= 200 AND length(a) >= 12 AND strpos(substr(text, i + 1), a) = 0 AND stop > i THEN regexp_replace(regexp_replace(substr(text, 1, i - 1) || ' ' || substr(text, stop), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') ELSE text END AS text FROM e", model=False)
def str_06_hygiene(t: Tables) -> DataFrame:
    """Texts without the stretch from their first to their second line's beginning, where those anchors are clear."""
    line = lambda lines, n: F.substring(F.coalesce(F.get(lines, F.lit(n)), F.lit("")), 1, 30)
    marks = F.transform(F.array(F.split("text", "\n", 3)), lambda lines: F.array(line(lines, 0), line(lines, 1)))
    return _text(t).select("doc_id", X.without_marked(F.col("text"), marks).alias("text"))


_MARKED = "substr(text, 1, 40) || ' [0a1b2c3d-0000-4000-8000-' || lpad(doc_id::VARCHAR, 12, '0') || '] , and   more [' || doc_id || ']'"


@_R.add(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(x, '\s*\[[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}\]', '', 'g'), ' +([.,;:)])', '\1', 'g'), '[ \t]{{2,}}', ' ', 'g')) AS text FROM (SELECT doc_id, {_MARKED} AS x FROM documents)", model=False)
def str_07_without_ids(t: Tables) -> DataFrame:
    """Prose without the ids of claims."""
    return _text(t).select("doc_id", X.without_claim_ids(F.expr(_MARKED.replace("doc_id::VARCHAR", "CAST(doc_id AS STRING)"))).alias("text"))


@_R.add("""SELECT work_id, trim(regexp_replace(array_to_string(list_filter([CASE WHEN n > 3 THEN 'Author 0 et al.' WHEN n > 0 THEN array_to_string(list_transform(range(n), lambda i: 'Author ' || i), ', ') END,
 '(' || year || ').', title || '.', CASE WHEN work_id % 2 = 0 THEN 'Journal  of Tests' END, 'https://doi.org/' || doi], lambda p: p IS NOT NULL AND p <> ''), ' '), '\\s+', ' ', 'g')) AS citation FROM (SELECT *, work_id % 6 AS n FROM works)""")
def str_09_citations(t: Tables) -> DataFrame:
    """Citations of works."""
    n = (F.col("work_id") % 6).cast("int")
    authors = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("Author "), i)))
    return t.works.select("work_id", X.citation(authors, F.col("year").cast("string"), F.col("title"), F.when(F.col("work_id") % 2 == 0, "Journal  of Tests"), F.col("doi")).alias("citation"))


_NUM = r"regexp_extract_all(regexp_replace(regexp_replace({0}, '([0-9]),([0-9]{{3}})', '\1\2', 'g'), '([0-9]),([0-9]{{3}})', '\1\2', 'g'), '[0-9]+(?:\.[0-9]+)?')"


@_R.add(f"SELECT a.doc_id, array_to_string(list_filter({_NUM.format('a.text')}, lambda n: NOT list_contains({_NUM.format('b.text')}, n)), '|') AS missing FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1", model=False)
def str_11_missing_numbers(t: Tables) -> DataFrame:
    """Number literals of each text that the next one lacks."""
    other = _text(t).select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("have"))
    return _text(t).join(other, "doc_id").select("doc_id", F.array_join(X.missing_numbers(F.col("text"), F.col("have")), "|").alias("missing"))


def _in_files(t: Tables, size: int, name: str) -> DataFrame:
    """Pages with the number of their file, ``size`` pages to a file, and their place in it."""
    number = F.floor(F.col("page_id") / size)
    return t.raw("pages").withColumn(name, number).withColumn("pos", F.row_number().over(Window.partitionBy(name).orderBy("page_id")) - 1)


@_R.add(f"SELECT page_id // 50 AS book, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1 AS pos, text FROM ({_TEXTS['src_02_html_text']})", model=False)
def src_03_epub(t: Tables) -> DataFrame:
    """All pages as the chapters of books of fifty, written as files and read back by chapter."""
    files.register(t.spark)
    rows = t.spark.read.format("silexa_book").option("mode", "FAILFAST").load(files.write_files(files.as_books(_in_files(t, 50, "book")), "epub"))
    return rows.select(F.regexp_extract("path", r"(\d+)\.epub$", 1).cast("long").alias("book"), F.col("pos").cast("long").alias("pos"), X.html_text(F.col("html")).alias("text"))


@_R.add("""SELECT page_id // 200 AS feed, url AS link, title, strftime(make_timestamp((1700000000 + page_id * 3600) * 1000000), '%Y-%m-%d') AS published, md5(html) AS digest
FROM (SELECT *, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages) WHERE title <> '' AND url <> ''""", model=False)
def src_14_feed_files(t: Tables) -> DataFrame:
    """All pages as entries of feeds of two hundred, Atom and RSS by turns, written as files and read back; the whole page is the entry's description."""
    files.register(t.spark)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    items = _in_files(t, 200, "feed").select("feed", "pos", F.col("url").alias("link"), title.alias("title"), F.timestamp_seconds(F.lit(1700000000) + F.col("page_id") * 3600).alias("published"), F.col("html").alias("description"))
    rows = t.spark.read.format("silexa_feed").option("mode", "FAILFAST").load(files.write_files(files.as_feeds(items, F.col("feed") % 2 == 0), "feeds"))
    return rows.select(F.regexp_extract("path", r"(\d+)\.xml$", 1).cast("long").alias("feed"), "link", "title", "published", F.md5("description").alias("digest"))


_TITLES = "'Episode ' || c_custkey || CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' | ' || c_name || ', M.D.' WHEN 2 THEN ' | Ann Lee, Ph.D. & Bob Ray and al' WHEN 3 THEN ' | a guest | One Two Three Four Five' ELSE ' | Zoe Q, R.D.,' END"


@_R.add(r"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(x, '^[^|]*(\||$)', '')), '\s*&\s*|\s+and\s+'), lambda s: regexp_replace(trim(regexp_replace(trim(s), ',\s*(M\.?D\.?|Ph\.?D\.?|D\.?O\.?|M\.?S\.?|R\.?D\.?|M\.?P\.?H\.?)\.?', '', 'gi')), '[,\s]+$', '')), lambda s: length(s) > 2 AND regexp_matches(s, '^[A-Z]') AND len(regexp_split_to_array(s, '\s+')) <= 4), ';') AS guests FROM (SELECT c_custkey AS id, " + _TITLES + " AS x FROM customer)", model=False)
def str_14_guests(t: Tables) -> DataFrame:
    """Guests named in titles."""
    return t.raw("customer").select(F.col("c_custkey").alias("id"), F.array_join(X.guests(F.expr(_TITLES)), ";").alias("guests"))


@_R.add("SELECT page_id, trim(replace(replace(replace(replace(replace(replace(replace(replace(x, '&#x41;', 'A'), '&#233;', 'é'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS text FROM (SELECT page_id, '&#x41; &#233; &amp;lt; ' || html AS x FROM pages)", model=False)
def str_15_entities(t: Tables) -> DataFrame:
    """Pages with their entities resolved."""
    return t.raw("pages").select("page_id", X.decoded(F.concat(F.lit("&#x41; &#233; &amp;lt; "), "html")).alias("text"))


@_R.add("SELECT page_id, CASE WHEN page_id % 3 > 0 THEN u || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 't=' || (page_id * 7777 // 1000) END AS link FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://youtu.be/' ELSE 'https://www.youtube.com/watch?v=' END || lpad(page_id::VARCHAR, 11, '0') AS u FROM pages)", model=False)
def str_17_moments(t: Tables) -> DataFrame:
    """Addresses of moments in videos; none without a time."""
    url = F.concat(F.when(F.col("page_id") % 2 == 0, "https://youtu.be/").otherwise("https://www.youtube.com/watch?v="), F.lpad(F.col("page_id").cast("string"), 11, "0"))
    ms = F.when(F.col("page_id") % 3 > 0, F.col("page_id") * 7777)
    return t.raw("pages").select("page_id", X.moment_url(url, ms).alias("link"))


@_R.add("SELECT DISTINCT evidence, CASE evidence WHEN 'RCT' THEN 'RCT' WHEN 'MetaAnalysis' THEN 'Meta-Analysis' WHEN 'CaseSeries' THEN 'Case Series' WHEN 'ExpertOpinion' THEN 'Expert Opinion' ELSE evidence END AS title FROM insights")
def str_19_grade_titles(t: Tables) -> DataFrame:
    """Grades as a reader sees them."""
    return t.insights.select("evidence").distinct().select("evidence", X.grade_title(F.col("evidence")).alias("title"))


@_R.add("SELECT claim_id, CASE WHEN trim(x) = '' THEN ' ' ELSE x END AS text FROM (SELECT claim_id, CASE WHEN claim_id % 9 = 0 THEN '  ' ELSE statement || coalesce('. ' || evidence, '') END AS x FROM claims)")
def str_20_embedding_texts(t: Tables) -> DataFrame:
    """Texts to embed: statement and note; a single blank for an empty one."""
    text = F.when(F.col("claim_id") % 9 == 0, F.lit("  ")).otherwise(F.concat("statement", F.coalesce(F.concat(F.lit(". "), "evidence"), F.lit(""))))
    return t.claims.select("claim_id", F.when(F.trim(text) == "", " ").otherwise(text).alias("text"))


_REPLY = "CASE event_id % 4 WHEN 0 THEN 'Sure: ```json' || chr(10) || props || '``` done' WHEN 1 THEN 'is ' || props || ' so' WHEN 2 THEN 'no object' ELSE props END"


@_R.add(f"SELECT event_id, CASE WHEN event_id % 4 = 2 THEN 'no object' ELSE props END AS part, CASE WHEN event_id % 4 <> 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM (SELECT *, {_REPLY} AS x FROM events)", model=False)
def str_21_json_replies(t: Tables) -> DataFrame:
    """The object in a reply, and a value of it."""
    part = X.json_part(F.expr(_REPLY))
    return t.raw("events").select("event_id", part.alias("part"), F.get_json_object(part, "$.k").cast("long").alias("k"))


@_R.add("SELECT conv_id, substr(string_agg(role || ' ' || turn, ' ' ORDER BY turn), 1, 1200) AS abstract FROM conversations GROUP BY 1", model=False)
def str_22_abstracts(t: Tables) -> DataFrame:
    """Texts put together from words and their places."""
    rows = t.raw("conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "role", "turn"), F.array("turn")))).alias("places"))
    return rows.select("conv_id", X.abstract(F.col("places")).alias("abstract"))


@_R.add("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 10000 AS INTEGER) END AS number, CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '20' || strftime(o_orderdate, '%y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS date FROM orders", model=False)
def str_23_numbers_and_dates(t: Tables) -> DataFrame:
    """Episode numbers of titles and dates in American order."""
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    title = F.concat(F.when(key % 4 == 0, "Special ").otherwise(" #"), key % 10000, F.lit(" – of something"))
    day = F.when(key % 3 > 0, F.concat_ws("/", F.month(at), F.dayofmonth(at), F.when(key % 2 == 0, F.date_format(at, "yy")).otherwise(F.year(at).cast("string")))).otherwise(F.lit("soon"))
    return t.raw("orders").select(key.alias("id"), X.episode_number(title).alias("number"), X.iso_date(day).alias("date"))


@_R.add(r"SELECT doc_id, regexp_replace(replace('a|b ' || text, '|', '\|'), '\n+', ' ', 'g') AS cell FROM documents", model=False)
def str_24_table_cells(t: Tables) -> DataFrame:
    """Texts as cells of a Markdown table."""
    return _text(t).select("doc_id", X.table_cell(F.concat(F.lit("a|b "), "text")).alias("cell"))


@_R.add("SELECT page_id, '\"' || replace(coalesce(CASE WHEN page_id % 5 > 0 THEN html END, ''), '\"', '\"\"') || '\"' AS cell FROM pages", model=False)
def str_25_csv_cells(t: Tables) -> DataFrame:
    """Texts as cells of a CSV file."""
    return t.raw("pages").select("page_id", X.csv_cell(F.when(F.col("page_id") % 5 > 0, F.col("html"))).alias("cell"))


@_R.add("SELECT c_custkey AS id, list_has(ids, 3) AS has_three, len(list_distinct(ids))::INTEGER AS n, array_to_string(list_sort(list_distinct(ids))[1:2], ',') AS two FROM (SELECT c_custkey, [c_custkey % 5, c_custkey % 7, c_custkey % 3, 3 - c_custkey % 2] AS ids FROM customer)", model=False)
def arr_01_ids(t: Tables) -> DataFrame:
    """Arrays of ids: distinct ones, membership, the first two."""
    key = F.col("c_custkey")
    ids = F.array(key % 5, key % 7, key % 3, F.lit(3) - key % 2)
    return t.raw("customer").select(key.alias("id"), F.array_contains(ids, 3).alias("has_three"), F.size(F.array_distinct(ids)).alias("n"), F.array_join(F.slice(F.array_sort(F.array_distinct(ids)), 1, 2), ",").alias("two"))


@_R.add("SELECT f.topic_id, f.claim_id FROM filings f WHERE NOT EXISTS (SELECT 1 FROM filings k WHERE k.topic_id = f.topic_id AND k.claim_id % 4 < 2 AND k.claim_id = f.claim_id)")
def arr_02_new_ids(t: Tables) -> DataFrame:
    """Claims of a topic that its outline (here: by a rule) has not yet: the outline's arrays against the filings."""
    outline = t.filings.filter("claim_id % 4 < 2").groupBy("topic_id").agg(F.collect_set("claim_id").alias("ids"))
    known = outline.select("topic_id", F.explode("ids").alias("claim_id"))
    return t.filings.join(known, ["topic_id", "claim_id"], "left_anti").select("topic_id", "claim_id")


@_R.add("""SELECT conv_id, turn, trim(text) AS text, CAST(greatest(0, floor(turn * 1500.4 + 0.5)) AS BIGINT) AS start_ms, CAST(greatest(0, floor(turn * 1500.4 + 0.5)) + CASE WHEN turn % 2 = 0 THEN 2250 ELSE 0 END AS BIGINT) AS end_ms FROM conversations WHERE trim(text) <> '' AND turn % 5 < 4""", model=False)
def arr_03_captions(t: Tables) -> DataFrame:
    """Captions in seconds, as text, to milliseconds; empty ones and those without a number drop out."""
    raw = t.raw("conversations").select("conv_id", "turn", F.struct("text", F.when(F.col("turn") % 5 < 4, (F.col("turn") * 1.5004).cast("string")).otherwise("soon").alias("start"), F.when(F.col("turn") % 2 == 0, F.lit("2.25")).alias("dur")).alias("s"))
    lists = raw.groupBy("conv_id", "turn").agg(F.collect_list("s").alias("segments"))
    return lists.select("conv_id", "turn", F.explode(feeds.normal_captions(F.col("segments"))).alias("c")).select("conv_id", "turn", "c.*")


@_R.add()
def arr_05_timings(t: Tables) -> DataFrame:
    """Times of each conversation's passages of 500 characters."""
    return feeds.timed_chunks(t.captions, 500, 50)


@_R.add("""WITH a AS (SELECT c_custkey AS claim_id, c_nationkey % 4 AS section, c_custkey % 3 AS pos FROM customer UNION ALL SELECT c_custkey, (c_nationkey + 1) % 4, 9 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 1000000, 1, 1 FROM customer WHERE c_custkey < 5),
ok AS (SELECT claim_id, section, row_number() OVER (PARTITION BY claim_id ORDER BY section, pos) AS n FROM a WHERE claim_id < 1000000 AND claim_id % 7 > 0)
SELECT claim_id, section FROM ok WHERE n = 1 UNION ALL SELECT c_custkey, 99 FROM customer WHERE c_custkey % 7 = 0""", model=False)
def arr_06_sections(t: Tables) -> DataFrame:
    """Each claim in one section: the first that names it; unknown ids drop out, claims that no section names come last."""
    base = t.raw("customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    one = base.filter("c_custkey % 7 > 0").select(key.alias("claim_id"), (nation % 4).alias("section"), (key % 3).alias("pos"))
    two = base.filter("c_custkey % 7 > 0 AND c_custkey % 2 = 0").select(key, (nation + 1) % 4, F.lit(9))
    unknown = base.filter("c_custkey < 5").select(key + 1000000, F.lit(1), F.lit(1))
    return feeds.one_section(base.select(key.alias("claim_id")), one.union(two).union(unknown), 99)


@_R.add("SELECT event_id, '{\"kind\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' AS object, CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS high FROM events", model=False)
def json_01_objects(t: Tables) -> DataFrame:
    """Objects built from columns, and values read from them."""
    built = F.to_json(F.struct(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k")))
    return t.raw("events").select("event_id", built.alias("object"), (F.get_json_object(built, "$.k").cast("long") > 50).alias("high"))


@_R.add(r"SELECT doc_id, trim(CASE WHEN length(x) > 1000 AND NOT contains(x, chr(10) || chr(10)) THEN regexp_replace(x, '([.!?])\s+([A-Z])', '\1' || chr(10) || chr(10) || '\2', 'g') ELSE x END) AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS x FROM documents)", model=False)
def src_04_pdf_text(t: Tables) -> DataFrame:
    """Texts as page-wise sources give them, in paragraphs."""
    return _text(t).select("doc_id", X.pdf_text(F.col("text")).alias("text"))


_ATOM = "'<feed>' || '<entry><yt:videoId>' || lpad(page_id::VARCHAR, 11, '0') || '</yt:videoId><title>Page &amp;amp; ' || page_id || '</title><published>2024-01-0' || (1 + page_id % 9) || 'T00:00:00Z</published></entry><entry><title>none</title></entry></feed>'"


@_R.add("SELECT page_id, lpad(page_id::VARCHAR, 11, '0') AS video_id, 'Page &amp; ' || page_id AS title, '2024-01-0' || (1 + page_id % 9) AS published FROM pages", model=False)
def src_05_atom(t: Tables) -> DataFrame:
    """Entries of Atom feeds that have id and title."""
    return feeds.atom_entries(t.raw("pages").select("page_id", F.expr(_ATOM.replace("page_id::VARCHAR", "CAST(page_id AS STRING)")).alias("xml")), "page_id")


_RSS = "'<rss><item><title><![CDATA[#' || (page_id % 40) || ' – Talk]]></title><link>http://x.org/' || (page_id % 40) || '</link></item><item><title>Notes</title><link>http://x.org/n</link></item></rss>'"


@_R.add("SELECT link, title, page_id FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) AS n FROM (SELECT page_id, 0 AS pos, 'http://x.org/' || (page_id % 40) AS link, '#' || (page_id % 40) || ' – Talk' AS title FROM pages UNION ALL SELECT page_id, 1, 'http://x.org/n', 'Notes' FROM pages)) WHERE n = 1", model=False)
def src_06_rss(t: Tables) -> DataFrame:
    """Items of RSS pages, each link once, from its first page."""
    return feeds.rss_items(t.raw("pages").select("page_id", F.expr(_RSS).alias("xml")), "page_id")


@_R.add("SELECT page_id, CAST(page_id % 40 AS INTEGER) AS number, lpad(page_id::VARCHAR, 11, '0') AS video_id FROM pages WHERE page_id % 3 > 0", model=False)
def src_07_episodes(t: Tables) -> DataFrame:
    """Numbered episodes with the video that their page names: whole pages with links of all forms behind them, the first form in order counts."""
    key = F.col("page_id")
    title = F.concat(F.when(key % 3 > 0, "#").otherwise("Extra "), key % 40, F.lit(" talk"))
    video, other = F.lpad(key.cast("string"), 11, "0"), "AAAAAAAAAAA"
    link = (
        F.when(key % 4 == 0, F.concat(F.lit(f'<a href="https://youtube.com/watch?v={other}">a</a> https://youtu.be/'), video))
        .when(key % 4 == 1, F.concat(F.lit(f'https://youtu.be/{other} <iframe src="https://www.youtube.com/embed/'), video, F.lit('?rel=0"></iframe>')))
        .when(key % 4 == 2, F.concat(F.lit('{"videoId" : "'), video, F.lit('"}')))
        .otherwise(F.concat(F.lit(f'{{"videoId":"{other}"}} https://www.youtube.com/watch?v='), video))
    )
    page = F.concat("html", link)
    return feeds.episodes(t.raw("pages").select("page_id", title.alias("title"), page.alias("html")))


@_R.add("SELECT conv_id, n::BIGINT AS n FROM (SELECT conv_id, CASE conv_id % 3 WHEN 2 THEN 0 ELSE count(*) END AS n FROM conversations GROUP BY 1)", model=False)
def src_08_caption_payloads(t: Tables) -> DataFrame:
    """Captions found in replies of three shapes."""
    rows = t.raw("conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("text", "turn"))).alias("j"))
    reply = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('{"tracks":[{"transcript":'), "j", F.lit("}]}"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"transcript":'), "j", F.lit("}"))).otherwise(F.lit("{}"))
    return rows.select("conv_id", F.size(feeds.caption_payload(reply)).cast("long").alias("n"))


@_R.add("SELECT c_custkey AS id, c_name AS name, 'said \"' || c_mktsegment || '\", twice' || chr(10) || 'x' AS note FROM customer", model=False)
def src_09_csv(t: Tables) -> DataFrame:
    """Rows written as CSV with quoted cells, line breaks and a mark at the top, and read back by the names of their columns."""
    return feeds.csv_round_trip(t.raw("customer").select(F.col("c_custkey").alias("Id"), F.col("c_name").alias("NAME"), F.concat(F.lit('said "'), "c_mktsegment", F.lit('", twice\nx')).alias("Note")))


_KIND = "CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' ELSE NULL END"


@_R.add(rf"""SELECT page_id, CASE WHEN page_id % 3 = 1 THEN html ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) END AS text FROM pages""", model=False)
def src_01_dispatch(t: Tables) -> DataFrame:
    """Text of files by type, else by extension, else as it is."""
    return feeds.extracted(t.raw("pages").select("page_id", F.expr(_KIND).alias("type"), F.lit("a.html").alias("name"), F.col("html").alias("content"))).select("page_id", "text")


@_R.add("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'article' ELSE 'podcast' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN 'peer_reviewed' ELSE 'expert' END AS tier, 'pending' AS status FROM customer WHERE c_custkey % 6 > 0", model=False)
def src_11_new_sources(t: Tables) -> DataFrame:
    """Sources as they are created: those with all that is required, with their default tier and state."""
    key = F.col("c_custkey")
    rows = t.raw("customer").select(key.alias("id"), F.when(key % 4 == 0, "article").otherwise("podcast").alias("kind"), F.when(key % 6 > 0, F.col("c_name")).alias("title"), F.lit(None).cast("string").alias("tier"))
    return feeds.created(rows).select("id", "kind", "tier", "status")
