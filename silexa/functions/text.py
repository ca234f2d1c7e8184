"""Text functions as Column expressions, so that Catalyst compiles them; no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What makes a statement worthless (fixed patterns, any case).
LOW_VALUE = (
    r"this (podcast|episode|discussion|conversation) (will|is going to|features?)",
    r"(two-part|multi-part|part \d+)",
    r"^(.* )?(is|are) (a|an) (leading|prominent|notable|expert|researcher|scientist|doctor|professor)",
    r"conflict(s)? of interest",
    r"no conflict",
    r"^(this|the) (podcast|episode|discussion|conversation|topic)",
)
#: Characters of a text that may lose marked stretches, and those of an anchor, at least.
SHORT, LEAST_ANCHOR = 200, 12
#: What stands at the ends of a text without being part of it: all blanks of Unicode and the four separators before the space.
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def html_text(c: Column) -> Column:
    """Text of a page: without script and style bodies and tags, blanks collapsed."""
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"[ \t\n\r\f\x0B]+", " "))


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 60)


def normal_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), " +", " "))


def numbers(c: Column) -> Column:
    """Number literals in order, without thousands commas."""
    return F.regexp_extract_all(F.regexp_replace(c, r"([0-9]),(?=[0-9]{3})", "$1"), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def words(c: Column) -> Column:
    """Tokens between blanks; a text of blanks counts as one, null as none."""
    return F.coalesce(F.size(F.split(F.trim(c), r"[ \t\n\r]+")), F.lit(0)).cast("long")


def sentences(c: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(c, r"[ \t\n\r]+", " "), F.lit(r"[^.!?]+[.!?]+|[^.!?]+$"), F.lit(0))


def is_low_value(c: Column) -> Column:
    out = F.length(F.trim(c)) < 30
    for p in LOW_VALUE:
        out = out | F.rlike(c, F.lit(f"(?i){p}"))
    return out


def video_id(c: Column) -> Column:
    """Eleven-character id of a video address, or of the bare id; else null."""
    a = F.regexp_extract(c, r"(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|shorts/|v/)|youtu\.be/)([A-Za-z0-9_-]{11})", 1)
    return F.coalesce(F.when(a != "", a), F.when(F.rlike(c, F.lit("^[A-Za-z0-9_-]{11}$")), c))


def clock(ms: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.floor(ms / 1000).cast("int")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60))


#: What a transcript calls a speaker without a name, credentials behind a name, and named entities (fixed values).
ROLES = "host|guest|speaker|interviewer|interviewee|narrator|unknown|unclear|n/?a|none|null"
CREDENTIALS = r",\s*(M\.?D\.?|Ph\.?D\.?|D\.?O\.?|M\.?S\.?|R\.?D\.?|M\.?P\.?H\.?)\.?"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}
CLAIM_ID = r"\s*\[[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\]"


def speaker(c: Column, host: str) -> Column:
    """A speaker's name; null for none, roles and names over 80 characters; the host always in one spelling."""
    name = F.trim(c)
    as_host = r"(?i)^(dr\.?\s+)?" + r"\s+".join(host.split()) + r"(,?\s+m\.?d\.?)?$"
    return F.when((F.length(name) > 0) & (F.length(name) <= 80) & ~F.rlike(name, F.lit(f"(?i)^({ROLES})s?$")), F.when(F.rlike(name, F.lit(as_host)), F.lit(host)).otherwise(name))


def without_claim_ids(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, CLAIM_ID, ""), r" +([.,;:)])", "$1")
    return F.trim(F.regexp_replace(c, r"[ \t]{2,}", " "))


def citation(authors: Column, year: Column, title: Column, journal: Column, doi: Column) -> Column:
    """Authors (three at most, else the first and others), year, title, journal and address, without what is missing."""
    who = F.when(F.size(authors) > 3, F.concat(F.get(authors, F.lit(0)), F.lit(" et al."))).when(F.size(authors) > 0, F.array_join(authors, ", "))
    parts = F.array(who, F.concat(F.lit("("), year, F.lit(").")), F.concat(title, F.lit(".")), journal, F.concat(F.lit("https://doi.org/"), doi))
    return F.trim(F.regexp_replace(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " "), r"\s+", " "))


def missing_numbers(wanted: Column, have: Column) -> Column:
    """Number literals of one text that the other one lacks, in order and as often as they occur."""
    return F.filter(numbers(wanted), lambda n: ~F.array_contains(numbers(have), n))


def guests(title: Column) -> Column:
    """Names behind the first bar of a title, without credentials: capitalised, over two letters, four words at most."""
    names = F.transform(F.split(F.trim(F.regexp_replace(title, r"^[^|]*(\||$)", "")), r"\s*&\s*|\s+and\s+"), lambda s: F.regexp_replace(F.trim(F.regexp_replace(F.trim(s), f"(?i){CREDENTIALS}", "")), r"[,\s]+$", ""))
    return F.filter(names, lambda s: (F.length(s) > 2) & F.rlike(s, F.lit("^[A-Z]")) & (F.size(F.split(s, r"\s+")) <= 4))


def decoded(c: Column) -> Column:
    """Text with its entities resolved: numbers first, names next, the ampersand last."""
    marked = F.regexp_replace(F.regexp_replace(c, r"(?i)&#x([0-9a-f]{1,6});", "\u0001x$1\u0001"), r"&#([0-9]{1,7});", "\u0001d$1\u0001")
    point = lambda s: F.when(F.startswith(s, F.lit("x")), F.conv(F.substring(s, 2, 6), 16, 10)).otherwise(F.substring(s, 2, 7)).cast("int")
    # A character of any plane from its UTF-32 bytes.
    letter = lambda s: F.decode(F.unhex(F.lpad(F.hex(point(s)), 8, "0")), "UTF-32")
    parts = F.split(marked, "\u0001")
    c = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 1, letter(s)).otherwise(s)), "")
    for name, value in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(value))
    return F.trim(F.replace(c, F.lit("&amp;"), F.lit("&")))


def grade_title(c: Column) -> Column:
    """A grade as a reader sees it."""
    return F.when(c == "RCT", c).when(c == "MetaAnalysis", "Meta-Analysis").otherwise(F.initcap(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")))


def json_part(c: Column) -> Column:
    """What lies between the first and the last brace, of the first fenced block where there is one."""
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.rlike(c, F.lit(r"(?is)```(?:json)?\s*.*?```")), fenced).otherwise(c)
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner).otherwise(body)


def abstract(positions: Column) -> Column:
    """The words of an inverted index (map of word to places) in order, 1,200 characters at most; null without words."""
    flat = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(flat) > 0, F.substring(F.array_join(F.transform(F.array_sort(flat), lambda x: x["w"]), " "), 1, 1200))


def episode_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*#?\s*(\d{1,4})\s*[–\-‒—]", 1), F.lit("")).cast("int")


def iso_date(c: Column) -> Column:
    """m/d/yy or m/d/yyyy as an ISO date."""
    part = lambda n: F.regexp_extract(F.trim(c), r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$", n)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    return F.when(part(1) != "", F.concat_ws("-", year, F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")))


def table_cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\n+", " ")


def csv_cell(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def pdf_text(c: Column) -> Column:
    """Text of a page-wise source: blanks and empty lines collapsed; one long paragraph is cut behind sentences."""
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.trim(F.when((F.length(c) > 1000) & ~F.contains(c, F.lit("\n\n")), F.regexp_replace(c, r"([.!?])\s+(?=[A-Z])", "$1\n\n")).otherwise(c))


def moment_url(url: Column, ms: Column) -> Column:
    """A video's address at a moment; null for other addresses and without a time."""
    link = F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("t="), F.floor(ms / 1000))
    return F.when(video_id(url).isNotNull() & F.contains(url, F.lit("/")) & ms.isNotNull(), link)


def without_marked(c: Column, marks: Column) -> Column:
    """A text without the stretches from a start to an end anchor (``marks``: array of arrays of the two); anchors that are short, missing or ambiguous remove nothing."""
    trimmed = lambda x: F.btrim(x, F.lit(_BLANKS))
    pairs = F.transform(marks, lambda m: F.struct(trimmed(F.get(m, F.lit(0))).alias("first"), trimmed(F.get(m, F.lit(1))).alias("last")))
    at = F.transform(pairs, lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), F.when(F.length(p["first"]) >= LEAST_ANCHOR, F.position(p["first"], c)).alias("at")))
    clear = F.filter(at, lambda p: (p["at"] > 0) & (F.position(p["first"], c, p["at"] + 1) == 0))
    # Characters from 0 to where a stretch starts and stops; none where the end anchor is missing.
    stop = lambda p: F.when(F.length(p["last"]) >= LEAST_ANCHOR, F.nullif(F.position(p["last"], c, p["at"]), F.lit(0)) - 1 + F.length(p["last"])).otherwise(p["at"] - 1 + F.length(p["first"]))
    spans = F.array_sort(F.filter(F.transform(clear, lambda p: F.struct((p["at"] - 1).alias("start"), stop(p).alias("stop"))), lambda s: s["stop"] > s["start"]))

    def kept(acc: Column, s: Column) -> Column:
        own = F.concat(F.substr(c, F.greatest(acc["at"], F.lit(0)) + 1, s["start"] - F.greatest(acc["at"], F.lit(0))), F.lit(" "))
        return F.struct(F.concat(acc["out"], F.when(s["start"] > acc["at"], own).otherwise("")).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    def whole(acc: Column) -> Column:
        joined = F.concat(acc["out"], F.substr(c, acc["at"] + 1))
        return F.when(acc["at"] < 0, c).otherwise(trimmed(F.regexp_replace(joined, r"[ \t]{2,}", " ")))

    cut = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(-1).alias("at")), kept, whole)
    return F.when(F.length(c) >= SHORT, F.coalesce(cut, c)).otherwise(c)
