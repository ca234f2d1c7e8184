"""Benchmark decontamination by templates, with DataFrame operations only.

Texts become words; numbers, units and names become typed placeholders, one word each, so that template words and raw words keep the same places.
A name is a capitalised word, a name of several words as many placeholders; where a sentence, line, quotation or text may begin, a word counts as one only if the benchmark never has it in lower case. A number with
separators is one placeholder. Windows of ``WIDTH`` template words are hashed and joined with the benchmark's windows. Where a window has placeholders, the slot
values on both sides travel along: along one alignment (document place minus item place) a benchmark value must stand for one document value
throughout and a document value for one benchmark value, otherwise the windows of that alignment do not count. Windows of which more than half (rounded up) are names count only with the benchmark's own values. A document leaks an item when the windows left cover ``COVERAGE`` of the item's windows.

Items with fewer than ``WIDTH`` words are matched by one window of their own length; items under ``LEAST_WORDS`` words, which a change of values would leave
with hardly a word of their own, only with the values they have. The benchmark's windows are broadcast while they take ``BROADCAST_BYTES`` at most (measured first); beyond that the same join shuffles.

Defined cases: a null or empty text has no windows and leaks nothing; a null id is reported as null; repeated rows are reported once per
(doc_id, item_id); repeated items are reported under each item_id; an empty table on either side gives an empty result; of a very long text only its words are held, window by window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch

WIDTH = 8
LEAST_WORDS = 5
COVERAGE = 0.25
BROADCAST_BYTES = 64 << 20
#: Units of measure that follow a number (fixed list).
UNITS = "kg|g|mg|t|km|m|cm|mm|mi|ft|in|l|ml|s|sec|min|h|hr|hrs|hours?|days?|weeks?|months?|years?|usd|eur|gbp|dollars?|euros?|cents?|percent|mph|kmh|w|kw|v|c|f"
#: So many lower-case words of the benchmark are put into the plan to tell sentence openers from names; a benchmark with more of them is joined instead, all of its words.
LOWER = 50_000
_NAME, _OPENER, _DOT, _NUMBER, _UNIT = "\u0001", "\u0002", "\u0003", "#n", "#u"
_QUOTES = "\"'“”„«»‘’(\\["


def _split(c: Column, separator: str) -> Column:
    return F.array_remove(F.split(c, separator), "")


def _clean(text: Column) -> Column:
    """The words of the text in lower case, a blank between two, with a mark before each name and each capitalised word that may open a sentence."""
    # Each pattern begins with the character that is rare, so that most places fail at once.
    marked = F.regexp_replace(text, r"(?=\p{Lu})(?<![\p{L}\p{N}])(?=\p{Lu}\p{L}*?\p{Ll})", _NAME)
    # What stands before a mark may be of any length, so it is looked at from behind: a mark comes first in the reversed text.
    opens = rf"{_NAME}(?=[ \t\x0B\f*•-]*+(?:\z|[.!?:;…\n\r{_QUOTES}]))"
    marked = F.when(F.contains(marked, F.lit(_NAME)), F.reverse(F.regexp_replace(F.reverse(marked), opens, _OPENER))).otherwise(marked)
    marked = F.lower(F.regexp_replace(marked, r"[.,](?=\p{N})(?<=\p{N}[.,])", _DOT))
    return F.array_join(_split(marked, rf"[^a-z\p{{L}}\p{{N}}{_NAME}{_OPENER}{_DOT}]++"), " ")


def words_of(clean: Column, lower: list[str] | Column) -> tuple[Column, Column]:
    """(raw words, template words) of ``_clean``, place by place. Of the capitalised words that may open a sentence, those among ``lower`` (words, or a column of them) are ordinary words.

    ``clean`` is to be a column that a table has, as it is used many times.
    """
    none = F.array().cast("array<string>")
    raw = F.when(clean == "", none).otherwise(F.split(F.translate(clean, _NAME + _OPENER, ""), " "))
    numbers = F.regexp_replace(clean, rf"(?=\p{{N}})(?<![\p{{L}}\p{{N}}{_DOT}])\p{{N}}[\p{{N}}{_DOT}]*+", _NUMBER)
    units = F.regexp_replace(numbers, rf"{_NUMBER}( ?)(?:{UNITS})(?![\p{{L}}\p{{N}}])", f"{_NUMBER}$1{_UNIT}")
    # Only texts with digits or marks go through the later expressions.
    typed = F.when(F.rlike(clean, F.lit(r"\p{N}")), units).otherwise(clean)
    names = F.split(F.regexp_replace(typed, rf"{_NAME}\p{{L}}++", "#w"), " ")
    ordinary = lambda w: w.isin(lower) if isinstance(lower, list) else F.array_contains(lower, w)
    opener = lambda w: F.when(ordinary(F.substring(w, 2, 1 << 30)), F.substring(w, 2, 1 << 30)).otherwise("#w")
    template = F.when(F.contains(clean, F.lit(_OPENER)), F.transform(names, lambda w: F.when(F.startswith(w, F.lit(_OPENER)), opener(w)).otherwise(w))).otherwise(names)
    return raw, F.when(clean == "", none).otherwise(template)


def lower_words(benchmark: DataFrame) -> list[str] | DataFrame:
    """The words (w) that the benchmark has in lower case: a list of LOWER at most, else a table."""
    words = benchmark.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]++")).alias("w")).filter(F.rlike("w", F.lit(r"^\p{Ll}")))
    words = materialise(words.distinct(), "lower")
    return [r["w"] for r in words.collect()] if words.count() <= LOWER else words


def _with_lower(table: DataFrame, key: str, lower: list[str] | DataFrame) -> DataFrame:
    """``table`` with ``_lower``, if the words are a table: those of a row's own openers that the benchmark has in lower case."""
    if isinstance(lower, list):
        return table
    openers = F.filter(F.split(_clean(F.coalesce("text", F.lit(""))), " "), lambda w: F.startswith(w, F.lit(_OPENER)))
    asked = table.select(key, F.explode(openers).alias("w")).select(key, F.substring("w", 2, 1 << 30).alias("w")).distinct()
    known = asked.join(lower, "w").groupBy(key).agg(F.collect_set("w").alias("_lower"))
    return table.join(known, key, "left").withColumn("_lower", F.coalesce("_lower", F.array().cast("array<string>")))


def _rows(table: DataFrame, keep: list[str], lower: list[str] | DataFrame) -> DataFrame:
    raw, template = words_of(F.col("_clean"), lower if isinstance(lower, list) else F.col("_lower"))
    table = table.withColumn("_clean", _clean(F.coalesce("text", F.lit(""))))
    return table.select(*keep, raw.alias("raw"), template.alias("words"))


def windows(rows: DataFrame, keep: list[str], widths: list[int]) -> DataFrame:
    """``keep`` columns, place, width and hash of the windows of the given widths.

    All expressions behind the explode are compiled into one stage, in which the words stay where they are: a row for each window carries none of them.
    """
    least = min(widths)
    # explode_outer and a later filter: a filter on the places themselves would be pushed down and cut every text a second time.
    places = F.when(F.size("words") >= least, F.sequence(F.lit(1), F.size("words") - (least - 1)))
    rows = rows.select(*keep, "words", F.explode_outer(places).alias("place")).filter(F.col("place").isNotNull())
    if len(widths) > 1:
        rows = rows.select("*", F.explode(F.array(*[F.lit(w) for w in widths])).alias("width")).filter(F.size("words") - F.col("width") + 1 >= F.col("place"))
    else:
        rows = rows.select("*", F.lit(least).alias("width"))
    hashed = F.lit(None).cast("long")
    for w in widths:
        hashed = F.when(F.col("width") == w, F.xxhash64(F.lit(w), *[F.get("words", F.col("place") + (k - 1)) for k in range(w)])).otherwise(hashed)
    return rows.select(*keep, "place", "width", hashed.alias("hash"))


def _slots(place: Column, width: Column) -> Column:
    """Kind and value of each placeholder of a window."""
    zipped = F.arrays_zip(F.slice("words", place, width).alias("w"), F.slice("raw", place, width).alias("r"))
    return F.transform(F.filter(zipped, lambda x: F.startswith(x["w"], F.lit("#"))), lambda x: F.struct(x["w"].alias("kind"), x["r"].alias("value")))


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_windows, item_place, at, slots, item_slots) of the windows that documents share with items; ``at`` is their alignment."""
    small = lambda size: (size or 0) <= BROADCAST_BYTES
    lower = lower_words(benchmark)
    marked = _with_lower(benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("own")), "own", lower)
    own = materialise(_rows(marked, ["item_id", "own"], lower).filter(F.size("words") > 0).dropDuplicates(["own"]), "items")
    fit = F.least(F.size("words"), F.lit(WIDTH))
    items = windows(own.withColumn("fit", fit).withColumn("total", F.size("words") - fit + 1), ["item_id", "own", "fit", "total"], list(range(1, WIDTH + 1))).filter("width = fit")
    items = items.join(own.drop("item_id"), "own")
    items = items.select("item_id", F.col("width").alias("_width"), F.col("total").alias("item_windows"), F.col("place").alias("item_place"), F.col("hash").alias("_hash"), _slots(F.col("place"), F.col("width")).alias("item_slots"))
    right = materialise(items.distinct(), "windows")
    known = right.agg(F.array_sort(F.collect_set("_width")).alias("widths"), F.sum(100 + 60 * F.size("item_slots") + F.length(F.to_json("item_slots"))).alias("bytes")).first()
    # A row is known by its id and text, as ids may repeat.
    base = _with_lower(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")), "row", lower)
    left = windows(_rows(base, ["doc_id", "row"], lower), ["doc_id", "row"], list(known["widths"]) or [WIDTH])
    met = left.join(F.broadcast(right) if small(known["bytes"]) else right, F.col("hash") == F.col("_hash")).filter(F.col("width") == F.col("_width"))
    met = materialise(met.select("doc_id", "row", "place", "width", "item_id", "item_windows", "item_place", "item_slots").distinct(), "met")
    # Slots of the windows that were met, a row for each document.
    at = materialise(met.groupBy("row").agg(F.collect_set(F.struct("place", "width")).alias("at")), "at")
    size = at.agg(F.sum(48 + 24 * F.size("at"))).first()[0]
    cut = _rows(base.join(F.broadcast(at) if small(size) else at, "row"), ["row", "at"], lower)
    cut = cut.select("row", F.explode(F.transform("at", lambda p: F.struct(p["place"].alias("place"), p["width"].alias("width"), _slots(p["place"], p["width"]).alias("slots")))).alias("w")).select("row", "w.*").distinct()
    hit = met.join(cut, ["row", "place", "width"]).withColumnRenamed("width", "_width")
    names = F.size(F.filter(F.coalesce("item_slots", F.array()), lambda x: x["kind"] == "#w"))
    free = (names * 2 <= F.col("_width") + 1) & (F.col("_width") >= LEAST_WORDS)
    hit = hit.filter(free | F.col("slots").eqNullSafe(F.col("item_slots")))
    hit = hit.select("doc_id", "item_id", "item_windows", "item_place", (F.col("place") - F.col("item_place")).alias("at"), "slots", "item_slots").distinct()
    return materialise(hit, "hits")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, exact) of every leak.

    ``exact`` tells that all slot values are those of the benchmark.
    """
    with scratch(docs.sparkSession) as own:
        hit = own.keep(_hits(docs, benchmark))
    line = ["doc_id", "item_id", "at"]
    pairs = hit.filter(F.size(F.coalesce("item_slots", F.array())) > 0).select(*line, F.explode(F.arrays_zip(F.col("item_slots").alias("b"), F.col("slots").alias("d"))).alias("p"))
    values = pairs.groupBy(*line, "p.b.kind", F.col("p.b.value").alias("item"), F.col("p.d.value").alias("doc")).agg(F.count(F.lit(1)).alias("n"))
    one_way = values.groupBy(*line, "kind", "item").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc") != F.col("item")).alias("changed"))
    other_way = values.groupBy(*line, "kind", "doc").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc") != F.col("item")).alias("changed"))
    slot = one_way.select(*line, "n", "changed").union(other_way.select(*line, "n", "changed")).groupBy(*line).agg(F.max(F.col("n") > 1).alias("torn"), F.max("changed").alias("changed"))
    slot = slot.select(F.struct(*line).alias("_line"), "torn", "changed")
    kept = hit.join(slot, F.struct(*line).eqNullSafe(F.col("_line")), "left").filter(~F.coalesce("torn", F.lit(False)))
    out = kept.groupBy("doc_id", "item_id").agg(F.count_distinct("item_place").alias("n_windows"), F.max("item_windows").alias("item_windows"), (~F.max(F.coalesce("changed", F.lit(False)))).alias("exact"))
    return out.withColumn("coverage", F.col("n_windows") / F.col("item_windows")).filter(F.col("coverage") >= coverage).select("doc_id", "item_id", F.col("n_windows").cast("long"), F.col("item_windows").cast("long"), "coverage", "exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents that leak an item; rows with a null id stay."""
    with scratch(docs.sparkSession) as own:
        found = own.keep(materialise(leaks(docs, benchmark, coverage).select("doc_id").distinct(), "leaking"))
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
