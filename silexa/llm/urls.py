"""URL filters: a Bloom filter cascade that answers membership exactly for every key of a known universe, without joins.

Level 1 encodes the listed keys; level 2 encodes the keys of the universe that level 1 reports wrongly; level 3 the
listed keys that level 2 reports wrongly, and so on until a level makes no mistake. A key is listed when the first level that
denies it is an even one (counting from 1). The universe is every (host suffix, path prefix) that any url of the corpus can ask for.
Filters are built by Spark: each key sets a few bits, words of 64 bits are OR-ed per word number.
The finished words are broadcast while they stay under ``max_bytes``; beyond that, or if a listed and an unlisted key have one 64-bit hash (found when a level
no longer shrinks), membership is a left semi join on the key itself instead.

Defined cases: a url that is null or has no ``://`` has empty host and path, fits no rule and is allowed unless the empty host
is listed; repeated rows are judged alike; an empty table gives an empty result. A host of very many labels has as many keys as the
longest listed one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialise

#: (rule, action), as the contract of the query fixes them.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
BITS_PER_KEY = 6
HASHES = 3
MAX_BYTES = 64 << 20


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    return ascii_lower(host), path


def candidate_keys(host: Column, path: Column, prefix_lengths: Sequence[int], most_labels: int) -> Column:
    """Every host suffix on a label boundary of at most so many labels, each with the path's prefixes of the given lengths."""
    labels = F.split(host, r"\.", -1)
    first = F.greatest(F.lit(1), F.size(labels) - (most_labels - 1))
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ends = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) if n else F.lit("") for n in sorted(set(prefix_lengths))])
    return F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(ends, lambda e: e.isNotNull()), lambda e: F.concat(s, e))))


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def _positions(h: Column, level: int, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(h, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(HASHES)])


def _level(keys: DataFrame, level: int, bits: int) -> np.ndarray:
    """The filter's words; the rows that reach the driver are at most bits / 64 pairs, under the bound checked before."""
    rows = (
        keys.select(F.explode(_positions(F.col("h"), level, bits)).alias("p"))
        .groupBy((F.col("p") / 64).cast("long").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("mask"))
        .toPandas()
    )
    words = np.zeros((bits + 63) // 64, dtype=np.int64)
    words[rows["word"].to_numpy(dtype=np.int64)] = rows["mask"].to_numpy(dtype=np.int64)
    return words


def _hit(words_by_level: list[tuple[int, np.ndarray]], h: Column, level: int) -> Column:
    """Whether the filter of one level reports the hash, as a pandas UDF over the JVM's bit positions."""
    bits, words = words_by_level[level]

    @F.pandas_udf(T.BooleanType())
    def hit(*at: pd.Series) -> pd.Series:
        ok = np.ones(len(at[0]), dtype=bool)
        for p in at:
            p = p.to_numpy(dtype=np.int64)
            ok &= (words[p >> 6] >> (p & 63)) & 1 == 1
        return pd.Series(ok)

    return hit(*[F.pmod(F.xxhash64(h, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(HASHES)])


class Cascade:
    """The levels of a finished cascade; ``listed`` tests a column of key hashes."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = levels

    def listed(self, hashes: Column) -> Column:
        """array<boolean> for array<long>; exact for hashes of the universe."""
        levels = self.levels

        @F.pandas_udf(T.ArrayType(T.BooleanType()))
        def test(positions: pd.Series) -> pd.Series:
            nested = pa.array(positions, pa.list_(pa.list_(pa.int64())))
            sizes = pc.fill_null(pc.list_value_length(nested), 0).to_numpy(zero_copy_only=False)
            if not sizes.sum():
                return pd.Series([[] for _ in sizes])
            flat = nested.flatten().flatten().to_numpy().reshape(int(sizes.sum()), -1)
            found, open_ = np.zeros(len(flat), dtype=bool), np.ones(len(flat), dtype=bool)
            for k, (_, words) in enumerate(levels):
                at = flat[:, k * HASHES : (k + 1) * HASHES]
                yes = np.all((words[at >> 6] >> (at & 63)) & 1 == 1, axis=1)
                found = np.where(open_ & ~yes, k % 2 == 1, found)
                open_ &= yes
            found |= open_ & (len(levels) % 2 == 1)
            return pd.Series(np.split(found, np.cumsum(sizes)[:-1]))

        every = lambda h: F.array(*[F.pmod(F.xxhash64(h, F.lit(k), F.lit(i)), F.lit(bits)) for k, (bits, _) in enumerate(levels) for i in range(HASHES)])
        return test(F.transform(hashes, every)) if levels else F.transform(hashes, lambda h: F.lit(False))


def build_cascade(universe: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """From (h, listed); None when the filters would pass ``max_bytes``, or when a listed and an unlisted key share their hash, which no level can tell apart."""
    yes, no = universe.filter("listed").select("h"), universe.filter("not listed").select("h")
    levels: list[tuple[int, np.ndarray]] = []
    inside, outside, total, earlier = yes, no, 0, []
    while True:
        n = inside.count()
        if not n:
            return Cascade(levels)
        # Levels shrink from one to the next of their kind, unless hashes that both sides share are what is left.
        if len(earlier) > 1 and n >= earlier[-2] and not inside.join(outside, "h", "left_semi").isEmpty():
            return None
        earlier.append(n)
        bits = 64 * max(1, math.ceil(n * bits_per_key / 64))
        total += bits // 8
        if total > max_bytes:
            return None
        levels.append((bits, _level(inside, len(levels), bits)))
        wrong = materialise(outside.filter(_hit(levels, F.col("h"), len(levels) - 1)), f"level{len(levels)}")
        inside, outside = wrong, inside


def judge_urls(pages: DataFrame, listed_hosts: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``pages`` (url) with host, path, rule and verdict; ``listed_hosts`` (host) are blocked where no rule fits.

    Rules are configuration and short; the host list may be large and takes part in the cascade like the rules do.
    """
    lengths = sorted({len(r[r.index("/") :]) for r, _ in rules} | {0})
    host, path = url_parts(F.col("url"))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    keys, flags, row, found_keys, met = fresh(names, "_keys", "_listed", "_row", "_found", "_hits")
    parts = pages.select(*names, host.alias("host"), path.alias("path"))
    # A suffix with more labels than any listed host or rule cannot hit.
    rule_hosts = [r[: r.index("/")] for r, _ in rules]
    most = max([1 + h.count(".") for h in rule_hosts] + [listed_hosts.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1])
    keyed = parts.withColumn(keys, candidate_keys(F.col("host"), F.col("path"), lengths, most))
    asked = keyed.select(F.explode(F.array_distinct(keys)).alias("key")).distinct()
    rule_rows = pages.sparkSession.createDataFrame([(r,) for r, _ in rules], "key string")
    # The only join of the build: it marks the listed keys in the universe, once per distinct key and never per page.
    marks = listed_hosts.select(F.col("host").alias("key")).union(rule_rows).distinct().withColumn("listed", F.lit(True))
    universe = materialise(asked.join(marks, "key", "left").select("key", key_hash(F.col("key")).alias("h"), F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    cascade = build_cascade(universe.select("h", "listed"), max_bytes=max_bytes)
    if cascade is not None:
        keyed = keyed.withColumn(flags, cascade.listed(F.transform(keys, key_hash)))
        hits = F.filter(F.transform(F.arrays_zip(F.col(keys).alias("k"), F.col(flags).alias("f")), lambda x: F.when(x["f"], x["k"])), lambda x: x.isNotNull())
    else:
        rows = keyed.withColumn(row, F.monotonically_increasing_id())
        rows = materialise(rows, "keyed")
        found = rows.select(row, F.explode(keys).alias("key")).join(universe.filter("listed"), "key", "left_semi").groupBy(row).agg(F.collect_set("key").alias(found_keys))
        keyed = rows.join(found, row, "left")
        hits = F.coalesce(F.col(found_keys), F.array().cast("array<string>"))
    keyed = keyed.withColumn(met, hits)
    action = F.create_map(*[F.lit(x) for r in rules for x in r])
    own = F.filter(met, lambda k: F.array_contains(F.map_keys(action), k))
    longest = F.array_max(F.transform(own, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    keyed = keyed.withColumn("rule", longest)
    blocked = F.exists(met, lambda k: ~F.contains(k, F.lit("/")))
    verdict = F.when(F.col("rule").isNotNull(), F.element_at(action, F.col("rule"))).when(blocked, "block").otherwise("allow")
    return keyed.select(*names, "host", "path", "rule", verdict.alias("verdict"))
