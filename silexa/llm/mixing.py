"""Mixing sources to target weights, with DataFrame operations only.

Every source gets a share of ``budget`` times all words by its weight; a share above ``most`` times the source's own
words stops there and the excess goes to the others by weight. The levels come from one sorted pass over the sources
(water filling), not from repeated rounds. Each document is then emitted floor(rate) times, and once more when a hash of
(seed, doc_id) falls under the fraction, so reruns agree and no state is kept.

The list of sources is ranked and summed by ranges of its order, so that no task sees all of it. It is broadcast to the documents while it takes ``BROADCAST_BYTES`` at most (measured first), so that no text is shuffled; beyond, the join shuffles.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; rows that share a doc_id share
their draw; an empty table gives an empty result; further columns pass through untouched, but columns named ``size``, ``source_size``,
``target``, ``rate``, ``copies`` or ``copy`` give way to the operator's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silexa.operators.ranks import running

from .common import fresh, materialise

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
SEED = "mix-1"
BROADCAST_BYTES = 64 << 20


def word_count(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on the seed and the id alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row a source, pre-aggregated before its only exchange."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").asc_nulls_last()]
    keep = lambda df: materialise(df, "ranges")
    rows = running(per, by_name, {"nth": F.lit(1)}, keep)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")
    rows = rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    # Sources whose cap is smallest for their weight are filled first; ties are in the order of the sources.
    share = F.col("cap") / F.col("weight")
    rows = materialise(running(rows, [share.asc(), *by_name], {"filled": F.col("cap"), "closed": F.col("weight")}, keep), "filled")
    whole = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    level = (F.lit(float(budget)) * F.lit(whole["size"]) - F.col("filled")) / (F.lit(whole["weight"]) - F.col("closed"))
    rows = rows.withColumn("level", level)
    # The first source that does not stop fixes the level of all that follow.
    ends = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(share.alias("by"), F.col("source").isNull().alias("last"), F.col("source").alias("name"), "level"))
    fixed = rows.agg(F.min(ends)["level"].alias("level")).first()["level"]
    cap = F.col("cap").cast("double")
    return rows.select("source", "source_size", (cap if fixed is None else F.least(F.lit(fixed) * F.col("weight"), cap)).alias("target"))


def mix_rates(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies; ``docs`` needs doc_id, source and size."""
    (name,) = fresh(docs.columns, "_source")
    targets = materialise(source_targets(docs.select("source", "size"), weights, budget, most).withColumnRenamed("source", name), "targets")
    if targets.agg(F.coalesce(F.sum(64 + F.coalesce(F.octet_length(name), F.lit(0))), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    out = docs.join(targets, docs["source"].eqNullSafe(F.col(name)), "left").drop(name)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    fraction = F.col("rate") - F.floor("rate")
    return out.withColumn("rate", rate).withColumn("copies", F.floor("rate") + F.when(draw(F.col("doc_id"), seed) < fraction, 1).otherwise(0))


def mixed_sizes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies and taken of every document, without the texts."""
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix_rates(sized, **how).select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as many times as it was drawn, with the number of the copy from 0."""
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "rate", "copies", "copy")]
    sized = docs.select(*names, word_count(F.col("text")).alias("size"))
    out = mix_rates(sized, **how).filter(F.col("copies") > 0)
    return out.select(*names, F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
