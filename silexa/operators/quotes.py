"""Exact quotes: which documents hold a passage character for character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the windows in which passages are looked up.
WIDTH = 5
BROADCAST_BYTES = 64 << 20


def _key(words: str, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(WIDTH)])


def exact(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) for ``docs`` (doc_id, text) and ``items`` (item_id, text).

    A passage may begin or end inside a word of the document, so the hash of its second to sixth words is looked up among the documents' windows of five words,
    and what is found is compared in full. Passages under seven words, a stated set of short texts, are compared with every document.
    """
    words = F.split("text", " ")
    long_, short = items.filter(F.size(words) >= WIDTH + 2), items.filter(F.size(words) < WIDTH + 2)
    right = long_.select("item_id", F.col("text").alias("passage"), words.alias("w")).select("item_id", "passage", _key("w", F.lit(1)).alias("key"))
    places = F.when(F.size("w") >= WIDTH, F.sequence(F.lit(0), F.size("w") - WIDTH))
    left = docs.select("doc_id", "text", words.alias("w")).select("doc_id", "text", "w", F.explode_outer(places).alias("at")).filter(F.col("at").isNotNull()).select("doc_id", "text", _key("w", F.col("at")).alias("key"))
    size = long_.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        found = left.join(F.broadcast(right), "key").filter(F.contains("text", F.col("passage"))).select("doc_id", "item_id")
    else:
        pairs = left.select("doc_id", "key").distinct().join(right.select("key", "item_id"), "key").select("doc_id", "item_id").distinct()
        found = docs.join(pairs, "doc_id").join(long_.select("item_id", F.col("text").alias("passage")), "item_id").filter(F.contains("text", F.col("passage"))).select("doc_id", "item_id")
    few = short.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()
    if few[0]:
        other = short.select("item_id", F.col("text").alias("passage"))
        found = found.union(docs.join(F.broadcast(other) if few[1] <= BROADCAST_BYTES else other, F.contains("text", F.col("passage"))).select("doc_id", "item_id"))
    return found.distinct()
