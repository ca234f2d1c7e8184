"""Mutations as rewrites of tables: every function takes tables and gives the tables that are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silexa.operators.tree import ancestors

#: What may be said of a flag that is settled (fixed values).
RESOLUTIONS = ("approved", "edited", "split", "narrowed", "archived", "false_positive", "reworded")


def _null_safe(left: DataFrame, right: DataFrame, key: list[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out &= left[k].eqNullSafe(right[k])
    return out


def upsert_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with those of ``rows`` whose key it lacks; of new rows with one key the least stays."""
    new = rows.groupBy(*key).agg(F.min(F.struct(*[c for c in table.columns if c not in key])).alias("_r")) if len(table.columns) > len(key) else rows.select(*key).distinct()
    new = new.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in table.columns])
    return table.unionByName(new.join(table, _null_safe(new, table, key), "left_anti"))


def upsert_overwrite(table: DataFrame, rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """``table`` and ``rows`` with one row a key: the last of ``rows`` in the order ``by``, else the table's own."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.col("_new").desc(), *[F.col(c).desc() for c in by])
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def without_sources(gone: DataFrame, insights: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insights and memberships without those of the sources ``gone`` (source_id)."""
    left = insights.join(gone, "source_id", "left_anti")
    return left, members.join(left.select("insight_id"), "insight_id", "left_semi")


def renamed(topics: DataFrame, ops: DataFrame) -> DataFrame:
    """Topics under new names (topic_id, name); addresses stay."""
    return topics.join(ops.select("topic_id", F.col("name").alias("_name")), "topic_id", "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")


def archived(topics: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (topic_id) archived; their children move up to the nearest ancestor that is not archived with them."""
    gone = ids.select("topic_id").distinct().withColumn("_gone", F.lit(True))
    up = ancestors(topics).filter("distance > 0").join(gone.select(F.col("topic_id").alias("ancestor_id"), F.lit(True).alias("_a")), "ancestor_id", "left").filter("_a IS NULL")
    nearest = up.groupBy("topic_id").agg(F.min_by("ancestor_id", "distance").alias("_parent"))
    rows = topics.join(gone, "topic_id", "left").join(nearest, "topic_id", "left")
    own = F.coalesce("_gone", F.lit(False))
    return rows.withColumn("status", F.when(own, "archived").otherwise(F.col("status"))).withColumn("parent_id", F.when(own, F.col("parent_id")).otherwise(F.col("_parent"))).drop("_gone", "_parent")


def resolved(flags: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags (flag_id, resolution, ...) with the resolutions asked for, and (pos, answer) of ``asks`` (pos, flag_id, resolution).

    400 for an ask without a flag or with a verb that is none of ``RESOLUTIONS``, 404 for a flag that is not there, else 200; of several good asks for one flag the last counts.
    """
    bad = F.coalesce("flag_id", F.lit("")) == ""
    good = F.coalesce(F.col("resolution").isin(*RESOLUTIONS), F.lit(False))
    known = flags.select("flag_id", F.lit(True).alias("_known")).distinct()
    rows = asks.join(known, "flag_id", "left").withColumn("answer", F.when(bad | ~good, 400).when(F.col("_known").isNull(), 404).otherwise(200))
    last = rows.filter("answer = 200").groupBy("flag_id").agg(F.max_by("resolution", "pos").alias("_asked"))
    out = flags.join(last, "flag_id", "left").withColumn("resolution", F.coalesce("_asked", "resolution")).select(*flags.columns)
    return out, rows.select("pos", "answer")


def decided(reviews: DataFrame, decisions: DataFrame, claims: DataFrame) -> DataFrame:
    """(review_id, answer, status): what a decision (review_id, accept) does: 404 without a review, 400 without an answer, 409 where it is settled or a claim is not active."""
    active = claims.filter("status = 'active'")
    ok = reviews.join(active.select("claim_id"), "claim_id", "left_semi").join(active.select(F.col("claim_id").alias("candidate_id")), "candidate_id", "left_semi").select("review_id", F.lit(True).alias("_ok"))
    rows = decisions.join(reviews.select("review_id", F.col("status").alias("_status")), "review_id", "left").join(ok, "review_id", "left")
    answer = F.when(F.col("_status").isNull(), 404).when(F.col("accept").isNull(), 400).when(F.col("_status") != "pending", 409).when(F.col("accept") & F.col("_ok").isNull(), 409).otherwise(200)
    return rows.select("review_id", answer.alias("answer"), F.when(answer == 200, F.when(F.col("accept"), "accepted").otherwise("rejected")).otherwise(F.col("_status")).alias("status"))


def placed(tags: DataFrame, topics: DataFrame) -> DataFrame:
    """(claim_id, tag, action, topic_id) of proposed tags (claim_id, tag, parent, pos): a link where a topic has the name, a new topic under a known parent, else a
    proposal; two a claim at most. Names that several topics have mean the one of the smallest id."""
    known = topics.groupBy(F.lower("name").alias("_name")).agg(F.min("topic_id").alias("_id"))
    rows = tags.join(known, F.lower("tag") == F.col("_name"), "left").withColumnRenamed("_id", "topic_id").drop("_name")
    rows = rows.join(known.withColumnRenamed("_id", "_parent"), F.lower("parent") == F.col("_name"), "left")
    first = Window.partitionBy("claim_id").orderBy("pos")
    action = F.when(F.col("topic_id").isNotNull(), "link").when(F.col("_parent").isNotNull(), "create").otherwise("propose")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n <= 2").select("claim_id", "tag", action.alias("action"), F.coalesce("topic_id", "_parent").alias("topic_id"))
