"""Edits of the topic tree whose outcome depends on their order: moves under other parents and merges.

An edit is judged by the tree as the edits before it have left it. Each round judges, with joins, all edits up to the first one whose target lies below (or is) a topic
that an earlier edit touches: the paths of those before it are still the paths of the tree at hand. So unrelated edits take one round, and edits that lean on each other
a round for each link of the chain. Only the paths of the targets are walked.

Defined cases: an empty table of edits leaves all as it is; a topic or target that does not exist, or is null where one is needed, refuses the edit; a target that stands in a
loop already refuses a move; ``pos`` orders the edits and is distinct; extra columns of topics stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silexa.operators import tree
from silexa.session import checkpointed


def described(topics: DataFrame, ops: DataFrame) -> DataFrame:
    """Topics with new descriptions (topic_id, description); a null takes the description away."""
    base = topics if "description" in topics.columns else topics.withColumn("description", F.lit(None).cast("string"))
    new = ops.select("topic_id", F.col("description").alias("_new"), F.lit(True).alias("_given"))
    rows = base.join(new, "topic_id", "left").withColumn("description", F.when(F.col("_given"), F.col("_new")).otherwise(F.col("description")))
    return rows.select(*base.columns)


def _judged(topics: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``ops`` (pos, topic_id, target_id) that the tree at hand decides, with ``_here``, ``_known``, ``_below`` and ``_ends`` (topic there, target there, target below the topic or it, its path ends at a root), and the rest, if any."""
    up = tree.ancestors(topics, ops.filter("target_id IS NOT NULL").select(F.col("target_id").alias("topic_id"))).select(F.col("topic_id").alias("target_id"), "ancestor_id")
    paths = checkpointed(ops.join(up, "target_id").select("pos", "topic_id", "target_id", "ancestor_id"))
    touched = ops.groupBy(F.col("topic_id").alias("ancestor_id")).agg(F.min("pos").alias("_first"))
    stop = paths.join(touched, "ancestor_id").filter("_first < pos").agg(F.min("pos")).first()[0]
    ids = topics.select(F.col("topic_id").alias("_id"), "parent_id")
    facts = paths.join(ids, F.col("ancestor_id") == F.col("_id"), "left").groupBy("pos").agg(
        F.max((F.col("ancestor_id") == F.col("target_id")) & F.col("_id").isNotNull()).alias("_known"),
        F.max(F.col("ancestor_id") == F.col("topic_id")).alias("_below"),
        F.max(F.col("parent_id").isNull()).alias("_ends"),
    )
    here = topics.select("topic_id", F.lit(True).alias("_here"))
    now = (ops if stop is None else ops.filter(F.col("pos") < F.lit(stop))).join(facts, "pos", "left").join(here, "topic_id", "left")
    no = F.lit(False)
    now = now.select("pos", "topic_id", "target_id", *[F.coalesce(c, no).alias(c) for c in ("_here", "_known", "_below", "_ends")])
    return now, None if stop is None else ops.filter(F.col("pos") >= F.lit(stop))


def reparented(topics: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics after ``moves`` (pos, topic_id, new_parent_id; null for the top), and (pos, topic_id, outcome): moved, self, cycle, unknown topic or unknown parent."""
    left, told = checkpointed(moves.select("pos", "topic_id", F.col("new_parent_id").alias("target_id"))), None
    while left is not None:
        now, left = _judged(topics, left)
        to = F.col("target_id")
        outcome = F.when(~F.col("_here"), "unknown topic").when(to.isNull(), "moved").when(to == F.col("topic_id"), "self").when(~F.col("_known"), "unknown parent").when(F.col("_below") | ~F.col("_ends"), "cycle").otherwise("moved")
        now = checkpointed(now.select("pos", "topic_id", "target_id", outcome.alias("outcome")))
        last = now.filter("outcome = 'moved'").groupBy("topic_id").agg(F.max_by(F.struct("target_id"), "pos").alias("_to"))
        parent = F.when(F.col("_to").isNotNull(), F.col("_to.target_id")).otherwise(F.col("parent_id"))
        topics = checkpointed(topics.join(last, "topic_id", "left").withColumn("parent_id", parent).select(*topics.columns))
        told = now if told is None else told.union(now)
    return topics, told.select("pos", "topic_id", "outcome")


def _ends(to: DataFrame) -> DataFrame:
    """(topic_id, target_id) with every chain, which has no loops, followed to its end: each round doubles the steps."""
    while True:
        step = to.select(F.col("topic_id").alias("target_id"), F.col("target_id").alias("_next"))
        out = checkpointed(to.join(step, "target_id", "left").select("topic_id", F.coalesce("_next", "target_id").alias("target_id"), F.col("_next").isNotNull().alias("_on")))
        to = out.drop("_on")
        if out.filter("_on").isEmpty():
            return to


def merged_topics(topics: DataFrame, filings: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics and filings after merging ``pairs`` (topic_id into target_id, in the order of pos, else of the ids), and (topic_id, target_id, outcome).

    Children and claims move to the topic at the end of the chain, whether the target was merged before or after; a target's own filings stay as they are. Outcomes: merged,
    self, below (the target lies below the topic, or in a loop), merged already, unknown topic, unknown target. ``target_id`` is the end of the chain of what was merged, else as asked.
    """
    ops = pairs if "pos" in pairs.columns else pairs.withColumn("pos", F.concat_ws(" ", "topic_id", "target_id"))
    left = checkpointed(ops.select("pos", "topic_id", "target_id"))
    asked, to, told = left, None, None
    while left is not None:
        if to is not None:
            known = to.select(F.col("topic_id").alias("target_id"), F.col("target_id").alias("_end"))
            left = checkpointed(left.join(known, "target_id", "left").select("pos", "topic_id", F.coalesce("_end", "target_id").alias("target_id")))
        now, left = _judged(topics, left)
        done = to.select("topic_id", F.lit(True).alias("_done")) if to is not None else now.sparkSession.createDataFrame([], now.select("topic_id").schema).withColumn("_done", F.lit(True))
        outcome = F.when(~F.col("_here"), "unknown topic").when(F.col("_done"), "merged already").when(~F.col("_known"), "unknown target").when(F.col("target_id") == F.col("topic_id"), "self").when(F.col("_below") | ~F.col("_ends"), "below").otherwise("merged")
        now = now.join(done, "topic_id", "left").select("pos", "topic_id", "target_id", outcome.alias("outcome"))
        first = now.filter("outcome = 'merged'").groupBy("topic_id").agg(F.min("pos").alias("_first"))
        again = (F.col("outcome") == "merged") & (F.col("pos") > F.col("_first"))
        now = checkpointed(now.join(first, "topic_id", "left").withColumn("outcome", F.when(again, "merged already").otherwise(F.col("outcome"))).drop("_first"))
        fresh = now.filter("outcome = 'merged'").select("topic_id", "target_id")
        to = _ends(fresh if to is None else to.union(fresh))
        new = to.join(fresh.select("topic_id"), "topic_id", "left_semi").select(F.col("topic_id").alias("_from"), F.col("target_id").alias("_to"))
        rows = topics.join(new.select(F.col("_from").alias("topic_id"), F.lit(True).alias("_own")), "topic_id", "left").join(new, F.col("parent_id") == F.col("_from"), "left")
        rows = rows.withColumn("status", F.when(F.col("_own"), "merged").otherwise(F.col("status"))).withColumn("parent_id", F.coalesce("_to", "parent_id"))
        topics = checkpointed(rows.select(*topics.columns))
        told = now if told is None else told.union(now)
    moved = filings.join(to.select(F.col("topic_id").alias("_from"), "target_id"), F.col("topic_id") == F.col("_from"), "left")
    moved = moved.select("claim_id", F.coalesce("target_id", "topic_id").alias("topic_id"), "filed_at", F.col("_from").isNotNull().alias("_moved"))
    kept = moved.groupBy("claim_id", "topic_id").agg(F.min(F.struct("_moved", "filed_at")).alias("r")).select("claim_id", "topic_id", "r.filed_at")
    ends = asked.join(told.select("pos", "outcome"), "pos").join(to.withColumnRenamed("target_id", "_end"), "topic_id", "left")
    return topics, kept, ends.select("topic_id", F.when(F.col("outcome") == "merged", F.col("_end")).otherwise(F.col("target_id")).alias("target_id"), "outcome")
