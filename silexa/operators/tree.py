"""Trees and redirect chains as fixpoints of joins; every level is one join and is checkpointed, so plans stay short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silexa.session import checkpointed

#: After so many levels what has been found is written once more, so that the plan stays short.
LEVELS = 8


def closure(topics: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root_id, topic_id, depth): every topic, or every one of ``roots`` (topic_id), with itself and its active descendants.

    Runs until a level finds nothing new, so a tree may have any depth and a cycle ends where it meets a pair again.
    """
    seeds = topics if roots is None else topics.join(roots.select("topic_id").distinct(), "topic_id", "left_semi")
    found = checkpointed(seeds.select(F.col("topic_id").alias("root_id"), "topic_id", F.lit(0).alias("depth")))
    edges = checkpointed(topics.filter("status = 'active' AND parent_id IS NOT NULL").select(F.col("topic_id").alias("child"), "parent_id"))
    frontier, depth = found, 0
    while True:
        depth += 1
        step = frontier.join(edges, F.col("topic_id") == F.col("parent_id")).select("root_id", F.col("child").alias("topic_id"), F.lit(depth).alias("depth"))
        frontier = checkpointed(step.distinct().join(found, ["root_id", "topic_id"], "left_anti").select("root_id", "topic_id", "depth"))
        if frontier.isEmpty():
            return found
        found = found.union(frontier)
        if depth % LEVELS == 0:
            found = checkpointed(found)


def ancestors(topics: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(topic_id, ancestor_id, distance) up the parent links whatever the status, the topic itself at 0, for every topic or those of ``of`` (topic_id); a loop ends where it meets a pair again."""
    up = checkpointed(topics.filter("parent_id IS NOT NULL").select(F.col("topic_id").alias("_id"), "parent_id"))
    seeds = topics if of is None else of.select("topic_id").distinct()
    found = checkpointed(seeds.select("topic_id", F.col("topic_id").alias("ancestor_id"), F.lit(0).alias("distance")))
    frontier, n = found, 0
    while True:
        n += 1
        step = frontier.join(up, F.col("ancestor_id") == F.col("_id")).select("topic_id", F.col("parent_id").alias("ancestor_id"), F.lit(n).alias("distance"))
        frontier = checkpointed(step.distinct().join(found, ["topic_id", "ancestor_id"], "left_anti").select("topic_id", "ancestor_id", "distance"))
        if frontier.isEmpty():
            return found
        found = found.union(frontier)
        if n % LEVELS == 0:
            found = checkpointed(found)


def makes_cycle(topics: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (topic_id, new_parent_id) with ``cycle``: whether the new parent is the topic itself or lies below it, or stands in a loop already."""
    up = ancestors(topics)
    parents = topics.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("_parent"), F.col("topic_id").alias("_child"))
    looped = up.join(parents, (F.col("topic_id") == F.col("_parent")) & (F.col("ancestor_id") == F.col("_child"))).select(F.col("topic_id").alias("loop_id")).distinct()
    into_loop = up.join(looped, F.col("ancestor_id") == F.col("loop_id")).select(F.col("topic_id").alias("_new"), F.lit(True).alias("_loops")).distinct()
    above = up.select(F.col("topic_id").alias("_at"), F.col("ancestor_id").alias("_up"))
    out = moves.join(above, (F.col("new_parent_id") == F.col("_at")) & (F.col("topic_id") == F.col("_up")), "left").join(into_loop, F.col("new_parent_id") == F.col("_new"), "left")
    return out.select("topic_id", "new_parent_id", (F.col("_at").isNotNull() | F.col("topic_id").eqNullSafe(F.col("new_parent_id")) | F.coalesce("_loops", F.lit(False))).alias("cycle"))


def resolve_redirects(claims: DataFrame, most: int = 20, of: DataFrame | None = None) -> DataFrame:
    """(claim_id, target_id, hops): the unmerged claim at the end of the chain of each claim, or of those of ``of`` (claim_id); null for a cycle, a missing claim or more than ``most`` hops."""
    step = checkpointed(claims.select(F.col("claim_id").alias("_id"), "merged_into", "status"))
    now = (claims if of is None else of).select("claim_id", F.col("claim_id").alias("at_id"), F.lit(0).alias("hops"))
    done = None
    for _ in range(most + 1):
        joined = checkpointed(now.join(step, F.col("at_id") == F.col("_id"), "left"))
        ended = joined.filter("merged_into IS NULL").select("claim_id", F.when(F.col("status") == "active", F.col("at_id")).alias("target_id"), "hops")
        done = ended if done is None else done.union(ended)
        now = joined.filter("merged_into IS NOT NULL").select("claim_id", F.col("merged_into").alias("at_id"), (F.col("hops") + 1).alias("hops"))
        if now.isEmpty():
            return done
    return done.union(now.select("claim_id", F.lit(None).cast("long").alias("target_id"), "hops"))
