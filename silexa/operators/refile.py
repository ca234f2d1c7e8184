"""Filing claims into a tree that grows where they need it, round by round, until nothing moves any more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silexa.operators.changes import placed
from silexa.session import checkpointed

ROUNDS, PLATEAUS = 8, 2


def _filed(tags: DataFrame, topics: DataFrame, number: int) -> DataFrame:
    links = placed(tags, topics).filter("action = 'link'")
    return links.groupBy("claim_id").agg(F.min("topic_id").alias("topic_id")).withColumn("round", F.lit(number))


def _grown(tags: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics with a new one for each name that is asked for under a known parent; of several parents the smallest id counts."""
    asked = placed(tags, topics).filter("action = 'create'").groupBy(F.lower("tag").alias("_name")).agg(F.min("tag").alias("name"), F.min("topic_id").alias("parent_id"))
    return topics.union(asked.select(F.concat("parent_id", F.lit("/"), F.md5("_name")).alias("topic_id"), "name", "parent_id"))


def refile(tags: DataFrame, topics: DataFrame, rounds: int = ROUNDS, plateaus: int = PLATEAUS) -> tuple[DataFrame, DataFrame, list[int]]:
    """(claim_id, topic_id, round) of the claims that found a topic, the topics (topic_id, name, parent_id) as they are then, and how many claims each round left over.

    ``tags`` (claim_id, tag, parent, pos) say where claims belong. A round files what has a topic of that name, opens topics under known parents for the rest, and files once
    more. It ends when all are filed, after ``rounds``, or when ``plateaus`` rounds in a row leave as many as the round before: the rest asks for parents that nobody has.

    Defined cases: names meet whatever their case; two tags of a claim count at most; a null tag or parent finds nothing; empty tables file nothing; repeated rows count once.
    """
    topics = checkpointed(topics.filter("status = 'active'").select("topic_id", "name", "parent_id") if "status" in topics.columns else topics.select("topic_id", "name", "parent_id"))
    open_ = checkpointed(tags.select("claim_id", "tag", "parent", "pos").distinct())
    filed, history, idle = None, [], 0
    for number in range(1, rounds + 1):
        for grow in (False, True):
            if grow:
                topics = checkpointed(_grown(open_, topics))
            new = checkpointed(_filed(open_, topics, number))
            filed = new if filed is None else filed.union(new)
            open_ = checkpointed(open_.join(new, "claim_id", "left_anti"))
            if open_.isEmpty():
                break
        history.append(open_.select("claim_id").distinct().count())
        idle = idle + 1 if len(history) > 1 and history[-1] >= history[-2] else 0
        if history[-1] == 0 or idle >= plateaus:
            break
    return filed, topics, history
