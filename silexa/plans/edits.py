"""Edits of the tree in their order, resolutions of flags, and filing by rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silexa.operators import changes as D
from silexa.operators import topics as E
from silexa.operators.refile import refile
from silexa.sources.tables import Tables

from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

_NATIONS = "n AS (SELECT *, CAST(substr(topic_id, 2) AS BIGINT) AS k, EXISTS (SELECT 1 FROM topics s WHERE s.topic_id = t.topic_id || '-BUILDING') AS built FROM topics t WHERE regexp_matches(topic_id, '^N[0-9]+$'))"


def _nations(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Nations with their number, and their segments."""
    number = F.regexp_extract("topic_id", r"^N(\d+)", 1).cast("long")
    rows = t.topics.filter(F.startswith("topic_id", F.lit("N"))).withColumn("k", number)
    return rows.filter(~F.contains("topic_id", F.lit("-"))), rows.filter(F.contains("topic_id", F.lit("-")))


@_R.add(f""", {_NATIONS} SELECT t.topic_id, CASE WHEN t.topic_id LIKE '%-%' THEN 'N' || ((CAST(regexp_extract(t.topic_id, '^N([0-9]+)', 1) AS BIGINT) + 1) % 25) WHEN k % 4 = 0 THEN 'R' || ((CAST(substr(n.parent_id, 2) AS BIGINT) + 1) % 5) WHEN k % 4 = 2 THEN NULL ELSE t.parent_id END AS parent_id,
 CASE WHEN t.topic_id LIKE '%-%' THEN 'moved' WHEN k % 4 IN (0, 2) THEN 'moved' WHEN k % 4 = 3 THEN 'self' WHEN built THEN 'cycle' WHEN k IS NOT NULL THEN 'unknown parent' END AS outcome FROM topics t LEFT JOIN n USING (topic_id)""")
def dml_07_reparented(t: Tables) -> DataFrame:
    """Topics after moves of nations, of which some are refused, and of all their segments to the next nation, judged by the tree that the former have left."""
    nations, segments = _nations(t)
    k, text = F.col("k"), F.lit(None).cast("string")
    region = (F.substring("parent_id", 2, 9).cast("long") + 1) % 5
    to = F.when(k % 4 == 0, F.concat(F.lit("R"), region)).when(k % 4 == 1, F.concat("topic_id", F.lit("-BUILDING"))).when(k % 4 == 3, F.col("topic_id")).otherwise(text)
    one = nations.select(F.concat(F.lit("0 "), "topic_id").alias("pos"), "topic_id", to.alias("new_parent_id"))
    two = segments.select(F.concat(F.lit("1 "), "topic_id").alias("pos"), "topic_id", F.concat(F.lit("N"), (k + 1) % 25).alias("new_parent_id"))
    tree, told = E.reparented(t.topics, one.union(two))
    return tree.join(told.select("topic_id", "outcome"), "topic_id", "left").select("topic_id", "parent_id", "outcome")


@_R.add(f", {_NATIONS} SELECT topic_id, CASE WHEN k % 3 = 0 THEN 'About ' || name END AS description FROM topics LEFT JOIN (SELECT topic_id, k FROM n) USING (topic_id)")
def dml_07_described(t: Tables) -> DataFrame:
    """Topics with descriptions; some are given and taken away again."""
    nations, _ = _nations(t)
    about = F.concat(F.lit("About "), "name").alias("description")
    once = E.described(t.topics, nations.filter("k % 3 < 2").select("topic_id", about))
    return E.described(once, nations.filter("k % 3 = 1").select("topic_id", F.lit(None).cast("string").alias("description"))).select("topic_id", "description")


_CHAINS = f"{_NATIONS}, told AS (SELECT topic_id, CASE WHEN k % 5 < 2 THEN 'N' || (k // 5 * 5 + 2) ELSE topic_id || '-BUILDING' END AS target_id, CASE WHEN k % 5 < 2 THEN 'merged' WHEN built THEN 'below' ELSE 'unknown target' END AS outcome FROM n WHERE k % 5 IN (0, 1, 3))"


def _chains(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    nations, _ = _nations(t)
    k = F.col("k")
    to = F.when(k % 5 < 2, F.concat(F.lit("N"), k + 1)).otherwise(F.concat("topic_id", F.lit("-BUILDING")))
    return E.merged_topics(t.topics, t.filings, nations.filter("k % 5 IN (0, 1, 3)").select("topic_id", to.alias("target_id")))


@_R.add(f", {_CHAINS} SELECT * FROM told")
def dml_07_merge_outcomes(t: Tables) -> DataFrame:
    """Merges of nations in chains and into what lies below them, and where the chains end."""
    return _chains(t)[2]


@_R.add(f", {_CHAINS}, done AS (SELECT topic_id AS gone, target_id FROM told WHERE outcome = 'merged') SELECT t.topic_id, coalesce(p.target_id, t.parent_id) AS parent_id, CASE WHEN o.gone IS NOT NULL THEN 'merged' ELSE t.status END AS status FROM topics t LEFT JOIN done o ON o.gone = t.topic_id LEFT JOIN done p ON p.gone = t.parent_id")
def dml_07_merge_tree(t: Tables) -> DataFrame:
    """The tree after those merges: children stand where the chain ends."""
    return _chains(t)[0].select("topic_id", "parent_id", "status")


@_R.add(f", {_CHAINS}, done AS (SELECT topic_id AS gone, target_id FROM told WHERE outcome = 'merged') SELECT claim_id, topic_id, arg_min(filed_at, (moved, filed_at)) AS filed_at FROM (SELECT claim_id, coalesce(target_id, topic_id) AS topic_id, filed_at, gone IS NOT NULL AS moved FROM filings LEFT JOIN done ON gone = topic_id) GROUP BY 1, 2")
def dml_07_merge_filings(t: Tables) -> DataFrame:
    """Filings after those merges."""
    return _chains(t)[1]


_VERBS = "CASE claim_id % 9 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(D.RESOLUTIONS)) + " WHEN 7 THEN 'maybe' END"
_OF_CLAIM = "claim_id || '-' || CASE claim_id % 3 WHEN 0 THEN 'merge_fidelity' WHEN 1 THEN 'orphan_topic' ELSE 'extraction_fidelity' END"
_ASKS = f"asks AS (SELECT claim_id AS pos, CASE WHEN claim_id % 11 > 0 THEN {_OF_CLAIM} END AS flag_id, {_VERBS} AS resolution FROM claims WHERE claim_id % 8 IN (5, 6))"


def _settled(t: Tables) -> tuple[DataFrame, DataFrame]:
    flags = t.flags.select(F.concat_ws("-", "claim_id", "rule").alias("flag_id"), F.when(F.col("resolved"), "approved").alias("resolution"))
    asks = t.claims.filter("claim_id % 8 IN (5, 6)").selectExpr("claim_id AS pos", f"CASE WHEN claim_id % 11 > 0 THEN {_OF_CLAIM} END AS flag_id", f"{_VERBS} AS resolution")
    return D.resolved(flags, asks)


@_R.add(f", {_ASKS} SELECT f.flag_id, coalesce(a.resolution, CASE WHEN resolved THEN 'approved' END) AS resolution FROM (SELECT claim_id || '-' || rule AS flag_id, resolved FROM flags) f LEFT JOIN (SELECT * FROM asks WHERE resolution <> 'maybe') a USING (flag_id)")
def dml_11_resolved(t: Tables) -> DataFrame:
    """Flags after resolutions."""
    return _settled(t)[0]


@_R.add(f", {_ASKS} SELECT pos, CASE WHEN flag_id IS NULL OR resolution IS NULL OR resolution = 'maybe' THEN 400 WHEN flag_id NOT IN (SELECT claim_id || '-' || rule FROM flags) THEN 404 ELSE 200 END AS answer FROM asks")
def dml_11_answers(t: Tables) -> DataFrame:
    """What those who resolve flags are answered."""
    return _settled(t)[1]


@_R.add("""WITH c AS (SELECT p_partkey AS claim_id, p_partkey % 4 AS level, 'About ' || p_type AS a, 'About ' || p_type || ' ' || p_brand AS b, 'About ' || p_type || ' ' || p_brand || ' ' || p_size AS c FROM part)
SELECT claim_id, a AS name, 1 AS round FROM c WHERE level = 0
UNION ALL SELECT claim_id, b, 2 FROM c WHERE level = 1 AND a IN (SELECT a FROM c WHERE level = 0)
UNION ALL SELECT claim_id, c, 3 FROM c WHERE level = 2 AND b IN (SELECT b FROM c WHERE level = 1 AND a IN (SELECT a FROM c WHERE level = 0))""", model=False)
def stm_10_refiled(t: Tables) -> DataFrame:
    """Claims filed round by round: each round opens the topics that the next one's ask for as parents; claims under unknown parents stay out."""
    level = F.col("p_partkey") % 4
    a = F.concat_ws(" ", F.lit("About"), "p_type")
    b, c = F.concat_ws(" ", a, "p_brand"), F.concat_ws(" ", a, "p_brand", "p_size")
    tag = F.when(level == 0, a).when(level == 1, b).when(level == 2, c).otherwise(F.concat(F.lit("Lone "), "p_partkey"))
    parent = F.when(level == 0, "ASIA").when(level == 1, a).when(level == 2, b).otherwise("nowhere")
    tags = t.raw("part").select(F.col("p_partkey").alias("claim_id"), tag.alias("tag"), parent.alias("parent"), F.lit(1).alias("pos"))
    filed, topics, _ = refile(tags, t.topics)
    return filed.join(topics.select("topic_id", "name"), "topic_id").select("claim_id", "name", "round")
