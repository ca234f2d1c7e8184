"""Scores, rollups, merge algebra and reports over claims; grouped once by their key, joined by it, ties broken by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silexa.session import spread, tasks_for

#: Points of the composite score and ranks of the rollup (fixed values).
ACTIONABILITY_POINTS = {"High": 15, "Low": 5}
EVIDENCE_POINTS = {"MetaAnalysis": 15, "RCT": 12, "Cohort": 9, "CaseSeries": 6, "ExpertOpinion": 0}
EVIDENCE_RANK = {"MetaAnalysis": 8, "RCT": 7, "Cohort": 6, "CaseSeries": 5, "Mechanistic": 4, "Animal": 3, "ExpertOpinion": 2, "Other": 1}
YEAR = 31557600


def cases(c: Column, values: dict[str, int], other: int) -> Column:
    out = F.when(F.lit(False), 0)
    for k, v in values.items():
        out = out.when(c == k, v)
    return out.otherwise(other)


def recency_bonus(date: Column, as_of: str) -> Column:
    """8 points that lose 1.5 a year; 0 without a date."""
    years = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(date)) / YEAR
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(8.0) - years * 1.5), F.lit(0.0))


def for_audience(c: Column, audience: str | None) -> Column:
    """None means any; any name but 'patient' means clinicians."""
    return F.lit(True) if audience is None else c.isin("Both", "Patient" if audience == "patient" else "Clinician")


def best_evidence(evidence: Column) -> Column:
    """The grade of highest rank in a group; Other where there is none."""
    return F.coalesce(F.max_by(evidence, cases(evidence, EVIDENCE_RANK, 0)), F.lit("Other"))


def rollup(claims: DataFrame, members: DataFrame) -> DataFrame:
    """Members, distinct sources, greatest importance and best evidence of every claim; a claim without members is to be retired."""
    per = members.groupBy("claim_id").agg(F.count(F.lit(1)).alias("member_count"), F.count_distinct("source_id").alias("source_count"), F.max("importance").alias("max_importance"), best_evidence(F.col("evidence")).alias("best_evidence"))
    out = claims.select("claim_id", "status").join(per, "claim_id", "left")
    return out.select("claim_id", F.coalesce("member_count", F.lit(0)).alias("member_count"), F.coalesce("source_count", F.lit(0)).alias("source_count"), "max_importance", F.coalesce("best_evidence", F.lit("Other")).alias("best_evidence"), F.when(F.col("member_count").isNull(), "retired").otherwise(F.col("status")).alias("status"))


def scored(claims: DataFrame, members: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """Composite score of every claim; members meet their sources in one pre-aggregated join, in as many tasks as their number asks for."""
    members = members.select("claim_id", "source_id")
    n = tasks_for(members)
    # Both sides are dealt: a side that is partitioned already would draw the other one to its own, smaller number of tasks.
    dated = spread(members, n, "source_id").join(spread(sources.select("source_id", "date"), n, "source_id"), "source_id", "left")
    per = spread(dated, n, "claim_id").groupBy("claim_id").agg(F.count_distinct("source_id").alias("source_count"), F.max("date").alias("newest"))
    rows = claims.join(per, "claim_id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))
    points = F.coalesce("importance", F.lit(2)) * 10 + cases(F.col("actionability"), ACTIONABILITY_POINTS, 10) + cases(F.col("evidence"), EVIDENCE_POINTS, 3) + F.least("source_count", F.lit(5)) * 2
    return rows.withColumn("score", F.round(points + recency_bonus(F.col("newest"), as_of), 6))


def topic_claims(topic_id: str, closure: DataFrame, topics: DataFrame, filings: DataFrame, claims_scored: DataFrame, audience: str | None = None, limit: int = 250, offset: int = 0) -> DataFrame:
    """Active claims of a topic's active subtree, best first: distinct ids before the join, top-k at the end."""
    root = topics.filter((F.col("topic_id") == topic_id) & (F.col("status") == "active")).select(F.col("topic_id").alias("root_id"))
    ids = closure.join(root, "root_id", "left_semi").join(filings, "topic_id").select("claim_id").distinct()
    rows = claims_scored.filter((F.col("status") == "active") & for_audience(F.col("audience"), audience)).join(ids, "claim_id", "left_semi")
    return rows.select("claim_id", "statement", "source_count", "score").orderBy(F.col("score").desc(), F.col("source_count").desc(), "claim_id").offset(offset).limit(limit)


def near_duplicate_edges(links: DataFrame) -> DataFrame:
    """Each edge once, smaller id first, none from a claim to itself."""
    return links.filter("a <> b").select(F.least("a", "b").alias("claim_id"), F.greatest("a", "b").alias("related_claim_id")).distinct()


def novelty(insights: DataFrame, links: DataFrame) -> DataFrame:
    """Per source and for all (source_id null): insights that are redundant, refine, are new, or wait; shares rounded half up."""
    linked = links.select(F.col("claim_id").alias("claim_id")).union(links.select("related_claim_id")).distinct().withColumn("linked", F.lit(True))
    rows = insights.join(linked, "claim_id", "left")
    kind = F.when(F.col("claim_id").isNull(), "unconsolidated").when(F.col("matched_by") != "seed", "redundant").when(F.col("linked"), "refinement").otherwise("novel")
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("redundant", "refinement", "novel", "unconsolidated")]
    out = rows.select("source_id", kind.alias("kind")).rollup("source_id").agg(F.count(F.lit(1)).alias("total"), *counts)
    return out.withColumn("novel_pct", F.floor(F.lit(100.0) * F.col("novel") / F.col("total") + 0.5))


def merge_claims(members: DataFrame, redirects: DataFrame) -> DataFrame:
    """Members on the claim that their own claim leads to; of one insight's memberships the winner's own row stays, others count as human."""
    rows = members.join(redirects.select("claim_id", "target_id"), "claim_id", "left").filter(F.col("target_id").isNotNull())
    moved = F.col("claim_id") != F.col("target_id")
    rows = rows.select(F.col("target_id").alias("claim_id"), "insight_id", F.when(moved, "human").otherwise(F.col("matched_by")).alias("matched_by"), moved.alias("moved"))
    first = Window.partitionBy("claim_id", "insight_id").orderBy("moved")
    return rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def merge_filings(filings: DataFrame, redirects: DataFrame) -> DataFrame:
    """Filings on the claim that their own claim leads to; where the winner is filed under a topic already, its own row stays."""
    rows = filings.join(redirects.select("claim_id", "target_id"), "claim_id").filter(F.col("target_id").isNotNull())
    moved = F.col("claim_id") != F.col("target_id")
    first = rows.groupBy(F.col("target_id").alias("claim_id"), "topic_id").agg(F.min(F.struct(moved.alias("moved"), "filed_at")).alias("r"))
    return first.select("claim_id", "topic_id", "r.filed_at", "r.moved")


def merged_claims(claims: DataFrame, redirects: DataFrame, members: DataFrame) -> DataFrame:
    """Claims after the merges: losers point to the claim at the end of their chain and count nothing, winners count what they have got."""
    per = merge_claims(members, redirects).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    rows = claims.select("claim_id", "status").join(redirects.select("claim_id", "target_id"), "claim_id").join(per, "claim_id", "left")
    gone = F.col("claim_id") != F.col("target_id")
    return rows.select("claim_id", F.when(gone, "merged").otherwise(F.col("status")).alias("status"), F.when(gone, F.col("target_id")).alias("merged_into"), F.when(gone, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("member_count"))


def stale_topics(closure: DataFrame, filings: DataFrame, claims: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Topics with claims filed in their subtree after their snapshot, and how many distinct ones."""
    active = claims.filter("status = 'active'").select("claim_id")
    of_root = snapshots.select(F.col("topic_id").alias("root_id"), "snapshot_at")
    new = closure.join(of_root, "root_id").join(filings, "topic_id").filter(F.col("filed_at") > F.col("snapshot_at")).join(active, "claim_id", "left_semi")
    return new.groupBy(F.col("root_id").alias("topic_id")).agg(F.count_distinct("claim_id").alias("new_claims"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of two raters (columns a, b) over any classes; 1 where chance agreement is 1."""
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    po, pe = F.col("same") / F.col("total"), F.col("xy") / (F.col("total") * F.col("total"))
    value = F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (F.lit(1.0) - pe))
    # One row each.
    return total.join(F.broadcast(chance)).select(F.col("total").alias("n"), F.round(po, 6).alias("agreement"), F.round(value, 6).alias("kappa"))


def until_first_wrong(verdicts: DataFrame) -> DataFrame:
    """Verdicts (item, confidence, human) above the most confident one that a person denies: its place is found first, so no window over all rows is needed."""
    worst = verdicts.filter("human <> 'SAME'").agg(F.max(F.struct("confidence", (-F.col("item")).alias("n"))).alias("w"))
    # One row.
    rows = verdicts.join(F.broadcast(worst))
    return rows.filter(F.col("w").isNull() | (F.col("confidence") > F.col("w.confidence")) | ((F.col("confidence") == F.col("w.confidence")) & (F.col("item") < -F.col("w.n")))).drop("w")
