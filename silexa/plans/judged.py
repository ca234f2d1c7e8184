"""Processes with a judge: consolidation at once and batch by batch, the sweep of claims, the second look at failed checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silexa.operators import consolidation as K
from silexa.operators.judge import RecordedJudge, ThresholdJudge
from silexa.session import shared_folder
from silexa.sources.tables import Tables
from silexa.streaming import insights

from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

#: The thresholds suit the given vectors, whose nearest pairs are some 0.5 alike.
NEAR, SAME, DIFFER = 0.2, 0.3, 0.25
SWEEP_NEAR, SWEEP_SAME, SWEEP_DIFFER = 0.36, 0.42, 0.39

_PAIRS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
near AS (SELECT * FROM (SELECT a.vec_id AS asked, b.vec_id AS other, round(list_cosine_similarity(a.e, b.e), 6) AS s, list_cosine_similarity(a.e, b.e) AS exact FROM v a JOIN v b ON {on}) WHERE exact >= {near}),
lists AS (SELECT asked, list({{'id': other, 's': s}} ORDER BY s DESC, other) AS ps FROM near GROUP BY 1),
steps AS (SELECT vec_id, ps, row_number() OVER (ORDER BY vec_id) AS i FROM v LEFT JOIN lists ON asked = vec_id)"""

# One insight after another: those that no near claim takes become claims.
_ASSIGNED = f"""WITH RECURSIVE {_PAIRS.format(on="b.vec_id < a.vec_id", near=NEAR)},
walk(i, claims) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT w.i + 1, CASE WHEN len(list_filter(list_filter(coalesce(ps, []), lambda p: list_contains(claims, p.id))[1:5], lambda p: p.s >= {SAME})) > 0 THEN claims ELSE list_append(claims, vec_id) END FROM walk w JOIN steps t ON t.i = w.i + 1),
final AS (SELECT claims FROM walk ORDER BY i DESC LIMIT 1),
best AS (SELECT vec_id, list_filter(coalesce(ps, []), lambda p: list_contains(claims, p.id))[1:5] AS c, list_contains(claims, vec_id) AS leads FROM steps, final)"""


def _vectors(t: Tables) -> DataFrame:
    return t.raw("embeddings").select("vec_id", "embedding")


@_R.add(f"{_ASSIGNED} SELECT vec_id, CASE WHEN leads THEN vec_id ELSE list_filter(c, lambda p: p.s >= {SAME})[1].id END AS claim_id, CASE WHEN leads THEN 'seed' ELSE 'auto' END AS matched_by FROM best", model=False)
def ded_01_consolidate(t: Tables) -> DataFrame:
    """Every vector consolidated in the order of ids: the claim that it joins, or is."""
    return K.consolidate(_vectors(t), NEAR, ThresholdJudge(SAME, DIFFER))[0].select("vec_id", "claim_id", "matched_by")


@_R.add(f"{_ASSIGNED} SELECT least(vec_id, c[1].id) AS claim_id, greatest(vec_id, c[1].id) AS related_claim_id, c[1].s AS similarity, CASE WHEN c[1].s < {DIFFER} THEN 'near_duplicate' ELSE 'review' END AS kind FROM best WHERE leads AND len(c) > 0", model=False)
def ded_01_edges(t: Tables) -> DataFrame:
    """New claims that had a near one: links where the judge keeps them apart, reviews where it is not sure."""
    return K.consolidate(_vectors(t), NEAR, ThresholdJudge(SAME, DIFFER))[1]


@_R.add(f"{_ASSIGNED} SELECT vec_id, CASE WHEN leads THEN vec_id ELSE list_filter(c, lambda p: p.s >= {SAME})[1].id END AS claim_id, CASE WHEN leads THEN 'seed' ELSE 'auto' END AS matched_by FROM best", model=False)
def stm_06_incremental(t: Tables) -> DataFrame:
    """The same as insights arrive in files, of which the stream takes two, stops, and takes the rest."""
    spark, vectors = t.spark, _vectors(t)
    base = f"{shared_folder(spark)}/insights/{uuid.uuid4().hex}"
    cuts = [float("-inf"), *vectors.approxQuantile("vec_id", [0.3, 0.5, 0.8], 0.01), float("inf")]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        vectors.filter((F.col("vec_id") > low) & (F.col("vec_id") <= high)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if n in (1, 3):
            insights.follow(spark, f"{base}/in", f"{base}/out", f"{base}/check", vectors.schema, NEAR, ThresholdJudge(SAME, DIFFER))
    return spark.read.parquet(f"{base}/out/assigned").select("vec_id", "claim_id", "matched_by")


_SWEPT = f"""WITH RECURSIVE {_PAIRS.format(on="b.vec_id <> a.vec_id", near=SWEEP_NEAR)},
walk(i, gone, merges, queued) AS (SELECT 0::BIGINT, []::BIGINT[], []::STRUCT(loser_id BIGINT, winner_id BIGINT)[], []::STRUCT(claim_id BIGINT, candidate_id BIGINT, similarity DOUBLE)[] UNION ALL
  SELECT i, CASE WHEN same IS NULL THEN gone ELSE list_append(gone, same) END, CASE WHEN same IS NULL THEN merges ELSE list_append(merges, {{'loser_id': same, 'winner_id': vec_id}}) END,
    CASE WHEN same IS NULL AND len(c) > 0 AND c[1].s >= {SWEEP_DIFFER} AND len(list_filter(queued, lambda q: q.claim_id = vec_id AND q.candidate_id = c[1].id)) = 0 THEN list_append(queued, {{'claim_id': c[1].id, 'candidate_id': vec_id, 'similarity': c[1].s}}) ELSE queued END
  FROM (SELECT *, list_filter(c, lambda p: p.s >= {SWEEP_SAME})[1].id AS same FROM (SELECT t.i, gone, merges, queued, vec_id, CASE WHEN list_contains(gone, vec_id) THEN [] ELSE list_filter(coalesce(ps, []), lambda p: NOT list_contains(gone, p.id))[1:5] END AS c FROM walk w JOIN steps t ON t.i = w.i + 1))),
final AS (SELECT * FROM walk ORDER BY i DESC LIMIT 1)"""


def _swept(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two passes, the second from where the first has stopped, on the claims that it has left."""
    claims, judge = _vectors(t).select(F.col("vec_id").alias("claim_id"), F.lit(0).alias("created_at"), "embedding"), ThresholdJudge(SWEEP_SAME, SWEEP_DIFFER)
    merges, reviews, cursor = K.sweep(claims, SWEEP_NEAR, judge, most=100)
    left = claims.join(merges.select(F.col("loser_id").alias("claim_id")), "claim_id", "left_anti")
    more, queued, _ = K.sweep(left, SWEEP_NEAR, judge, reviews, after=cursor)
    return merges.union(more), reviews.union(queued)


@_R.add(f"{_SWEPT} SELECT m.loser_id, m.winner_id FROM (SELECT unnest(merges) AS m FROM final)", model=False)
def ded_03_sweep(t: Tables) -> DataFrame:
    """Claims that a sweep merges, oldest first, over two ticks."""
    return _swept(t)[0]


@_R.add(f"{_SWEPT} SELECT q.claim_id, q.candidate_id, q.similarity FROM (SELECT unnest(queued) AS q FROM final)", model=False)
def ded_03_reviews(t: Tables) -> DataFrame:
    """Pairs that the sweep queues, each once in either direction."""
    return _swept(t)[1]


_LOOK = """, ends AS (SELECT r.claim_id, r.at_id AS target_id FROM redirects r JOIN claims c ON c.claim_id = r.at_id WHERE c.merged_into IS NULL AND c.status = 'active' AND hops <= 4),
looked AS (SELECT r.review_id, r.similarity, a.target_id AS a, b.target_id AS b, CASE WHEN a.target_id IS NULL OR b.target_id IS NULL THEN 'skipped' WHEN a.target_id = b.target_id THEN 'already merged' WHEN k.verdict IS NULL THEN 'failed' WHEN k.verdict = 'SAME' AND k.confidence >= 0.8 THEN 'merged' WHEN k.verdict = 'DIFFERENT' THEN 'rejected' ELSE 'genuine' END AS outcome
 FROM reviews r LEFT JOIN ends a ON a.claim_id = r.claim_id LEFT JOIN ends b ON b.claim_id = r.candidate_id LEFT JOIN reviews k ON k.claim_id = a.target_id AND k.candidate_id = b.target_id WHERE r.status = 'pending')"""


def _looked(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending reviews judged once more by the answers on record; pairs that have come to other claims meanwhile have none."""
    answers = t.reviews.select(F.col("claim_id").alias("asked_id"), "candidate_id", "verdict", "confidence")
    rows = t.reviews.filter("status = 'pending'").select("review_id", "claim_id", "candidate_id", "similarity", F.col("review_id").alias("created_at"))
    return K.second_look(rows, t.claims, RecordedJudge(answers))


@_R.add(f"{_LOOK} SELECT review_id, outcome, CASE WHEN outcome IN ('merged', 'already merged') THEN 'accepted' WHEN outcome = 'rejected' THEN 'rejected' ELSE 'pending' END AS status FROM looked")
def ded_09_second_look(t: Tables) -> DataFrame:
    """What becomes of reviews whose check failed, when they are judged again."""
    return _looked(t)[0]


@_R.add(f"{_LOOK} SELECT c.claim_id, CASE WHEN l.a IS NULL THEN c.status ELSE 'merged' END AS status, coalesce(l.b, c.merged_into) AS merged_into FROM claims c LEFT JOIN (SELECT a, b FROM looked WHERE outcome = 'merged') l ON l.a = c.claim_id")
def ded_09_claims(t: Tables) -> DataFrame:
    """Claims after the merges of the second look."""
    return K.merged(t.claims.select("claim_id", "status", "merged_into"), _looked(t)[1])
