"""Ranked evidence, novelty, staleness, agreement, merges and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silexa.operators import claims as C
from silexa.operators import tree, vector
from silexa.sources.tables import Tables

from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
AS_OF = "2002-01-01"
ROOT = "R1"

_SCORED = f"""per AS (SELECT claim_id, CAST(count(DISTINCT source_id) AS BIGINT) AS source_count, max(date) AS newest FROM members LEFT JOIN sources USING (source_id) GROUP BY 1),
scored AS (SELECT c.*, coalesce(source_count, 0) AS source_count,
  round(coalesce(importance, 2) * 10 + CASE actionability WHEN 'High' THEN 15 WHEN 'Low' THEN 5 ELSE 10 END
  + CASE evidence WHEN 'MetaAnalysis' THEN 15 WHEN 'RCT' THEN 12 WHEN 'Cohort' THEN 9 WHEN 'CaseSeries' THEN 6 WHEN 'ExpertOpinion' THEN 0 ELSE 3 END
  + least(coalesce(source_count, 0), 5) * 2 + coalesce(greatest(CAST(0 AS DOUBLE), CAST(8 AS DOUBLE) - (epoch(TIMESTAMP '{AS_OF} 00:00:00') - epoch(newest)) / {C.YEAR} * CAST(1.5 AS DOUBLE)), CAST(0 AS DOUBLE)), 6) AS score
  FROM claims c LEFT JOIN per USING (claim_id))"""


@_R.add("SELECT c.topic_id, c.depth FROM closure c JOIN topics r ON r.topic_id = c.root_id WHERE c.root_id = 'R1' AND r.status = 'active'")
def rec_01_subtree(t: Tables) -> DataFrame:
    """Active topics under a root, with their depth."""
    return tree.closure(t.topics, t.topics.filter(F.col("topic_id") == ROOT).filter("status = 'active'")).select("topic_id", "depth")


@_R.add(f""", {_SCORED}
SELECT claim_id, statement, source_count, score FROM scored
WHERE status = 'active' AND (audience = 'Both' OR audience = 'Clinician') AND claim_id IN (SELECT claim_id FROM filings JOIN closure USING (topic_id) WHERE root_id = '{ROOT}')
ORDER BY score DESC, source_count DESC, claim_id LIMIT 250""")
def rec_03_topic_claims(t: Tables) -> DataFrame:
    """The ranked evidence of a topic's subtree (flagship)."""
    scores = C.scored(t.claims, t.members, t.sources, AS_OF)
    return C.topic_claims(ROOT, tree.closure(t.topics, t.topics.filter(F.col("topic_id") == ROOT)), t.topics, t.filings, scores, audience="clinician")


@_R.add("SELECT topic_id, max(depth) + 1 AS depth, max(depth) >= 3 AS too_deep FROM closure WHERE root_id LIKE 'R%' GROUP BY 1")
def rec_06_depths(t: Tables) -> DataFrame:
    """Depth of every topic under a root, which counts as 1."""
    rows = tree.closure(t.topics).filter(F.startswith("root_id", F.lit("R"))).groupBy("topic_id").agg(F.max("depth").alias("d"))
    return rows.select("topic_id", (F.col("d") + 1).alias("depth"), (F.col("d") >= 3).alias("too_deep"))


@_R.add("SELECT DISTINCT least(a, b) AS claim_id, greatest(a, b) AS related_claim_id FROM links WHERE a <> b")
def ded_07_links(t: Tables) -> DataFrame:
    """Near-duplicate edges, each once."""
    return C.near_duplicate_edges(t.links)


@_R.add(""", edges AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM links WHERE a <> b), linked AS (SELECT a AS claim_id FROM edges UNION SELECT b FROM edges),
kinds AS (SELECT source_id, CASE WHEN i.claim_id IS NULL THEN 'unconsolidated' WHEN matched_by <> 'seed' THEN 'redundant' WHEN l.claim_id IS NOT NULL THEN 'refinement' ELSE 'novel' END AS kind FROM insights i LEFT JOIN linked l USING (claim_id))
SELECT source_id, count(*)::BIGINT AS total, (count(*) FILTER (kind = 'redundant'))::BIGINT AS redundant, (count(*) FILTER (kind = 'refinement'))::BIGINT AS refinement, (count(*) FILTER (kind = 'novel'))::BIGINT AS novel,
 (count(*) FILTER (kind = 'unconsolidated'))::BIGINT AS unconsolidated, floor(CAST(100 AS DOUBLE) * (count(*) FILTER (kind = 'novel')) / count(*) + 0.5)::BIGINT AS novel_pct FROM kinds GROUP BY ROLLUP (source_id)""")
def agg_09_novelty(t: Tables) -> DataFrame:
    """What each source adds, and all of them together."""
    return C.novelty(t.insights, C.near_duplicate_edges(t.links))


_KAPPA = """, r AS (SELECT {0} AS a, {1} AS b FROM rulings WHERE judge IS NOT NULL), t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum((a = b)::INT) AS DOUBLE) AS same FROM r),
e AS (SELECT sum(x * y) AS xy FROM (SELECT a AS k, CAST(count(*) AS DOUBLE) AS x FROM r GROUP BY 1) JOIN (SELECT b AS k, CAST(count(*) AS DOUBLE) AS y FROM r GROUP BY 1) USING (k))
SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS agreement, round(CASE WHEN coalesce(xy, 0) / (n * n) = 1 THEN 1 ELSE (same / n - coalesce(xy, 0) / (n * n)) / (1 - coalesce(xy, 0) / (n * n)) END, 6) AS kappa FROM t, e"""


@_R.add(_KAPPA.format("human = 'SAME'", "judge = 'SAME'"))
def agg_16_kappa(t: Tables) -> DataFrame:
    """Agreement of person and judge on merging or not, corrected for chance; failed judgements are no verdicts."""
    return C.kappa(t.rulings.filter("judge IS NOT NULL").select((F.col("human") == "SAME").alias("a"), (F.col("judge") == "SAME").alias("b")))


@_R.add(_KAPPA.format("human", "judge"))
def agg_17_kappa_classes(t: Tables) -> DataFrame:
    """The same over all classes of verdict."""
    return C.kappa(t.rulings.filter("judge IS NOT NULL").select(F.col("human").alias("a"), F.col("judge").alias("b")))


_RUN = "v AS (SELECT *, max(CASE WHEN human <> 'SAME' THEN 1 ELSE 0 END) OVER (ORDER BY confidence DESC, item ROWS UNBOUNDED PRECEDING) AS wrong FROM rulings WHERE judge = 'SAME')"


@_R.add(f", {_RUN} SELECT min(confidence) AS cutoff, count(*)::BIGINT AS covered FROM v WHERE wrong = 0")
def agg_19_auto_accept(t: Tables) -> DataFrame:
    """By falling confidence, how far the judge's SAME goes before the first that a person denies."""
    return C.until_first_wrong(t.rulings.filter("judge = 'SAME'")).agg(F.min("confidence").alias("cutoff"), F.count(F.lit(1)).alias("covered"))


@_R.add(f", {_RUN} SELECT item, confidence FROM v WHERE wrong = 0")
def win_05_prefix(t: Tables) -> DataFrame:
    """The verdicts of that run."""
    return C.until_first_wrong(t.rulings.filter("judge = 'SAME'")).select("item", "confidence")


@_R.add(""", ends AS (SELECT r.claim_id, r.at_id AS target_id FROM redirects r JOIN claims c ON c.claim_id = r.at_id WHERE c.merged_into IS NULL AND c.status = 'active')
SELECT target_id AS claim_id, insight_id, CASE WHEN m.claim_id <> target_id THEN 'human' ELSE matched_by END AS matched_by, m.claim_id <> target_id AS moved FROM members m JOIN ends USING (claim_id)""")
def ded_06_merge(t: Tables) -> DataFrame:
    """Members of merged claims on the claim that is left."""
    return C.merge_claims(t.members, tree.resolve_redirects(t.claims))


_ENDS = """, ends AS (SELECT r.claim_id, CASE WHEN c.status = 'active' THEN r.at_id END AS target_id FROM redirects r JOIN claims c ON c.claim_id = r.at_id WHERE c.merged_into IS NULL)"""


@_R.add(_ENDS + """ SELECT target_id AS claim_id, topic_id, arg_min(filed_at, (f.claim_id <> target_id, filed_at)) AS filed_at, min(f.claim_id <> target_id) AS moved FROM filings f JOIN ends USING (claim_id) WHERE target_id IS NOT NULL GROUP BY 1, 2""")
def ded_06_filings(t: Tables) -> DataFrame:
    """Topic filings of merged claims on the claim that is left."""
    return C.merge_filings(t.filings, tree.resolve_redirects(t.claims))


@_R.add(_ENDS + """, per AS (SELECT target_id AS claim_id, count(*) AS n FROM members JOIN ends USING (claim_id) WHERE target_id IS NOT NULL GROUP BY 1)
SELECT c.claim_id, CASE WHEN c.claim_id <> target_id THEN 'merged' ELSE status END AS status, CASE WHEN c.claim_id <> target_id THEN target_id END AS merged_into, CAST(CASE WHEN c.claim_id <> target_id THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS member_count
FROM claims c JOIN ends e ON e.claim_id = c.claim_id LEFT JOIN per ON per.claim_id = c.claim_id""")
def ded_06_claims(t: Tables) -> DataFrame:
    """Claims after the merges, losers pointing to winners."""
    return C.merged_claims(t.claims, tree.resolve_redirects(t.claims), t.members)


@_R.add(""", snapshots AS (SELECT topic_id, TIMESTAMP '1995-06-01 00:00:00' + to_days(CAST(substr(topic_id, 2) AS INTEGER) * 30) AS snapshot_at FROM topics WHERE topic_id NOT LIKE '%-%' AND topic_id LIKE 'N%' AND CAST(substr(topic_id, 2) AS INTEGER) % 5 > 0)
SELECT s.topic_id, count(DISTINCT f.claim_id)::BIGINT AS new_claims FROM snapshots s JOIN closure c ON c.root_id = s.topic_id JOIN filings f ON f.topic_id = c.topic_id AND f.filed_at > s.snapshot_at JOIN claims k ON k.claim_id = f.claim_id AND k.status = 'active' GROUP BY 1""")
def qr_06_stale_topics(t: Tables) -> DataFrame:
    """Topics with claims filed after their snapshot."""
    number = F.substring("topic_id", 2, 9).cast("int")
    nations = t.topics.filter(F.rlike("topic_id", F.lit("^N[0-9]+$"))).filter(number % 5 > 0)
    snapshots = nations.select("topic_id", (F.lit("1995-06-01 00:00:00").cast("timestamp") + F.make_dt_interval(number * 30)).alias("snapshot_at"))
    return C.stale_topics(tree.closure(t.topics), t.filings, t.claims, snapshots)


@_R.add("""SELECT claim_id, member_count FROM (SELECT c.claim_id, CAST(count(m.claim_id) AS BIGINT) AS member_count, c.importance FROM claims c LEFT JOIN members m USING (claim_id) GROUP BY 1, 3) WHERE member_count IS DISTINCT FROM importance * 10""")
def dml_04_recount(t: Tables) -> DataFrame:
    """Claims whose stored count (ten times the importance) is not the true one."""
    counts = C.rollup(t.claims, t.members).select("claim_id", "member_count").join(t.claims.select("claim_id", "importance"), "claim_id")
    return counts.filter(~F.col("member_count").eqNullSafe(F.col("importance") * 10)).select("claim_id", "member_count")


_VECTORS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(d.e, q.e), 6) AS similarity, list_cosine_similarity(d.e, q.e) AS exact FROM v d JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)"""


@_R.add(f"WITH {_VECTORS} SELECT query_id, vec_id, similarity, nth::BIGINT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS nth FROM pairs WHERE exact >= 0.2) WHERE nth <= 8", model=False)
def vec_02_match(t: Tables) -> DataFrame:
    """The nearest vectors of every query (ids divisible by 50) at a threshold."""
    vectors = t.raw("embeddings").select("vec_id", "embedding")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.match(vectors, queries, 0.2, 8)
