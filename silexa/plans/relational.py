"""Scans, filters, joins, aggregates and windows of the read side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silexa.operators import claims as C
from silexa.operators import tree
from silexa.session import spread, tasks_for
from silexa.sources.tables import Tables

from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
VISIBLE = 10


@_R.add("SELECT insight_id, source_id FROM insights")
def scan_01_projection(t: Tables) -> DataFrame:
    """Two columns of the insights."""
    return t.insights.select("insight_id", "source_id")


@_R.add("SELECT event_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-15 00:00:00', 5000)", model=False)
def scan_03_keyset(t: Tables) -> DataFrame:
    """Rows strictly behind a (time, id) checkpoint."""
    at = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return t.raw("events").filter((F.col("ts") > at) | ((F.col("ts") == at) & (F.col("event_id") > 5000))).select("event_id", "ts")


@_R.add("SELECT CAST(count(*) AS BIGINT) AS all_claims, CAST(count(*) FILTER (status = 'active') AS BIGINT) AS active, CAST(count(*) FILTER (importance IS NULL) AS BIGINT) AS unrated FROM claims")
def scan_04_counts(t: Tables) -> DataFrame:
    """Several counts in one pass."""
    return t.claims.agg(F.count(F.lit(1)).alias("all_claims"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("importance").isNull()).alias("unrated"))


@_R.add("SELECT claim_id, statement FROM claims WHERE evidence = 'RCT' AND importance IN (2, 3) AND actionability <> 'Low' AND (audience = 'Both' OR audience = 'Patient')")
def fil_01_facets(t: Tables) -> DataFrame:
    """Conjunction of facets and the audience predicate."""
    return t.claims.filter((F.col("evidence") == "RCT") & F.col("importance").isin(2, 3) & (F.col("actionability") != "Low") & C.for_audience(F.col("audience"), "patient")).select("claim_id", "statement")


@_R.add("SELECT claim_id, statement FROM claims WHERE statement ILIKE '%red%' OR evidence ILIKE '%red%' OR actionability ILIKE '%red%'")
def fil_02_substring(t: Tables) -> DataFrame:
    """A pattern in any of three text columns, any case."""
    return t.claims.filter(F.col("statement").ilike("%red%") | F.col("evidence").ilike("%red%") | F.col("actionability").ilike("%red%")).select("claim_id", "statement")


@_R.add(f"SELECT root_id AS topic_id, CAST(count(DISTINCT claim_id) AS BIGINT) AS n FROM closure JOIN filings USING (topic_id) JOIN topics r ON r.topic_id = root_id WHERE NOT r.is_hidden GROUP BY 1 HAVING count(DISTINCT claim_id) >= {VISIBLE}")
def fil_11_visible_topics(t: Tables) -> DataFrame:
    """Topics that are not hidden and have enough claims in their subtree."""
    shown = t.topics.filter(~F.col("is_hidden")).select(F.col("topic_id").alias("root_id"))
    rows = tree.closure(t.topics).join(shown, "root_id", "left_semi").join(t.filings, "topic_id").select("root_id", "claim_id")
    # A claim is counted once a root before the roots, of which there are few, meet.
    pairs = spread(rows, tasks_for(t.raw("lineitem")), "root_id", "claim_id").distinct()
    return pairs.groupBy(F.col("root_id").alias("topic_id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= VISIBLE)


@_R.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') = '69'", model=False)
def fil_07_json_path(t: Tables) -> DataFrame:
    """Equality at a path of a JSON column."""
    k = F.get_json_object("props", "$.k")
    return t.raw("events").filter(k == "69").select("event_id", k.cast("long").alias("k"))


@_R.add("""SELECT claim_id, CASE WHEN evidence IN ('MetaAnalysis', 'RCT', 'Cohort', 'CaseSeries', 'Mechanistic', 'Animal', 'ExpertOpinion') THEN evidence ELSE 'Other' END AS evidence,
 CASE WHEN importance = 1 OR importance = 3 THEN importance ELSE 2 END AS importance, CASE lower(actionability) WHEN 'high' THEN 'High' WHEN 'low' THEN 'Low' WHEN 'background' THEN 'Background' ELSE 'Medium' END AS actionability,
 CASE lower(audience) WHEN 'patient' THEN 'Patient' WHEN 'clinician' THEN 'Clinician' ELSE 'Both' END AS audience FROM claims""")
def prj_01_coerce(t: Tables) -> DataFrame:
    """Facets outside their domain fall back to its default."""
    grade, level, reader = F.col("evidence"), F.lower("actionability"), F.lower("audience")
    return t.claims.select(
        "claim_id", F.when(grade.isin(*C.EVIDENCE_RANK), grade).otherwise("Other").alias("evidence"), F.when(F.col("importance").isin(1, 3), F.col("importance")).otherwise(2).alias("importance"),
        F.when(level.isin("high", "low", "background"), F.initcap(level)).otherwise("Medium").alias("actionability"), F.when(reader.isin("patient", "clinician"), F.initcap(reader)).otherwise("Both").alias("audience"),
    )


@_R.add("SELECT s.source_id, title, coalesce(n, 0) AS n FROM sources s LEFT JOIN (SELECT source_id, CAST(count(*) AS BIGINT) AS n FROM insights GROUP BY 1) USING (source_id)")
def join_03_source_counts(t: Tables) -> DataFrame:
    """Every source with the number of its insights, 0 included."""
    return t.sources.join(t.insights.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")), "source_id", "left").select("source_id", "title", F.coalesce("n", F.lit(0)).alias("n"))


@_R.add("SELECT insight_id, source_id FROM insights i WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.insight_id = i.insight_id)")
def join_13_unconsolidated(t: Tables) -> DataFrame:
    """Insights that belong to no claim."""
    return t.insights.join(t.members, "insight_id", "left_anti").select("insight_id", "source_id")


@_R.add("SELECT claim_id FROM claims WHERE status = 'active' AND claim_id NOT IN (SELECT claim_id FROM filings WHERE filed_at < TIMESTAMP '1995-03-01 00:00:00')")
def join_14_orphans(t: Tables) -> DataFrame:
    """Active claims that had no topic at a date."""
    filed = t.filings.filter(F.col("filed_at") < F.lit("1995-03-01 00:00:00").cast("timestamp"))
    return t.claims.filter("status = 'active'").join(filed, "claim_id", "left_anti").select("claim_id")


@_R.add("""SELECT DISTINCT i.insight_id FROM members i WHERE i.claim_id IN (SELECT claim_id FROM filings JOIN closure USING (topic_id) WHERE root_id = 'R1')""")
def join_17_topic_filter(t: Tables) -> DataFrame:
    """Insights of the claims under a topic, two semi-joins."""
    nodes = tree.closure(t.topics, t.topics.filter("topic_id = 'R1'")).select("topic_id")
    return t.members.join(t.filings.join(nodes, "topic_id", "left_semi"), "claim_id", "left_semi").select("insight_id")


@_R.add("SELECT claim_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY filed_at, topic_id) AS n FROM filings) WHERE n = 1")
def join_18_first_topic(t: Tables) -> DataFrame:
    """One topic for each claim: the first filed."""
    return t.filings.groupBy("claim_id").agg(F.min(F.struct("filed_at", "topic_id")).alias("f")).select("claim_id", "f.topic_id")


@_R.add("""SELECT r.claim_id, CASE WHEN c.status = 'active' THEN r.at_id END AS target_id, r.hops FROM redirects r JOIN claims c ON c.claim_id = r.at_id WHERE c.merged_into IS NULL""")
def join_20_redirects(t: Tables) -> DataFrame:
    """Where each claim's chain of merges ends."""
    return tree.resolve_redirects(t.claims)


@_R.add("""SELECT c.claim_id, CAST(count(m.claim_id) AS BIGINT) AS member_count, CAST(count(DISTINCT m.source_id) AS BIGINT) AS source_count, max(m.importance) AS max_importance,
 coalesce(arg_max(m.evidence, CASE m.evidence WHEN 'MetaAnalysis' THEN 8 WHEN 'RCT' THEN 7 WHEN 'Cohort' THEN 6 WHEN 'CaseSeries' THEN 5 WHEN 'Mechanistic' THEN 4 WHEN 'Animal' THEN 3 WHEN 'ExpertOpinion' THEN 2 ELSE 1 END), 'Other') AS best_evidence,
 CASE WHEN count(m.claim_id) = 0 THEN 'retired' ELSE any_value(c.status) END AS status FROM claims c LEFT JOIN members m USING (claim_id) GROUP BY 1""")
def agg_01_claim_rollup(t: Tables) -> DataFrame:
    """Counts, greatest importance and best evidence of each claim's members."""
    return C.rollup(t.claims, t.members)


@_R.add("SELECT t.topic_id, CAST(count(c.claim_id) AS BIGINT) AS claim_count FROM topics t LEFT JOIN filings f USING (topic_id) LEFT JOIN claims c ON c.claim_id = f.claim_id AND c.status = 'active' GROUP BY 1")
def agg_07_topic_counts(t: Tables) -> DataFrame:
    """Active claims filed directly under each topic, 0 included."""
    per = t.filings.join(t.claims.filter("status = 'active'"), "claim_id", "left_semi").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    return t.topics.join(per, "topic_id", "left").select("topic_id", F.coalesce("n", F.lit(0)).alias("claim_count"))


@_R.add("SELECT root_id AS topic_id, CAST(count(f.claim_id) AS BIGINT) AS total, CAST(count(DISTINCT f.claim_id) AS BIGINT) AS claims FROM closure LEFT JOIN filings f USING (topic_id) GROUP BY 1")
def agg_08_subtree_totals(t: Tables) -> DataFrame:
    """Filings summed over each subtree, and distinct claims."""
    return tree.closure(t.topics).join(t.filings, "topic_id", "left").groupBy(F.col("root_id").alias("topic_id")).agg(F.count("claim_id").alias("total"), F.count_distinct("claim_id").alias("claims"))


@_R.add("SELECT status || ':' || kind AS bucket, CAST(count(*) AS BIGINT) AS n FROM jobs GROUP BY 1")
def agg_12_histogram(t: Tables) -> DataFrame:
    """Jobs by state and kind."""
    return t.jobs.groupBy(F.concat_ws(":", "status", "kind").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_R.add("""SELECT source_id, CAST(count(*) AS BIGINT) AS total, CAST(count(located_at) AS BIGINT) AS located, floor(100.0 * count(located_at) / count(*) + 0.5)::BIGINT AS pct FROM insights GROUP BY ROLLUP (source_id)""")
def agg_14_provenance(t: Tables) -> DataFrame:
    """Located quotes by source and in all."""
    return t.insights.rollup("source_id").agg(F.count(F.lit(1)).alias("total"), F.count("located_at").alias("located"), F.floor(F.lit(100.0) * F.count("located_at") / F.count(F.lit(1)) + 0.5).alias("pct"))


@_R.add("SELECT member_count, CAST(count(*) AS BIGINT) AS n FROM (SELECT claim_id, CAST(count(*) AS BIGINT) AS member_count FROM members GROUP BY 1) GROUP BY 1")
def agg_23_sizes(t: Tables) -> DataFrame:
    """How many claims have how many members."""
    return t.members.groupBy("claim_id").agg(F.count(F.lit(1)).alias("member_count")).groupBy("member_count").agg(F.count(F.lit(1)).alias("n"))


@_R.add("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1", model=False)
def win_01_latest(t: Tables) -> DataFrame:
    """Latest version for each pair of keys."""
    order = Window.partitionBy("user_id", "event_type").orderBy(F.col("ts").desc(), "event_id")
    return t.raw("events").withColumn("n", F.row_number().over(order)).filter("n = 1").select("user_id", "event_id", "ts")


@_R.add("SELECT claim_id, located_at, insight_id FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY insight_id) AS n FROM members WHERE located_at IS NOT NULL) WHERE n = 1")
def win_03_first_quote(t: Tables) -> DataFrame:
    """The first located quote of each claim."""
    return t.members.filter("located_at IS NOT NULL").groupBy("claim_id").agg(F.min(F.struct("insight_id", "located_at")).alias("f")).select("claim_id", "f.located_at", "f.insight_id")


@_R.add("""WITH spans AS (SELECT l_orderkey AS k, CAST(l_linenumber * 10 + l_suppkey % 5 AS BIGINT) AS a, CAST(l_linenumber * 10 + l_suppkey % 5 + l_quantity AS BIGINT) AS b FROM lineitem),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM spans),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT k, min(a) AS start_at, max(b) AS end_at FROM numbered GROUP BY k, island""", model=False)
def win_07_merge_spans(t: Tables) -> DataFrame:
    """Overlapping spans of one key merged to islands."""
    a = (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 5).cast("long")
    # As in SQL, ends are rounded (a half to the even neighbour) and nulls come last.
    spans = t.raw("lineitem").select(F.col("l_orderkey").alias("k"), a.alias("a"), F.rint(a + F.col("l_quantity")).cast("long").alias("b"))
    order = Window.partitionBy("k").orderBy(F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last())
    new = F.when(F.col("a") <= F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("new", new).withColumn("island", island).groupBy("k", "island").agg(F.min("a").alias("start_at"), F.max("b").alias("end_at")).drop("island")


@_R.add("""SELECT source_id, insight_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY created_at, insight_id) AS n, count(*) OVER (PARTITION BY source_id) AS total FROM insights)
 WHERE (n - 1) % greatest(1, total // 5) = 0 AND (n - 1) // greatest(1, total // 5) < 5""")
def win_08_strided(t: Tables) -> DataFrame:
    """Five insights of each source at even strides."""
    own = Window.partitionBy("source_id")
    rows = t.insights.withColumn("n", F.row_number().over(own.orderBy("created_at", "insight_id")) - 1).withColumn("stride", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(own) / 5)))
    return rows.filter((F.col("n") % F.col("stride") == 0) & (F.floor(F.col("n") / F.col("stride")) < 5)).select("source_id", "insight_id")


@_R.add("SELECT job_id, kind, created_at FROM jobs WHERE status = 'queued' ORDER BY CASE WHEN kind = 'consolidate' THEN 0 ELSE 1 END, created_at, job_id LIMIT 50")
def sort_05_queue(t: Tables) -> DataFrame:
    """The next jobs: consolidation first, then by age."""
    return t.jobs.filter("status = 'queued'").orderBy(F.when(F.col("kind") == "consolidate", 0).otherwise(1), "created_at", "job_id").select("job_id", "kind", "created_at").limit(50)


@_R.add("""SELECT parent_id, topic_id, n, rank FROM (SELECT t.parent_id, t.topic_id, count(f.claim_id)::BIGINT AS n, row_number() OVER (PARTITION BY t.parent_id ORDER BY count(f.claim_id) DESC, t.topic_id)::BIGINT AS rank
 FROM topics t LEFT JOIN filings f USING (topic_id) WHERE t.parent_id IS NOT NULL GROUP BY 1, 2) WHERE rank <= 6""")
def lim_03_top_children(t: Tables) -> DataFrame:
    """The six largest children of each topic."""
    per = t.filings.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    rows = t.topics.filter("parent_id IS NOT NULL").join(per, "topic_id", "left").select("parent_id", "topic_id", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("parent_id").orderBy(F.col("n").desc(), "topic_id")).cast("long")).filter("rank <= 6")
