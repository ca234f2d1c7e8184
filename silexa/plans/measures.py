"""Aggregates, windows, orders, limits, scores and vector searches over the evidence model, second part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silexa.operators import claims as C
from silexa.operators import ranks, tree, vector
from silexa.session import spread, tasks_for
from silexa.sources.tables import Tables
from silexa.streaming import backlog

from .evidence import _SCORED, AS_OF
from .facets import NOW
from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
_RANK = "CASE evidence WHEN 'MetaAnalysis' THEN 8 WHEN 'RCT' THEN 7 WHEN 'Cohort' THEN 6 WHEN 'CaseSeries' THEN 5 WHEN 'Mechanistic' THEN 4 WHEN 'Animal' THEN 3 WHEN 'ExpertOpinion' THEN 2 ELSE 1 END"


def rounded_share(part: Column, whole: Column) -> Column:
    """Per cent, half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(F.lit(100.0) * part / whole + 0.5)).otherwise(F.lit(0)).cast("long")


@_R.add(f"SELECT evidence, {_RANK}::INTEGER AS rank, count(*)::BIGINT AS n FROM insights GROUP BY 1")
def agg_02_ranks(t: Tables) -> DataFrame:
    """Insights by grade, with the grade's rank."""
    return t.insights.groupBy("evidence").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", C.cases(F.col("evidence"), C.EVIDENCE_RANK, 1))


@_R.add("""SELECT * FROM (SELECT c.claim_id, count(m.claim_id)::BIGINT AS member_count, count(DISTINCT m.source_id)::BIGINT AS source_count FROM claims c LEFT JOIN members m USING (claim_id) GROUP BY 1) WHERE member_count IS DISTINCT FROM 30 - claim_id % 3 OR source_count IS DISTINCT FROM 10""")
def agg_03_changed_counts(t: Tables) -> DataFrame:
    """Claims whose two stored counts (here by a rule) are not the true ones."""
    rows = C.rollup(t.claims, t.members)
    return rows.filter(~F.col("member_count").eqNullSafe(30 - F.col("claim_id") % 3) | ~F.col("source_count").eqNullSafe(10)).select("claim_id", "member_count", "source_count")


@_R.add("SELECT source_id, count(*)::BIGINT AS n FROM insights GROUP BY 1")
def agg_04_per_source(t: Tables) -> DataFrame:
    """Insights of each source."""
    return t.insights.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@_R.add("SELECT root_id AS topic_id, count(DISTINCT claim_id)::BIGINT AS claims FROM closure JOIN filings USING (topic_id) WHERE root_id LIKE 'R%' GROUP BY 1")
def agg_05_subtree_claims(t: Tables) -> DataFrame:
    """Distinct claims under each root."""
    nodes = tree.closure(t.topics, t.topics.filter("parent_id IS NULL"))
    return nodes.join(t.filings, "topic_id").groupBy(F.col("root_id").alias("topic_id")).agg(F.count_distinct("claim_id").alias("claims"))


@_R.add("SELECT f.topic_id, count(DISTINCT f.claim_id)::BIGINT AS n FROM filings f JOIN (SELECT topic_id, max(snapshot_at) AS at FROM articles GROUP BY 1) s USING (topic_id) WHERE f.filed_at > s.at GROUP BY 1")
def agg_06_new_claims(t: Tables) -> DataFrame:
    """Claims filed directly under a topic since its last snapshot."""
    at = t.articles.groupBy("topic_id").agg(F.max("snapshot_at").alias("at"))
    return t.filings.join(at, "topic_id").filter(F.col("filed_at") > F.col("at")).groupBy("topic_id").agg(F.count_distinct("claim_id").alias("n"))


@_R.add("SELECT claim_id, max(date) AS newest, count(DISTINCT source_id) FILTER (date IS NULL)::BIGINT AS undated FROM members LEFT JOIN sources USING (source_id) GROUP BY 1")
def agg_10_recency(t: Tables) -> DataFrame:
    """Newest source of each claim, and its sources without a date."""
    rows = t.members.join(t.sources.select("source_id", "date"), "source_id", "left")
    return rows.groupBy("claim_id").agg(F.max("date").alias("newest"), F.count_distinct(F.when(F.col("date").isNull(), F.col("source_id"))).alias("undated"))


@_R.add("SELECT topic_id, max(snapshot_at) AS clinician, max(max(snapshot_at)) OVER () AS latest FROM articles WHERE audience = 'clinician' GROUP BY 1")
def agg_11_snapshots(t: Tables) -> DataFrame:
    """Last snapshot of each topic for clinicians, and the last of all."""
    per = t.articles.filter("audience = 'clinician'").groupBy("topic_id").agg(F.max("snapshot_at").alias("clinician"))
    return per.join(F.broadcast(per.agg(F.max("clinician").alias("latest"))))


@_R.add(f"""SELECT kind, done, waiting, CASE WHEN done > 0 THEN done / 15.0 ELSE 4.3 END::DOUBLE AS per_minute, ceil(waiting / CASE WHEN done > 0 THEN done / 15.0 ELSE 4.3 END)::BIGINT AS minutes FROM (
 SELECT kind, count(*) FILTER (status = 'done' AND created_at > TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE AND created_at <= TIMESTAMP '{NOW}')::BIGINT AS done, count(*) FILTER (status = 'queued')::BIGINT AS waiting FROM jobs GROUP BY 1)""")
def agg_13_throughput(t: Tables) -> DataFrame:
    """Jobs done in the last quarter of an hour, the rate, and the minutes that the rest takes; a fixed rate where nothing was done."""
    now = F.lit(NOW).cast("timestamp")
    recent = (F.col("status") == "done") & (F.col("created_at") > now - F.expr("INTERVAL 15 MINUTES")) & (F.col("created_at") <= now)
    rows = t.jobs.groupBy("kind").agg(F.count_if(recent).alias("done"), F.count_if(F.col("status") == "queued").alias("waiting"))
    rows = rows.withColumn("per_minute", F.when(F.col("done") > 0, F.col("done") / 15.0).otherwise(F.lit(4.3)))
    return rows.withColumn("minutes", F.ceil(F.col("waiting") / F.col("per_minute")).cast("long"))


@_R.add("SELECT source_id, greatest(members - claims, 0) AS saved, CASE WHEN members > 0 THEN floor(CAST(100 AS DOUBLE) * greatest(members - claims, 0) / members + 0.5) ELSE 0 END::BIGINT AS pct FROM (SELECT source_id, count(claim_id)::BIGINT AS members, count(DISTINCT claim_id)::BIGINT AS claims FROM insights GROUP BY 1)")
def agg_15_dedup_ratio(t: Tables) -> DataFrame:
    """How many insights of a source stand for claims that it has already."""
    rows = t.insights.groupBy("source_id").agg(F.count("claim_id").alias("members"), F.count_distinct("claim_id").alias("claims"))
    saved = F.greatest(F.col("members") - F.col("claims"), F.lit(0))
    return rows.select("source_id", saved.alias("saved"), rounded_share(saved, F.col("members")).alias("pct"))


@_R.add("""SELECT count(*)::BIGINT AS n, round(count(*) FILTER (judge = 'SAME' AND human = 'DIFFERENT') / CAST(count(*) FILTER (judge = 'SAME') AS DOUBLE), 6) AS false_merges,
 round(count(*) FILTER (judge = 'SAME' AND human = 'SAME') / CAST(count(*) FILTER (human = 'SAME') AS DOUBLE), 6) AS recall, round(count(*) FILTER (judge = 'SAME' AND enrich) / CAST(count(*) FILTER (judge = 'SAME') AS DOUBLE), 6) AS enriched FROM rulings WHERE judge IS NOT NULL""")
def agg_18_merge_rates(t: Tables) -> DataFrame:
    """False merges, recall and rewrites of a run; failed judgements are left out."""
    same, right = F.col("judge") == "SAME", F.col("human") == "SAME"
    rate = lambda part, whole: F.round(F.try_divide(F.count_if(part), F.count_if(whole)), 6)
    return t.rulings.filter("judge IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), rate(same & ~right, same).alias("false_merges"), rate(same & right, right).alias("recall"), rate(same & F.col("enrich"), same).alias("enriched"))


@_R.add("SELECT judge, count(*)::BIGINT AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM rulings WHERE judge IS NOT NULL), 6) AS share FROM rulings WHERE judge IS NOT NULL GROUP BY 1")
def agg_20_verdicts(t: Tables) -> DataFrame:
    """Verdicts and their shares among those that did not fail."""
    rows = t.rulings.filter("judge IS NOT NULL").groupBy("judge").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(rows.agg(F.sum("n").alias("total")))).select("judge", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@_R.add("""SELECT t.topic_id, CASE WHEN v.n IS NULL THEN 1 ELSE round(coalesce(c.n, 0) / CAST(v.n AS DOUBLE), 6) END AS coverage FROM topics t LEFT JOIN (SELECT topic_id, count(*) AS n FROM filings GROUP BY 1) v USING (topic_id)
 LEFT JOIN (SELECT f.topic_id, count(DISTINCT f.claim_id) AS n FROM filings f JOIN mentions m USING (claim_id) JOIN works w USING (work_id) WHERE w.doi IS NOT NULL AND w.relevance > 250 GROUP BY 1) c USING (topic_id)""")
def agg_21_coverage(t: Tables) -> DataFrame:
    """Share of a topic's claims that a relevant identified work backs; 1 without claims."""
    backed = t.mentions.join(t.works.filter("doi IS NOT NULL AND relevance > 250"), "work_id").select("claim_id").distinct().withColumn("cited", F.lit(True))
    per = t.filings.join(backed, "claim_id", "left").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"), F.count("cited").alias("c"))
    return t.topics.join(per, "topic_id", "left").select("topic_id", F.when(F.col("n").isNull(), F.lit(1.0)).otherwise(F.round(F.col("c") / F.col("n"), 6)).alias("coverage"))


@_R.add("""SELECT conv_id, CASE WHEN bool_or(turn % 7 = 6) THEN NULL WHEN count(*) FILTER (role = 'assistant') = 0 THEN 1 ELSE greatest(0, 1 - count(*) FILTER (role = 'assistant' AND length(text) < 200) / CAST(count(*) FILTER (role = 'assistant') AS DOUBLE)) END AS grounded FROM conversations GROUP BY 1""", model=False)
def agg_22_groundedness(t: Tables) -> DataFrame:
    """Share of answers that are not short; 1 without answers, and nothing where the check failed (here: in long conversations)."""
    answers, bare = F.col("role") == "assistant", (F.col("role") == "assistant") & (F.length("text") < 200)
    share = F.when(F.count_if(answers) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.count_if(bare), F.count_if(answers))))
    return t.raw("conversations").groupBy("conv_id").agg(F.when(~F.max(F.col("turn") % 7 == 6), share).alias("grounded"))


@_R.add("SELECT count(*)::BIGINT AS topics, max(d) + 1 AS depth, count(*) FILTER (d >= 2)::BIGINT AS deep, count(*) FILTER (t.status <> 'active')::BIGINT AS inactive, count(*) FILTER (t.is_hidden)::BIGINT AS hidden FROM topics t JOIN (SELECT topic_id, max(depth) AS d FROM closure WHERE root_id LIKE 'R%' GROUP BY 1) USING (topic_id)")
def agg_24_taxonomy(t: Tables) -> DataFrame:
    """Figures of the tree."""
    depth = tree.closure(t.topics, t.topics.filter("parent_id IS NULL")).groupBy("topic_id").agg(F.max("depth").alias("d"))
    rows = t.topics.join(depth, "topic_id")
    return rows.agg(F.count(F.lit(1)).alias("topics"), (F.max("d") + 1).alias("depth"), F.count_if(F.col("d") >= 2).alias("deep"), F.count_if(F.col("status") != "active").alias("inactive"), F.count_if("is_hidden").alias("hidden"))


@_R.add("""SELECT count(*)::BIGINT AS n, count(*) FILTER (human = judge)::BIGINT AS agree, count(*) FILTER (human = 'SAME' AND judge <> 'SAME')::BIGINT AS over_flag, count(*) FILTER (human <> 'SAME' AND judge = 'SAME')::BIGINT AS under_flag,
 floor(CAST(100 AS DOUBLE) * count(*) FILTER (enrich) / count(*) + 0.5)::BIGINT AS enrich_pct FROM rulings WHERE judge IS NOT NULL""")
def agg_25_confusion(t: Tables) -> DataFrame:
    """Where judge and person differ, and in which direction."""
    same, right = F.col("judge") == "SAME", F.col("human") == "SAME"
    n = F.count(F.lit(1))
    return t.rulings.filter("judge IS NOT NULL").agg(n.alias("n"), F.count_if(F.col("human") == F.col("judge")).alias("agree"), F.count_if(right & ~same).alias("over_flag"), F.count_if(~right & same).alias("under_flag"), rounded_share(F.count_if("enrich"), n).alias("enrich_pct"))


@_R.add("SELECT count(*)::BIGINT AS n, count(*) FILTER (enrich)::BIGINT AS rewritten, count(*) FILTER (enrich AND human = 'SAME')::BIGINT AS rewritten_right, count(*) FILTER (enrich AND confidence >= 0.8)::BIGINT AS sure FROM rulings WHERE judge = 'SAME'")
def agg_26_rewrites(t: Tables) -> DataFrame:
    """Rewrites among merges: how many, how many rightly, how many with confidence."""
    return t.rulings.filter("judge = 'SAME'").agg(F.count(F.lit(1)).alias("n"), F.count_if("enrich").alias("rewritten"), F.count_if(F.col("enrich") & (F.col("human") == "SAME")).alias("rewritten_right"), F.count_if(F.col("enrich") & (F.col("confidence") >= 0.8)).alias("sure"))


@_R.add("SELECT doc_id, length(text)::BIGINT AS chars, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS paragraphs FROM documents", model=False)
def agg_27_article_sizes(t: Tables) -> DataFrame:
    """Characters and paragraphs of each text."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return t.raw("documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.size(lines).cast("long").alias("paragraphs"))


@_R.add()
def agg_28_size(t: Tables) -> DataFrame:
    """Bytes of the files behind the tables, from the files' own records."""
    rows = None
    for name in ("part", "lineitem", "documents"):
        files = t.raw(name).select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes")).select(F.lit(name).alias("name"), "files", "bytes")
        rows = files if rows is None else rows.union(files)
    return rows


@_R.add("SELECT source_id, min(job_id) AS first_job, count(*)::BIGINT AS n, row_number() OVER (ORDER BY min(created_at), min(job_id))::BIGINT AS place FROM jobs WHERE status = 'queued' GROUP BY 1")
def agg_29_first_appearance(t: Tables) -> DataFrame:
    """Waiting jobs by source, sources in the order in which they first appear."""
    rows = t.jobs.filter("status = 'queued'").groupBy("source_id").agg(F.min("job_id").alias("first_job"), F.min("created_at").alias("at"), F.count(F.lit(1)).alias("n"))
    return ranks.placed(rows, [F.col("at"), F.col("first_job")], "place").drop("at")


@_R.add("SELECT lower(name) AS key, min(name) AS name, array_to_string(list_sort(list_distinct(flatten(list(ids)))), ',') AS claim_ids FROM (SELECT c_mktsegment AS name, [c_custkey % 40, c_custkey % 7] AS ids FROM customer) GROUP BY 1", model=False)
def agg_30_proposals(t: Tables) -> DataFrame:
    """Claim ids of proposals of one name, each once."""
    rows = t.raw("customer").select(F.col("c_mktsegment").alias("name"), F.explode(F.array(F.col("c_custkey") % 40, F.col("c_custkey") % 7)).alias("id"))
    return rows.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.array_join(F.sort_array(F.collect_set("id")), ",").alias("claim_ids"))


@_R.add("SELECT DISTINCT evidence, actionability FROM claims")
def agg_31_facets(t: Tables) -> DataFrame:
    """Facet values in use."""
    return t.claims.select("evidence", "actionability").distinct().orderBy("evidence", "actionability")


@_R.add("SELECT topic_id, a.audience, coalesce(max(version), 0) + 1 AS next_version FROM (SELECT topic_id, audience FROM topics, (VALUES ('clinician'), ('patient')) v(audience)) a LEFT JOIN articles r USING (topic_id, audience) GROUP BY 1, 2")
def win_02_next_version(t: Tables) -> DataFrame:
    """The number that a topic's next article gets, 1 where there is none."""
    wanted = t.topics.select("topic_id", F.explode(F.array(F.lit("clinician"), F.lit("patient"))).alias("audience"))
    last = t.articles.groupBy("topic_id", "audience").agg(F.max("version").alias("v"))
    return wanted.join(last, ["topic_id", "audience"], "left").select("topic_id", "audience", (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


@_R.add("SELECT claim_id, work_id, 'R' || row_number() OVER (PARTITION BY claim_id ORDER BY year DESC NULLS LAST, work_id) AS marker FROM (SELECT DISTINCT claim_id, work_id FROM mentions WHERE claim_id IS NOT NULL) JOIN works USING (work_id)")
def win_04_markers(t: Tables) -> DataFrame:
    """Markers of each claim's works, newest first, those without a year last."""
    cited = t.mentions.filter("claim_id IS NOT NULL").select("claim_id", "work_id")
    rows = spread(cited.distinct().join(t.works.select("work_id", "year"), "work_id"), tasks_for(t.raw("lineitem")), "claim_id")
    order = Window.partitionBy("claim_id").orderBy(F.col("year").desc_nulls_last(), "work_id")
    return rows.select("claim_id", "work_id", F.concat(F.lit("R"), F.row_number().over(order)).alias("marker"))


@_R.add("SELECT conv_id, role, min(turn) AS first_turn, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn))::BIGINT AS place FROM conversations GROUP BY 1, 2", model=False)
def win_06_first_seen(t: Tables) -> DataFrame:
    """Distinct values in the order in which they are first seen."""
    rows = t.raw("conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("first_turn")).cast("long"))


@_R.add(f", {_SCORED} SELECT claim_id, score, source_count, row_number() OVER (ORDER BY score DESC, source_count DESC, claim_id)::BIGINT AS place FROM scored WHERE status = 'active' ORDER BY place LIMIT 100")
def sort_01_ranked(t: Tables) -> DataFrame:
    """The hundred best claims by score, sources and id, with their place."""
    rows = C.scored(t.claims, t.members, t.sources, AS_OF).filter("status = 'active'")
    best = rows.orderBy(F.col("score").desc(), F.col("source_count").desc(), "claim_id").limit(100)
    return best.select("claim_id", "score", "source_count", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("source_count").desc(), "claim_id")).cast("long").alias("place"))


@_R.add("SELECT work_id, year FROM works ORDER BY year DESC NULLS LAST, work_id LIMIT 100")
def sort_02_nulls_last(t: Tables) -> DataFrame:
    """Newest first, those without a year last."""
    return t.works.orderBy(F.col("year").desc_nulls_last(), "work_id").select("work_id", "year").limit(100)


@_R.add("SELECT topic_id, name, n, row_number() OVER (ORDER BY n DESC, name, topic_id)::BIGINT AS place FROM topics JOIN (SELECT topic_id, count(*)::BIGINT AS n FROM filings GROUP BY 1) USING (topic_id) ORDER BY place LIMIT 30")
def sort_03_by_name(t: Tables) -> DataFrame:
    """Topics by claims, then by name."""
    rows = t.topics.join(t.filings.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")), "topic_id").orderBy(F.col("n").desc(), "name", "topic_id").limit(30)
    return rows.select("topic_id", "name", "n", F.row_number().over(Window.orderBy(F.col("n").desc(), "name", "topic_id")).cast("long").alias("place"))


@_R.add("SELECT root_id AS topic_id, count(f.claim_id)::BIGINT AS total, row_number() OVER (ORDER BY count(f.claim_id) DESC, root_id)::BIGINT AS place FROM closure LEFT JOIN filings f USING (topic_id) WHERE root_id LIKE 'R%' GROUP BY 1")
def sort_04_roots(t: Tables) -> DataFrame:
    """Roots by all filings below them."""
    rows = tree.closure(t.topics, t.topics.filter("parent_id IS NULL")).join(t.filings, "topic_id", "left").groupBy(F.col("root_id").alias("topic_id")).agg(F.count("claim_id").alias("total"))
    return ranks.placed(rows, [F.col("total").desc(), F.col("topic_id")], "place")


@_R.add(f", {_SCORED} SELECT claim_id, score, (SELECT count(*) FROM scored WHERE status = 'active') AS total FROM scored WHERE status = 'active' ORDER BY score DESC, source_count DESC, claim_id LIMIT 25 OFFSET 25")
def lim_01_page(t: Tables) -> DataFrame:
    """The second page of ranked claims, with the number of all."""
    rows = C.scored(t.claims, t.members, t.sources, AS_OF).filter("status = 'active'")
    page = rows.orderBy(F.col("score").desc(), F.col("source_count").desc(), "claim_id").offset(25).limit(25).select("claim_id", "score")
    return page.join(F.broadcast(t.claims.filter("status = 'active'").agg(F.count(F.lit(1)).alias("total"))))


@_R.add(f"SELECT job_id, kind FROM jobs WHERE (status = 'running' AND locked_at < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE) OR (status = 'queued' AND run_after <= TIMESTAMP '{NOW}' AND attempts < 3) ORDER BY CASE kind WHEN 'consolidate' THEN 0 ELSE 1 END, created_at, job_id LIMIT 1")
def lim_04_next_job(t: Tables) -> DataFrame:
    """The job that a worker takes next."""
    return backlog.claimable(t.jobs, F.lit(NOW).cast("timestamp")).orderBy(*backlog.order()).select("job_id", "kind").limit(1)


@_R.add("SELECT topic_id, claim_id FROM (SELECT topic_id, claim_id, row_number() OVER (PARTITION BY topic_id ORDER BY filed_at DESC, claim_id) AS n FROM filings) WHERE n <= 40")
def lim_05_newest(t: Tables) -> DataFrame:
    """At most forty claims of each topic, the newest."""
    order = Window.partitionBy("topic_id").orderBy(F.col("filed_at").desc(), "claim_id")
    return t.filings.withColumn("n", F.row_number().over(order)).filter("n <= 40").select("topic_id", "claim_id")


@_R.add(f", {_SCORED} SELECT claim_id, score FROM scored")
def math_01_score(t: Tables) -> DataFrame:
    """Composite score of every claim."""
    return C.scored(t.claims, t.members, t.sources, AS_OF).select("claim_id", "score")


@_R.add(f"SELECT source_id, round(coalesce(greatest(CAST(0 AS DOUBLE), CAST(8 AS DOUBLE) - (epoch(TIMESTAMP '{AS_OF} 00:00:00') - epoch(date)) / {C.YEAR} * CAST(1.5 AS DOUBLE)), CAST(0 AS DOUBLE)), 6) AS bonus FROM sources")
def math_02_recency(t: Tables) -> DataFrame:
    """Recency bonus of every source."""
    return t.sources.select("source_id", F.round(C.recency_bonus(F.col("date"), AS_OF), 6).alias("bonus"))


@_R.add("SELECT claim_id, CASE WHEN importance IS NULL OR importance = 1 THEN 0 ELSE floor(CAST(100 AS DOUBLE) * (claim_id % importance) / importance + 0.5)::BIGINT END AS pct FROM claims")
def math_03_pct(t: Tables) -> DataFrame:
    """Shares in per cent, half up, 0 of nothing."""
    whole = F.coalesce(F.col("importance"), F.lit(0))
    return t.claims.select("claim_id", F.when(whole > 0, rounded_share(F.col("claim_id") % whole, whole)).otherwise(0).alias("pct"))


@_R.add("SELECT job_id, CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS next, CASE WHEN attempts < 3 THEN CAST(30 * pow(2, greatest(attempts - 1, 0)) AS BIGINT) END AS seconds FROM jobs WHERE status = 'failed'")
def math_04_back_off(t: Tables) -> DataFrame:
    """State and wait of failed jobs."""
    return backlog.retried(t.jobs)


@_R.add("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'view'", model=False)
def date_01_day(t: Tables) -> DataFrame:
    """Day of a time as text and as a date."""
    day = F.substring(F.col("ts").cast("string"), 1, 10)
    return t.raw("events").filter("event_type = 'view'").select("event_id", day.alias("day"), F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))).alias("date"))


@_R.add(f"SELECT job_id, created_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS is_new, created_at > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AS this_hour, locked_at < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AS lost FROM jobs")
def date_02_intervals(t: Tables) -> DataFrame:
    """Which intervals a time lies in."""
    now, at = F.lit(NOW).cast("timestamp"), F.col("created_at")
    return t.jobs.select("job_id", (at > now - F.expr("INTERVAL 30 DAYS")).alias("is_new"), (at > now - F.expr("INTERVAL 1 HOUR")).alias("this_hour"), (F.col("locked_at") < now - F.expr("INTERVAL 10 MINUTES")).alias("lost"))


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
_NEAR = "SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(d.e, q.e), 6) AS similarity, list_cosine_similarity(d.e, q.e) AS exact, d.label FROM v d JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id"


def _queries(t: Tables) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 50."""
    vectors = t.raw("embeddings").select("vec_id", "embedding", "label")
    return vectors, vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@_R.add("SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", model=False)
def vec_01_cosine(t: Tables) -> DataFrame:
    """Cosine of neighbouring vectors."""
    one = t.raw("embeddings").select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    two = t.raw("embeddings").select((F.col("vec_id") - 1).alias("a_id"), F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return one.join(two, "a_id").select("a_id", "b_id", F.round(vector.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


@_R.add(f"WITH {_V}, p AS ({_NEAR} WHERE d.label % 2 = 0) SELECT query_id, vec_id, similarity, nth::BIGINT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS nth FROM p WHERE exact >= 0.28) WHERE nth <= 6", model=False)
def vec_03_topics(t: Tables) -> DataFrame:
    """Nearest topics of each query, of those that are active (here: even labels)."""
    vectors, queries = _queries(t)
    return vector.match(vectors.filter("label % 2 = 0"), queries, 0.28, 6)


@_R.add(f"WITH {_V}, p AS ({_NEAR}) SELECT query_id, vec_id, similarity, nth::BIGINT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS nth FROM p WHERE exact >= 0.3) WHERE nth <= 5", model=False)
def vec_04_references(t: Tables) -> DataFrame:
    """Nearest references of each query, whatever their state."""
    vectors, queries = _queries(t)
    return vector.match(vectors, queries, 0.3, 5)


@_R.add(f", {_V}, p AS ({_NEAR}), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS nth FROM p WHERE exact >= 0.15), first AS (SELECT claim_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY filed_at, topic_id) AS n FROM filings) WHERE n = 1) SELECT query_id, vec_id, similarity, topic_id FROM best LEFT JOIN first ON claim_id = vec_id WHERE nth <= 30")
def vec_05_search(t: Tables) -> DataFrame:
    """Semantic search: the nearest claims of each query, each with its first topic."""
    vectors, queries = _queries(t)
    first = t.filings.groupBy(F.col("claim_id").alias("vec_id")).agg(F.min(F.struct("filed_at", "topic_id")).alias("f")).select("vec_id", "f.topic_id")
    return vector.match(vectors, queries, 0.15, 30).join(first, "vec_id", "left").select("query_id", "vec_id", "similarity", "topic_id")


@_R.add(f", {_V}, p AS ({_NEAR}), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS nth FROM p WHERE exact > 0.2) SELECT query_id, vec_id, similarity, topic_id FROM best LEFT JOIN filings ON claim_id = vec_id WHERE nth <= 50 AND (topic_id IS NULL OR topic_id LIKE 'N1%')")
def vec_06_filtered_search(t: Tables) -> DataFrame:
    """Search strictly above a threshold, one row for each topic of a hit under a filter."""
    vectors, queries = _queries(t)
    rows = vector.match(vectors, queries, 0.2, 50, strict=True).join(t.filings.select(F.col("claim_id").alias("vec_id"), "topic_id"), "vec_id", "left")
    return rows.filter(F.col("topic_id").isNull() | F.startswith("topic_id", F.lit("N1"))).select("query_id", "vec_id", "similarity", "topic_id")


@_R.add(f"WITH {_V} SELECT query_id, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS nth FROM (SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(d.e, q.e), 6) AS similarity, list_cosine_similarity(d.e, q.e) AS exact FROM v d JOIN v q ON q.vec_id <> d.vec_id AND q.label = 3 AND d.label <> 3) WHERE exact >= 0.2) WHERE nth <= 5", model=False)
def vec_08_pending(t: Tables) -> DataFrame:
    """Candidates of all pending insights (here: one label) among the rest, in blocks of queries."""
    vectors, _ = _queries(t)
    pending = vectors.filter("label = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.match(vectors.filter("label <> 3"), pending, 0.2, 5).drop("nth")


@_R.add(f"WITH {_V}, p AS ({_NEAR}) SELECT query_id, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS nth FROM p WHERE exact >= 0.2) WHERE nth <= 3", model=False)
def join_09_similar(t: Tables) -> DataFrame:
    """Similarity join: the three nearest above a threshold."""
    vectors, queries = _queries(t)
    return vector.match(vectors, queries, 0.2, 3).drop("nth")


@_R.add(f"WITH {_V}, p AS ({_NEAR}) SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS nth FROM p) WHERE nth <= 10", model=False)
def lim_02_top_k(t: Tables) -> DataFrame:
    """The ten nearest of each query."""
    vectors, queries = _queries(t)
    return vector.match(vectors, queries, -1.0, 10).select("query_id", "vec_id")
