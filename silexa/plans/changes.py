"""Changes of the model, consolidation, quality rules, documents, sinks and the job stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silexa.functions import text as X
from silexa.operators import changes as D
from silexa.operators import claims as C
from silexa.operators import documents as A
from silexa.operators import ranks, tree
from silexa.operators.topics import merged_topics
from silexa.session import checkpointed, shared_folder
from silexa.sources.tables import Tables
from silexa.streaming import backlog

from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
#: Folders that insights are written to, however many sources there are.
SOURCE_BUCKETS = 64
_ENDS = "ends AS (SELECT r.claim_id, CASE WHEN c.status = 'active' THEN r.at_id END AS target_id FROM redirects r JOIN claims c ON c.claim_id = r.at_id WHERE c.merged_into IS NULL)"


@_R.add("SELECT claim_id, topic_id, filed_at FROM filings UNION ALL SELECT * FROM (SELECT claim_id, 'N' || claim_id % 25, TIMESTAMP '2000-01-01 00:00:00' FROM claims WHERE claim_id % 5 = 0) n(claim_id, topic_id, filed_at) WHERE NOT EXISTS (SELECT 1 FROM filings f WHERE f.claim_id = n.claim_id AND f.topic_id = n.topic_id)")
def dml_01_upsert_ignore(t: Tables) -> DataFrame:
    """New filings beside those that are there."""
    new = t.claims.filter("claim_id % 5 = 0").select("claim_id", F.concat(F.lit("N"), F.col("claim_id") % 25).alias("topic_id"), F.lit("2000-01-01 00:00:00").cast("timestamp").alias("filed_at"))
    return D.upsert_ignore(t.filings, new, ["claim_id", "topic_id"])


@_R.add("SELECT item, CASE WHEN item % 3 = 0 THEN 'MERGE' ELSE human END AS human FROM rulings UNION ALL SELECT item + 100000000, 'NEW' FROM rulings WHERE item % 50 = 0")
def dml_02_upsert_overwrite(t: Tables) -> DataFrame:
    """Gold labels with later ones in their place; of several for one item the last counts."""
    old = t.rulings.select("item", "human")
    item = F.col("item")
    new = old.filter("item % 3 = 0").select("item", F.lit("FIRST").alias("human"), F.lit(1).alias("at")).union(old.filter("item % 3 = 0").select("item", F.lit("MERGE"), F.lit(2))).union(old.filter("item % 50 = 0").select(item + 100000000, F.lit("NEW"), F.lit(1)))
    return D.upsert_overwrite(old.withColumn("at", F.lit(0)), new, ["item"], ["at"]).drop("at")


@_R.add("SELECT claim_id, insight_id FROM members WHERE source_id % 4 <> 1")
def dml_03_cascade(t: Tables) -> DataFrame:
    """Memberships after sources and their insights are deleted."""
    _, left = D.without_sources(t.sources.filter("source_id % 4 = 1").select("source_id"), t.insights, t.members)
    return left.select("claim_id", "insight_id")


@_R.add("SELECT insight_id, source_id, CASE WHEN source_id = 3 THEN 2 ELSE 1 END AS run FROM insights WHERE NOT (source_id = 3 AND importance IS NULL)")
def dml_05_fresh_run(t: Tables) -> DataFrame:
    """A source extracted afresh replaces its own rows, written by buckets of sources; all others stay."""
    spark = t.spark
    path = f"{shared_folder(spark)}/insights/{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64("source_id"), F.lit(SOURCE_BUCKETS)).cast("int").alias("bucket")
    write = lambda df, mode: df.select("insight_id", "run", "source_id", bucket).repartition("bucket", F.pmod(F.xxhash64("insight_id"), F.lit(4))).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    write(t.insights.select("insight_id", F.lit(1).alias("run"), "source_id"), "append")
    stored = spark.read.schema("insight_id string, run int, source_id long, bucket int").parquet(path)
    fresh = t.insights.filter("source_id = 3 AND importance IS NOT NULL").select("insight_id", F.lit(2).alias("run"), "source_id")
    # Sources share a bucket, so its other rows are written again with the fresh ones; a source with nothing left keeps what it had.
    hit = fresh.select("source_id").distinct()
    buckets = [r["bucket"] for r in hit.select(bucket).distinct().collect()]
    others = stored.filter(F.col("bucket").isin(buckets)).join(F.broadcast(hit), "source_id", "left_anti").select("insight_id", "run", "source_id")
    write(checkpointed(others.union(fresh)), "overwrite")
    return spark.read.schema(stored.schema).parquet(path).drop("bucket")


@_R.add(f", {_ENDS} SELECT DISTINCT target_id AS claim_id, topic_id FROM filings JOIN ends USING (claim_id) WHERE target_id IS NOT NULL AND target_id <> claim_id AND NOT EXISTS (SELECT 1 FROM filings k WHERE k.claim_id = target_id AND k.topic_id = filings.topic_id)")
def dml_06_orphan_links(t: Tables) -> DataFrame:
    """Filings of merged claims that their survivors lack."""
    ends = tree.resolve_redirects(t.claims).filter("target_id IS NOT NULL AND target_id <> claim_id")
    lost = t.filings.join(ends, "claim_id").select(F.col("target_id").alias("claim_id"), "topic_id").distinct()
    return lost.join(t.filings, ["claim_id", "topic_id"], "left_anti")


@_R.add("""SELECT topic_id, CASE WHEN topic_id LIKE 'N%' AND topic_id NOT LIKE '%-%' AND CAST(substr(topic_id, 2, 2) AS INTEGER) % 6 = 0 THEN 'New ' || name ELSE name END AS name,
 CASE WHEN parent_id LIKE 'N%' AND CAST(substr(parent_id, 2) AS INTEGER) % 6 = 5 THEN (SELECT p.parent_id FROM topics p WHERE p.topic_id = topics.parent_id) ELSE parent_id END AS parent_id,
 CASE WHEN topic_id LIKE 'N%' AND topic_id NOT LIKE '%-%' AND CAST(substr(topic_id, 2, 2) AS INTEGER) % 6 = 5 THEN 'archived' ELSE status END AS status FROM topics""")
def dml_07_topic_edits(t: Tables) -> DataFrame:
    """Topics after renaming some and archiving others, whose children move up."""
    number = F.substring("topic_id", 2, 2).cast("int")
    nations = t.topics.filter(F.rlike("topic_id", F.lit("^N[0-9]+$")))
    names = nations.filter(number % 6 == 0).select("topic_id", F.concat(F.lit("New "), "name").alias("name"))
    return D.archived(D.renamed(t.topics, names), nations.filter(number % 6 == 5).select("topic_id")).select("topic_id", "name", "parent_id", "status")


@_R.add("""SELECT claim_id, topic_id, arg_min(filed_at, (moved, filed_at)) AS filed_at FROM (SELECT claim_id, CASE topic_id WHEN 'N1' THEN 'N2' WHEN 'N5' THEN 'N6' ELSE topic_id END AS topic_id, filed_at, topic_id IN ('N1', 'N5') AS moved FROM filings) GROUP BY 1, 2""")
def dml_07_topic_merges(t: Tables) -> DataFrame:
    """Filings after two topics are merged into others."""
    pairs = t.topics.filter(F.col("topic_id").isin("N1", "N5")).select("topic_id", F.when(F.col("topic_id") == "N1", "N2").otherwise("N6").alias("target_id"))
    return merged_topics(t.topics, t.filings, pairs)[1]


@_R.add("""SELECT d.review_id, CASE WHEN r.review_id IS NULL THEN 404 WHEN accept IS NULL THEN 400 WHEN r.status <> 'pending' THEN 409 WHEN accept AND NOT ok THEN 409 ELSE 200 END AS answer,
 CASE WHEN r.review_id IS NULL THEN NULL WHEN accept IS NULL OR r.status <> 'pending' OR (accept AND NOT ok) THEN r.status WHEN accept THEN 'accepted' ELSE 'rejected' END AS status
 FROM (SELECT claim_id AS review_id, CASE claim_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS accept FROM claims WHERE claim_id % 10 IN (3, 4)) d
 LEFT JOIN (SELECT *, EXISTS (SELECT 1 FROM claims c WHERE c.claim_id = reviews.claim_id AND c.status = 'active') AND EXISTS (SELECT 1 FROM claims c WHERE c.claim_id = candidate_id AND c.status = 'active') AS ok FROM reviews) r USING (review_id)""")
def dml_09_decisions(t: Tables) -> DataFrame:
    """What decisions on reviews do, and what they are answered."""
    key = F.col("claim_id")
    asked = t.claims.filter((key % 10).isin(3, 4))
    return D.decided(t.reviews, asked.select(key.alias("review_id"), F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("accept")), t.claims)


@_R.add("SELECT DISTINCT claim_id, rule FROM (SELECT claim_id, rule FROM flags UNION ALL SELECT claim_id, 'merge_fidelity' FROM claims WHERE claim_id % 6 = 5)")
def dml_11_flags(t: Tables) -> DataFrame:
    """Flags after raising more of them, once a claim and rule."""
    new = t.claims.filter("claim_id % 6 = 5").select("claim_id", F.lit("merge_fidelity").alias("rule"))
    return D.upsert_ignore(t.flags.select("claim_id", "rule"), new, ["claim_id", "rule"])


@_R.add("SELECT job_id, CASE WHEN status = 'running' AND locked_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR THEN 'failed' ELSE status END AS status, status = 'running' AND locked_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR AS closed FROM jobs")
def dml_12_repairs(t: Tables) -> DataFrame:
    """Runs that are over an hour old are closed."""
    old = (F.col("status") == "running") & (F.col("locked_at") < F.lit("2024-01-20 00:00:00").cast("timestamp") - F.expr("INTERVAL 1 HOUR"))
    return t.jobs.select("job_id", F.when(old, "failed").otherwise(F.col("status")).alias("status"), F.when(F.col("status") == "running", old).otherwise(False).alias("closed"))


@_R.add("""SELECT name, CASE WHEN t.topic_id IS NULL THEN 'create' WHEN t.parent_id IS NOT DISTINCT FROM p.parent THEN 'adopt' ELSE 'move' END AS action, t.topic_id FROM
 (SELECT 'NATION_' || n_nationkey AS name, 'R' || CASE WHEN n_nationkey % 4 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS parent FROM nation UNION ALL SELECT 'NATION_' || (n_nationkey + 50), 'R1' FROM nation) p LEFT JOIN topics t USING (name)""")
def dml_13_spine(t: Tables) -> DataFrame:
    """A curated plan against the tree: topics to adopt, to move and to create."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    base = t.raw("nation")
    plan = base.select(F.concat(F.lit("NATION_"), key).alias("name"), F.concat(F.lit("R"), F.when(key % 4 == 0, (region + 1) % 5).otherwise(region)).alias("parent")).union(base.select(F.concat(F.lit("NATION_"), key + 50), F.lit("R1")))
    rows = plan.join(t.topics.select("name", "topic_id", "parent_id"), "name", "left")
    return rows.select("name", F.when(F.col("topic_id").isNull(), "create").when(F.col("parent_id").eqNullSafe(F.col("parent")), "adopt").otherwise("move").alias("action"), "topic_id")


@_R.add("SELECT source_id, coalesce(s.date, d) AS date, s.date IS NULL AND d IS NOT NULL AS filled FROM sources s LEFT JOIN (SELECT l_suppkey AS source_id, min(l_shipdate) AS d FROM lineitem GROUP BY 1) USING (source_id)")
def dml_14_backfill(t: Tables) -> DataFrame:
    """Dates of sources without one, looked up by key."""
    found = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("source_id")).agg(F.min("l_shipdate").alias("d"))
    return t.sources.join(found, "source_id", "left").select("source_id", F.coalesce("date", "d").alias("date"), (F.col("date").isNull() & F.col("d").isNotNull()).alias("filled"))


@_R.add("""SELECT q.name, CASE WHEN p.topic_id IS NULL OR p.status <> 'active' THEN 'refused' WHEN s.topic_id IS NOT NULL THEN 'reused' ELSE 'created' END AS outcome FROM (SELECT DISTINCT c_mktsegment || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE ' ' || (c_custkey % 9) END AS name, 'N' || (c_custkey % 30) AS parent FROM customer) q
 LEFT JOIN topics p ON p.topic_id = q.parent LEFT JOIN topics s ON s.parent_id = q.parent AND s.name = q.name""")
def dml_10_proposals(t: Tables) -> DataFrame:
    """Proposed topics: refused without an active parent, else a sibling of that name or a new topic."""
    key = F.col("c_custkey")
    name = F.concat("c_mktsegment", F.when(key % 9 == 0, "").otherwise(F.concat(F.lit(" "), key % 9)))
    asked = t.raw("customer").select(name.alias("name"), F.concat(F.lit("N"), key % 30).alias("parent")).distinct()
    parents = t.topics.select(F.col("topic_id").alias("parent"), F.col("status").alias("_status"))
    same = t.topics.select(F.col("parent_id").alias("parent"), "name", F.lit(True).alias("_same"))
    rows = asked.join(parents, "parent", "left").join(same, ["parent", "name"], "left")
    return rows.select("name", F.when(F.col("_status").isNull() | (F.col("_status") != "active"), "refused").when(F.col("_same"), "reused").otherwise("created").alias("outcome"))


@_R.add("SELECT review_id, CASE WHEN i BETWEEN 1 AND 3 THEN [claim_id, candidate_id, claim_id + 2][i] ELSE claim_id END AS chosen FROM (SELECT *, CAST(review_id % 5 AS INTEGER) AS i FROM reviews)")
def ded_02_choice(t: Tables) -> DataFrame:
    """The candidate that a judge's number means, the first where it means none."""
    of = F.array("claim_id", "candidate_id", F.col("claim_id") + 2)
    i = (F.col("review_id") % 5).cast("int")
    return t.reviews.select("review_id", F.coalesce(F.get(of, i - 1), F.get(of, F.lit(0))).alias("chosen"))


@_R.add("SELECT insight_id AS claim_id, source_id, importance, evidence, 1 AS member_count, 1 AS source_count, CAST(1 AS DOUBLE) AS confidence, 'seed' AS matched_by FROM insights WHERE claim_id IS NULL AND evidence = 'RCT'")
def ded_04_seeds(t: Tables) -> DataFrame:
    """Claims made of insights that belong to none."""
    rows = t.insights.filter("claim_id IS NULL AND evidence = 'RCT'")
    return rows.select(F.col("insight_id").alias("claim_id"), "source_id", "importance", "evidence", F.lit(1).alias("member_count"), F.lit(1).alias("source_count"), F.lit(1.0).alias("confidence"), F.lit("seed").alias("matched_by"))


@_R.add("SELECT claim_id, count(DISTINCT insight_id)::BIGINT AS member_count, count(DISTINCT source_id)::BIGINT AS source_count FROM (SELECT claim_id, insight_id, source_id FROM members UNION ALL SELECT source_id % 50, insight_id, source_id FROM insights WHERE claim_id IS NULL OR claim_id = source_id % 50) GROUP BY 1")
def ded_05_attach(t: Tables) -> DataFrame:
    """Counts of claims after insights are attached, those that were there already once."""
    own = t.members.select("claim_id", "insight_id", "source_id")
    more = t.insights.filter("claim_id IS NULL OR claim_id = source_id % 50").select((F.col("source_id") % 50).alias("claim_id"), "insight_id", "source_id")
    rows = D.upsert_ignore(own, more, ["claim_id", "insight_id"])
    return rows.groupBy("claim_id").agg(F.count(F.lit(1)).alias("member_count"), F.count_distinct("source_id").alias("source_count"))


@_R.add(f""", {_ENDS} SELECT review_id, CASE WHEN a.target_id IS NULL OR b.target_id IS NULL THEN 'inactive' WHEN a.target_id = b.target_id THEN 'merged already' ELSE 'merge' END AS outcome
 FROM reviews r LEFT JOIN ends a ON a.claim_id = r.claim_id LEFT JOIN ends b ON b.claim_id = r.candidate_id WHERE r.status = 'pending' AND verdict = 'SAME' AND confidence >= 0.5""")
def ded_08_bulk_accept(t: Tables) -> DataFrame:
    """What accepting the sure reviews at once does: claims are followed to their survivors first."""
    ends = tree.resolve_redirects(t.claims)
    one, two = ends.select("claim_id", F.col("target_id").alias("_a")), ends.select(F.col("claim_id").alias("candidate_id"), F.col("target_id").alias("_b"))
    rows = t.reviews.filter("status = 'pending' AND verdict = 'SAME' AND confidence >= 0.5").join(one, "claim_id", "left").join(two, "candidate_id", "left")
    return rows.select("review_id", F.when(F.col("_a").isNull() | F.col("_b").isNull(), "inactive").when(F.col("_a") == F.col("_b"), "merged already").otherwise("merge").alias("outcome"))


@_R.add("""SELECT key, work_id FROM (SELECT *, row_number() OVER (ORDER BY origin, work_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY origin, work_id) AS n FROM (SELECT coalesce(lower(doi), trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) AS key, work_id % 3 AS origin, work_id FROM works)) WHERE n = 1) WHERE place <= 8""")
def ded_10_candidates(t: Tables) -> DataFrame:
    """The first eight works of several lists, each identifier or title once."""
    rows = t.works.select(F.coalesce(F.lower("doi"), X.normal_title(F.col("title"))).alias("key"), (F.col("work_id") % 3).alias("origin"), "work_id")
    return rows.groupBy("key").agg(F.min(F.struct("origin", "work_id")).alias("f")).orderBy("f").limit(8).select("key", "f.work_id")


@_R.add("""SELECT fingerprint, min(work_id) AS work_id, count(*)::BIGINT AS uses FROM (SELECT work_id, CASE WHEN doi IS NOT NULL THEN 'doi:' || lower(doi) ELSE 't:' || trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) || coalesce(':' || year, '') END AS fingerprint FROM works) GROUP BY 1""")
def ded_11_references(t: Tables) -> DataFrame:
    """Works by their fingerprint, found or made once."""
    title = F.concat(F.lit("t:"), X.normal_title(F.col("title")), F.coalesce(F.concat(F.lit(":"), "year"), F.lit("")))
    mark = F.when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), F.lower("doi"))).otherwise(title)
    return t.works.select("work_id", mark.alias("fingerprint")).groupBy("fingerprint").agg(F.min("work_id").alias("work_id"), F.count(F.lit(1)).alias("uses"))


_SPOKEN = "statement || ' by ' || claim_id % 7 || ' of ' || claim_id % 4"
_OWN = "string_agg('in ' || m.source_id % 7 || ' cases', ' ')"


@_R.add("""SELECT claim_id, n::BIGINT AS members, CASE WHEN n < 2 THEN 'unchanged' WHEN claim_id % 7 IN (SELECT source_id % 7 FROM members m WHERE m.claim_id = x.claim_id) THEN 'rewritten' ELSE 'rejected' END AS outcome FROM (SELECT c.claim_id, count(*) AS n FROM claims c JOIN members USING (claim_id) WHERE status = 'active' GROUP BY 1) x""")
def ded_12_enrichment(t: Tables) -> DataFrame:
    """Rewritten texts of claims (here: with a number) are taken only if all their numbers stand in a member; single members need no rewriting."""
    have = t.members.groupBy("claim_id").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.collect_set((F.col("source_id") % 7).cast("string")), " ").alias("ground"))
    rows = t.claims.filter("status = 'active'").join(have, "claim_id").select("claim_id", "members", "ground", F.concat("statement", F.lit(" in "), F.col("claim_id") % 7).alias("said"))
    kept = F.size(X.missing_numbers(F.col("said"), F.col("ground"))) == 0
    return rows.select("claim_id", "members", F.when(F.col("members") < 2, "unchanged").when(kept, "rewritten").otherwise("rejected").alias("outcome"))


@_R.add(f"""SELECT claim_id, n AS members, array_to_string(invented, '|') AS invented FROM (SELECT c.claim_id, count(*)::BIGINT AS n, list_filter(regexp_extract_all(any_value({_SPOKEN}), '[0-9]+(?:\\.[0-9]+)?'), lambda x: NOT list_contains(regexp_extract_all({_OWN}, '[0-9]+(?:\\.[0-9]+)?'), x)) AS invented
 FROM claims c JOIN members m USING (claim_id) WHERE c.status = 'active' GROUP BY 1) WHERE n > 1 AND len(invented) > 0""")
def qr_01_merge_fidelity(t: Tables) -> DataFrame:
    """Active claims of several members whose text has numbers that no member has."""
    said = F.concat("statement", F.lit(" by "), F.col("claim_id") % 7, F.lit(" of "), F.col("claim_id") % 4)
    found = t.members.select("claim_id", (F.col("source_id") % 7).cast("string").alias("n")).groupBy("claim_id").agg(F.collect_set("n").alias("have"), F.count(F.lit(1)).alias("members"))
    rows = t.claims.filter("status = 'active'").select("claim_id", said.alias("said")).join(found.filter("members > 1"), "claim_id")
    invented = F.filter(X.numbers(F.col("said")), lambda n: ~F.array_contains("have", n))
    return rows.select("claim_id", "members", F.array_join(invented, "|").alias("invented")).filter("invented <> ''")


@_R.add("SELECT claim_id FROM claims WHERE status = 'active' AND importance IS NOT NULL AND (claim_id NOT IN (SELECT claim_id FROM filings WHERE topic_id NOT LIKE 'N1%') OR actionability IS NULL)")
def qr_02_orphan_topic(t: Tables) -> DataFrame:
    """Active claims, done with tagging, that have no topic or do not fit it."""
    own = t.claims.filter("status = 'active' AND importance IS NOT NULL")
    filed = t.filings.filter(~F.startswith("topic_id", F.lit("N1"))).select("claim_id").distinct().withColumn("filed", F.lit(True))
    return own.join(filed, "claim_id", "left").filter("filed IS NULL OR actionability IS NULL").select("claim_id")


@_R.add("""SELECT m.claim_id, m.insight_id, v.verdict FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY CASE matched_by WHEN 'seed' THEN 0 ELSE 1 END, insight_id) AS n FROM members) m JOIN (SELECT doc_id AS claim_id, CASE WHEN quality = 1 THEN 'FAITHFUL' WHEN toxic = 1 THEN 'ADDED_DETAIL' ELSE 'DROPPED_QUALIFIER' END AS verdict FROM labels) v USING (claim_id)
 WHERE n = 1 AND verdict <> 'FAITHFUL' AND claim_id NOT IN (SELECT claim_id FROM flags)""")
def qr_03_extraction_fidelity(t: Tables) -> DataFrame:
    """Claims whose first member a judge found unfaithful, the seed before others; those flagged already are left out."""
    order = F.struct(F.when(F.col("matched_by") == "seed", 0).otherwise(1), "insight_id")
    first = t.members.groupBy("claim_id").agg(F.min_by("insight_id", order).alias("insight_id"))
    verdict = F.when(F.col("quality") == 1, "FAITHFUL").when(F.col("toxic") == 1, "ADDED_DETAIL").otherwise("DROPPED_QUALIFIER")
    judged = t.raw("labels").select(F.col("doc_id").alias("claim_id"), verdict.alias("verdict")).filter("verdict <> 'FAITHFUL'")
    return first.join(judged, "claim_id").join(t.flags, "claim_id", "left_anti").select("claim_id", "insight_id", "verdict")


@_R.add("SELECT rule, count(*)::BIGINT AS n, array_to_string(list_sort(list(claim_id))[1:5], ',') AS examples FROM flags WHERE NOT resolved GROUP BY 1")
def qr_04_open_flags(t: Tables) -> DataFrame:
    """Open flags by rule, with five examples."""
    ranked = t.flags.filter("NOT resolved").withColumn("nth", F.row_number().over(Window.partitionBy("rule").orderBy("claim_id")))
    counts = t.flags.filter("NOT resolved").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    five = ranked.filter("nth <= 5").groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("claim_id")), ",").alias("examples"))
    return counts.join(five, "rule")


@_R.add("SELECT topic_id, n, n >= 30 AS too_broad, claim_id FROM (SELECT topic_id, claim_id, count(*) OVER (PARTITION BY topic_id)::BIGINT AS n, row_number() OVER (PARTITION BY topic_id ORDER BY claim_id) AS nth FROM filings) WHERE n >= 30 AND nth <= 40")
def qr_07_broad_topics(t: Tables) -> DataFrame:
    """Topics of thirty claims or more, with the first forty of them."""
    broad = t.filings.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 30")
    rows = t.filings.join(broad, "topic_id").withColumn("nth", F.row_number().over(Window.partitionBy("topic_id").orderBy("claim_id"))).filter("nth <= 40")
    return rows.select("topic_id", "n", (F.col("n") >= 30).alias("too_broad"), "claim_id")


@_R.add("""SELECT claim_id, tag, CASE WHEN k.id IS NOT NULL THEN 'link' WHEN p.id IS NOT NULL THEN 'create' ELSE 'propose' END AS action, coalesce(k.id, p.id) AS topic_id FROM (
 SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY pos) AS n FROM (SELECT claim_id, pos, CASE (claim_id + pos) % 3 WHEN 0 THEN 'nation_' || claim_id % 25 WHEN 1 THEN 'new ' || claim_id % 9 ELSE 'odd' END AS tag, CASE WHEN (claim_id + pos) % 3 = 1 THEN 'ASIA' ELSE 'nowhere' END AS parent FROM claims, range(0, 3) r(pos))) x
 LEFT JOIN (SELECT lower(name) AS name, min(topic_id) AS id FROM topics GROUP BY 1) k ON k.name = lower(tag) LEFT JOIN (SELECT lower(name) AS name, min(topic_id) AS id FROM topics GROUP BY 1) p ON p.name = lower(parent) WHERE n <= 2""")
def qr_08_placement(t: Tables) -> DataFrame:
    """What becomes of proposed tags."""
    key = F.col("claim_id")
    rows = t.claims.select("claim_id", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("pos"))
    kind = (key + F.col("pos")) % 3
    tag = F.when(kind == 0, F.concat(F.lit("nation_"), key % 25)).when(kind == 1, F.concat(F.lit("new "), key % 9)).otherwise("odd")
    return D.placed(rows.select("claim_id", "pos", tag.alias("tag"), F.when(kind == 1, "ASIA").otherwise("nowhere").alias("parent")), t.topics)


@_R.add("""SELECT m.work_id, f.accepted FROM works m JOIN (SELECT title, min(work_id) AS first, arg_min(relevance, work_id) >= 350 AS accepted FROM works GROUP BY 1) f USING (title)""")
def qr_09_reference_judge(t: Tables) -> DataFrame:
    """A judge's answer on works (here: by relevance), asked once a title and kept for all of that title."""
    asked = t.works.groupBy("title").agg((F.min_by("relevance", "work_id") >= 350).alias("accepted"))
    return t.works.join(asked, "title").select("work_id", "accepted")


@_R.add("SELECT t.topic_id FROM topics t LEFT JOIN (SELECT topic_id, max(snapshot_at) AS at FROM articles WHERE (topic_id, audience, version) IN (SELECT topic_id, audience, max(version) FROM articles GROUP BY 1, 2) GROUP BY 1) a USING (topic_id) LEFT JOIN (SELECT topic_id, max(filed_at) AS newest FROM filings GROUP BY 1) f USING (topic_id) WHERE a.topic_id IS NULL OR f.newest > a.at")
def qr_06_never_or_newer(t: Tables) -> DataFrame:
    """The second meaning of stale: never written, or with a direct claim newer than the last versions' snapshots."""
    last = t.articles.groupBy("topic_id", "audience").agg(F.max_by("snapshot_at", "version").alias("at")).groupBy("topic_id").agg(F.max("at").alias("at"), F.lit(True).alias("written"))
    newest = t.filings.groupBy("topic_id").agg(F.max("filed_at").alias("newest"))
    return t.topics.join(last, "topic_id", "left").join(newest, "topic_id", "left").filter("written IS NULL OR newest > at").select("topic_id")


def _blocks(t: Tables) -> DataFrame:
    """Conversations as articles: a section for each role, a block for each turn."""
    turn, key = F.col("turn"), F.col("conv_id") * 10 + F.col("turn")
    kinds = F.array(*[F.lit(k) for k in ("prose", "bullets", "key_takeaways", "callout", "heading", "table")])
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    sentence = lambda x, i: F.struct(F.concat(F.trim(x), F.lit(" [0a1b2c3d-0000-4000-8000-000000000000]")).alias("text"), F.when(i % 2 == 0, "sourced").otherwise("synthesis").alias("kind"), F.slice(F.array(key, key + 1), 1, (i + turn.cast("int")) % 3).alias("claim_ids"))
    kind = F.get(kinds, (turn % 6).cast("int"))
    return t.raw("conversations").select(
        F.col("conv_id").alias("article_id"), F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2).alias("section"), F.concat(F.lit("Part "), "role").alias("title"), turn.alias("pos"), kind.alias("kind"),
        F.transform(lines, sentence).alias("sentences"), F.when(turn % 2 == 0, "note").otherwise("caution").alias("tone"), F.array(F.lit("a|b"), F.lit("n")).alias("headers"), F.array(F.array("role", turn.cast("string"))).alias("cells"),
        F.when(F.col("conv_id") % 2 == 0, F.array(key)).otherwise(F.array().cast("array<bigint>")).alias("claim_ids"),
    )


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_CLEAN = f"list_transform({_LINES}, lambda x: trim(regexp_replace(regexp_replace(x, ' +([.,;:)])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g')))"
_BLOCK = f"""b AS (SELECT conv_id AS article_id, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS section, role, turn AS pos, {_CLEAN} AS s FROM conversations),
m AS (SELECT article_id, section, pos, CASE turn6 WHEN 5 THEN '| a\\|b | n |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || role || ' | ' || pos || ' |' WHEN 0 THEN p WHEN 1 THEN u WHEN 2 THEN '**Key Takeaways**' || chr(10) || chr(10) || u WHEN 3 THEN '> **' || CASE WHEN pos % 2 = 0 THEN 'Note' ELSE 'Caution' END || ':** ' || p ELSE '### ' || p END AS markdown
 FROM (SELECT *, pos % 6 AS turn6, array_to_string(s, ' ') AS p, array_to_string(list_transform(s, lambda x: '- ' || x), chr(10)) AS u FROM b) WHERE turn6 = 5 OR len(s) > 0)"""


@_R.add(f"WITH {_BLOCK} SELECT * FROM m", model=False)
def doc_02_blocks(t: Tables) -> DataFrame:
    """Blocks as Markdown."""
    return A.rendered(_blocks(t)).filter("markdown IS NOT NULL").select("article_id", "section", "pos", "markdown")


@_R.add(f"""WITH {_BLOCK}, parts AS (SELECT * FROM m UNION ALL SELECT DISTINCT article_id, section, -1, '## Part ' || role FROM b UNION ALL SELECT DISTINCT article_id, 99, -1, '## References' FROM b UNION ALL SELECT DISTINCT article_id, 99, n, n || '. Work ' || n FROM b, range(1, 3) r(n))
SELECT article_id, string_agg(markdown, chr(10) || chr(10) ORDER BY section, pos, markdown) AS markdown FROM parts GROUP BY 1""", model=False)
def doc_01_articles(t: Tables) -> DataFrame:
    """Whole articles: sections, blocks and references."""
    ids = t.raw("conversations").select(F.col("conv_id").alias("article_id")).distinct()
    works = ids.select("article_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select("article_id", F.concat(F.lit("R"), "n").alias("marker"), F.concat(F.lit("Work "), "n").alias("citation"))
    return A.articles(_blocks(t), works)


@_R.add(f"WITH {_BLOCK} SELECT article_id, section, pos, i AS sentence, s[i + 1] AS text, CASE WHEN i % 2 = 0 THEN 'sourced' ELSE 'synthesis' END AS kind FROM (SELECT *, CAST(unnest(range(len(s))) AS INTEGER) AS i FROM b WHERE pos % 6 <> 5)", model=False)
def doc_03_sentences(t: Tables) -> DataFrame:
    """Sentences of all blocks but tables."""
    rows = _blocks(t).filter("kind <> 'table'").select("article_id", "section", "pos", F.posexplode("sentences").alias("sentence", "s"))
    return rows.select("article_id", "section", "pos", "sentence", X.without_claim_ids(F.col("s.text")).alias("text"), "s.kind")


_CITES = f"""{_BLOCK}, e AS (SELECT article_id, section, pos, i, CASE WHEN pos % 6 = 5 THEN CASE WHEN article_id % 2 = 0 THEN [article_id * 10 + pos] ELSE [] END ELSE [article_id * 10 + pos, article_id * 10 + pos + 1][1:(i + pos) % 3] END AS ids, CASE WHEN i % 2 = 0 THEN 'sourced' ELSE 'synthesis' END AS kind
 FROM (SELECT *, CAST(unnest(CASE WHEN pos % 6 = 5 THEN range(1) ELSE range(len(s)) END) AS INTEGER) AS i FROM b))"""


@_R.add(f"WITH {_CITES} SELECT article_id, claim_id, row_number() OVER (PARTITION BY article_id ORDER BY min((section, pos, i, nth)))::BIGINT AS place FROM (SELECT *, unnest(ids) AS claim_id, unnest(range(len(ids))) AS nth FROM e) GROUP BY 1, 2", model=False)
def doc_04_cited(t: Tables) -> DataFrame:
    """Claims in the order in which articles cite them."""
    return A.cited(_blocks(t))


@_R.add(f"WITH {_CITES} SELECT article_id, section, pos, CASE WHEN pos % 6 < 5 THEN i END AS sentence, CASE WHEN pos % 6 = 5 THEN 'table without claims' WHEN kind = 'sourced' THEN 'sourced without claims' ELSE 'synthesis of fewer than two claims' END AS issue FROM e WHERE CASE WHEN pos % 6 = 5 OR kind = 'sourced' THEN len(ids) < 1 ELSE len(ids) < 2 END", model=False)
def doc_05_issues(t: Tables) -> DataFrame:
    """What articles lack in citations."""
    return A.issues(_blocks(t))


@_R.add("SELECT topic_id, string_agg('[' || claim_id || '] ' || statement || coalesce(' (' || evidence || ')', ''), chr(10) ORDER BY claim_id) AS prompt FROM filings JOIN claims USING (claim_id) GROUP BY 1")
def doc_06_prompts(t: Tables) -> DataFrame:
    """A topic's claims as lines for a model."""
    line = F.concat(F.lit("["), "claim_id", F.lit("] "), "statement", F.coalesce(F.concat(F.lit(" ("), "evidence", F.lit(")")), F.lit("")))
    rows = t.filings.join(t.claims, "claim_id").select("topic_id", F.struct("claim_id", line.alias("line")).alias("x"))
    return rows.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("prompt"))


@_R.add("""SELECT t.topic_id, CASE WHEN s.at IS NULL THEN 'full' WHEN coalesce(new, 0) = 0 THEN 'metadata' WHEN CAST(new AS DOUBLE) / total > 0.25 THEN 'full' ELSE 'sections' END AS tier FROM topics t LEFT JOIN (SELECT topic_id, max(snapshot_at) AS at FROM articles GROUP BY 1) s USING (topic_id)
 LEFT JOIN (SELECT f.topic_id, count(*) AS total, count(*) FILTER (f.filed_at > a.at) AS new FROM filings f LEFT JOIN (SELECT topic_id, max(snapshot_at) AS at FROM articles GROUP BY 1) a USING (topic_id) GROUP BY 1) n USING (topic_id)""")
def doc_07_update_tiers(t: Tables) -> DataFrame:
    """How much of each topic's article is written anew."""
    at = t.articles.groupBy("topic_id").agg(F.max("snapshot_at").alias("at"))
    counts = t.filings.join(at, "topic_id", "left").groupBy("topic_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("filed_at") > F.col("at")).alias("new"))
    rows = t.topics.join(at, "topic_id", "left").join(counts, "topic_id", "left")
    return rows.select("topic_id", A.update_tier(F.coalesce("new", F.lit(0)), F.col("total"), F.col("at").isNotNull()).alias("tier"))


@_R.add("SELECT claim_id, CASE WHEN s IN (0, 1, 2) THEN s END AS section FROM (SELECT c_custkey AS claim_id, min(c_nationkey % 5) AS s FROM customer WHERE c_custkey % 8 > 0 GROUP BY 1) UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 8 = 0", model=False)
def doc_08_placement(t: Tables) -> DataFrame:
    """Sections of new claims: the first that is assigned, if it exists; claims without one stay unplaced."""
    own = t.raw("customer").select(F.col("c_custkey").alias("claim_id"))
    said = t.raw("customer").filter("c_custkey % 8 > 0").select(F.col("c_custkey").alias("claim_id"), (F.col("c_nationkey") % 5).alias("section")).groupBy("claim_id").agg(F.min("section").alias("section"))
    known = t.spark.range(3).select(F.col("id").cast("int").alias("section"))
    return own.join(said.join(known, "section", "left_semi"), "claim_id", "left").select("claim_id", "section")


def _written(t: Tables, df: DataFrame, kind: str, **options) -> str:
    path = f"{shared_folder(t.spark)}/export/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").options(**options).format(kind).save(path)
    return path


@_R.add("SELECT insight_id, s.title AS source, c.statement AS claim FROM insights i LEFT JOIN sources s USING (source_id) LEFT JOIN claims c ON c.claim_id = i.claim_id ORDER BY created_at DESC, insight_id LIMIT 500")
def sink_01_json(t: Tables) -> DataFrame:
    """The newest insights with source and claim, written as JSON lines and read back."""
    newest = t.insights.orderBy(F.col("created_at").desc(), "insight_id").limit(500)
    rows = newest.join(t.sources.select("source_id", "title"), "source_id", "left").join(t.claims.select("claim_id", "statement"), "claim_id", "left")
    out = rows.select("insight_id", F.struct("title").alias("source"), F.struct("statement").alias("claim"))
    return t.spark.read.schema(out.schema).json(_written(t, out, "json")).select("insight_id", F.col("source.title").alias("source"), F.col("claim.statement").alias("claim"))


@_R.add("SELECT claim_id, statement, actionability, evidence FROM claims")
def sink_02_csv(t: Tables) -> DataFrame:
    """Claims as CSV with all cells quoted, read back."""
    out = t.claims.select("claim_id", "statement", "actionability", "evidence")
    path = _written(t, out, "csv", header="true", quoteAll="true", escape='"', emptyValue="", nullValue="")
    return t.spark.read.schema(out.schema).option("header", True).option("escape", '"').csv(path)


@_R.add("SELECT topic_id, name, parent_id, status FROM topics")
def sink_03_snapshot(t: Tables) -> DataFrame:
    """The tree as a snapshot that is never overwritten, read back."""
    out = t.topics.select("topic_id", "name", "parent_id", "status")
    return t.spark.read.schema(out.schema).json(_written(t, out, "json"))


@_R.add(f"SELECT article_id, md5(markdown) AS digest FROM ({ORACLE_SQL['doc_01_articles']})", model=False)
def sink_04_markdown(t: Tables) -> DataFrame:
    """Articles written as Markdown, many to a file, and read back."""
    path = f"{shared_folder(t.spark)}/export/{uuid.uuid4().hex}"
    A.write_markdown(doc_01_articles(t), path)
    return A.read_markdown(t.spark, path).select(F.col("article_id").cast("long").alias("article_id"), F.md5("markdown").alias("digest"))


def _drained(t: Tables, files: int) -> DataFrame:
    base = f"{shared_folder(t.spark)}/queue/{uuid.uuid4().hex}"
    jobs = t.jobs.filter("status = 'queued'").select("job_id", "kind", "payload", "created_at")
    jobs.repartition(4, "job_id").write.parquet(f"{base}/jobs")
    backlog.drain(t.spark, f"{base}/jobs", f"{base}/out", f"{base}/check", jobs.schema, files)
    # A second start finds nothing to do.
    backlog.drain(t.spark, f"{base}/jobs", f"{base}/out", f"{base}/check", jobs.schema, files)
    return t.spark.read.parquet(f"{base}/out")


@_R.add("SELECT kind, payload, 1::BIGINT AS n FROM jobs WHERE status = 'queued' GROUP BY 1, 2")
def stm_01_micro_batches(t: Tables) -> DataFrame:
    """The queue drained in micro-batches: each kind and payload is handled once, over all batches and a restart."""
    return _drained(t, 1).groupBy("kind", "payload").agg(F.count(F.lit(1)).alias("n"))


@_R.add("SELECT job_id, kind, payload FROM (SELECT *, row_number() OVER (PARTITION BY kind, payload ORDER BY created_at, job_id) AS n FROM jobs WHERE status = 'queued') WHERE n = 1")
def stm_05_coalesced(t: Tables) -> DataFrame:
    """The queue in one batch: of jobs of one kind and payload the first."""
    return _drained(t, 100).select("job_id", "kind", "payload")


@_R.add("SELECT kind, payload FROM jobs WHERE status = 'queued' GROUP BY 1, 2")
def stm_02_resumed(t: Tables) -> DataFrame:
    """A stream that stops after some files goes on where it was, with files that came meanwhile."""
    base = f"{shared_folder(t.spark)}/queue/{uuid.uuid4().hex}"
    jobs = t.jobs.filter("status = 'queued'").select("job_id", "kind", "payload", "created_at")
    for half in (0, 1):
        jobs.filter(F.col("job_id") % 2 == half).repartition(2, "job_id").write.mode("append").parquet(f"{base}/jobs")
        backlog.drain(t.spark, f"{base}/jobs", f"{base}/out", f"{base}/check", jobs.schema, 1)
    return t.spark.read.parquet(f"{base}/out").select("kind", "payload")


@_R.add("SELECT kind, payload, row_number() OVER (ORDER BY CASE kind WHEN 'consolidate' THEN 0 ELSE 1 END, created_at, job_id)::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind, payload ORDER BY created_at, job_id) AS n FROM jobs WHERE status = 'queued') WHERE n = 1")
def stm_04_priorities(t: Tables) -> DataFrame:
    """The order in which a batch's jobs are taken: urgent kinds, then age."""
    rows = backlog.handle(t.jobs.filter("status = 'queued'").select("job_id", "kind", "payload", "created_at"))
    return ranks.placed(rows, backlog.order(), "place").select("kind", "payload", "place")


@_R.add("SELECT job_id, kind FROM jobs WHERE (status = 'running' AND locked_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE) OR (status = 'queued' AND run_after <= TIMESTAMP '2024-01-20 00:00:00' AND attempts < 3)")
def stm_03_reclaimed(t: Tables) -> DataFrame:
    """Jobs that a worker may take: due ones, and running ones that are lost."""
    return backlog.claimable(t.jobs, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("job_id", "kind")


@_R.add("SELECT job_id FROM (SELECT job_id, row_number() OVER (PARTITION BY CASE WHEN kind = 'update_topic' THEN 1 ELSE 0 END ORDER BY created_at, job_id) AS n, kind FROM jobs WHERE status = 'queued') WHERE n <= 30 OR kind <> 'update_topic'")
def stm_08_spend_guard(t: Tables) -> DataFrame:
    """Waiting jobs of one tick: of the costly kind thirty at most."""
    rows = t.jobs.filter("status = 'queued'")
    costly = rows.filter("kind = 'update_topic'").orderBy("created_at", "job_id").limit(30)
    return rows.filter("kind <> 'update_topic'").select("job_id").union(costly.select("job_id"))


@_R.add("SELECT claim_id FROM redirects JOIN claims USING (claim_id) WHERE hops = 0 AND merged_into IS NULL UNION SELECT DISTINCT r.claim_id FROM redirects r WHERE hops > 0")
def stm_10_fixpoint(t: Tables) -> DataFrame:
    """Claims that a loop settles, round by round, until none is left."""
    return tree.resolve_redirects(t.claims).select("claim_id").distinct()
