"""The evidence model as DataFrames, derived from the relational tables: topics, claims, insights, sources and filings.

Regions, nations and market segments form the topic tree; parts are claims, lineitems extraction records (insights), suppliers sources. ``CTES`` holds
the same derivations in SQL, for the checks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silexa.session import spread, tasks_for


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    @cached_property
    def topics(self) -> DataFrame:
        null, no = F.lit(None).cast("string"), F.lit(False)
        regions = self.raw("region").select(F.concat(F.lit("R"), "r_regionkey").alias("topic_id"), F.col("r_name").alias("name"), null.alias("parent_id"), F.lit("active").alias("status"), no.alias("is_hidden"))
        nation = F.col("n_nationkey")
        nations = self.raw("nation").select(F.concat(F.lit("N"), nation), "n_name", F.concat(F.lit("R"), "n_regionkey"), F.when(nation % 11 == 7, "archived").otherwise("active"), nation % 9 == 4)
        segments = self.raw("customer").select("c_nationkey", "c_mktsegment").distinct()
        segments = segments.select(F.concat(F.lit("N"), "c_nationkey", F.lit("-"), "c_mktsegment"), "c_mktsegment", F.concat(F.lit("N"), "c_nationkey"), F.lit("active"), no)
        return regions.union(nations).union(segments)

    @cached_property
    def claims(self) -> DataFrame:
        key, brand = F.col("p_partkey"), F.substring("p_brand", 7, 9).cast("int") % 4
        evidence = F.create_map(*[F.lit(x) for pair in EVIDENCE_OF_TYPE.items() for x in pair])
        return self.raw("part").select(
            key.alias("claim_id"),
            F.col("p_name").alias("statement"),
            F.when(key % 17 == 0, "merged").otherwise("active").alias("status"),
            F.when((key % 17 == 0) & (key > 0), F.floor(key / 17)).alias("merged_into"),
            F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4).alias("importance"),
            F.when(brand == 0, "High").when(brand == 1, "Medium").when(brand == 2, "Low").alias("actionability"),
            evidence[F.col("p_type")].alias("evidence"),
            F.when(key % 3 == 0, "Both").when(key % 3 == 1, "Patient").otherwise("Clinician").alias("audience"),
        )

    @cached_property
    def insights(self) -> DataFrame:
        """One row an insight; ``claim_id`` is null where none has been found yet."""
        order = Window.partitionBy("l_partkey", F.col("l_quantity") >= 48).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
        done = F.col("l_quantity") < 48
        rows = self.raw("lineitem").withColumn("nth", F.row_number().over(order))
        matched = F.when(F.col("nth") == 1, "seed").when(F.col("l_returnflag") == "A", "auto").otherwise("human")
        number = F.col("l_linenumber").cast("int")
        return rows.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("insight_id"),
            F.col("l_suppkey").alias("source_id"),
            F.when(done, F.col("l_partkey")).alias("claim_id"),
            F.when(done, matched).alias("matched_by"),
            F.when(number % 4 > 0, number % 4).alias("importance"),
            F.element_at(F.array(*[F.lit(x) for x in GRADES]), (F.col("l_suppkey") % len(GRADES) + 1).cast("int")).alias("evidence"),
            F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("located_at"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def members(self) -> DataFrame:
        return self.insights.filter(F.col("claim_id").isNotNull())

    @cached_property
    def sources(self) -> DataFrame:
        dates = self.raw("lineitem").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("date"))
        own = self.raw("supplier").join(dates, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        return own.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("nation"), F.when(F.col("s_suppkey") % 13 > 0, F.col("date")).alias("date"))

    @cached_property
    def filings(self) -> DataFrame:
        """(claim_id, topic_id, filed_at): a claim is filed under its sources' nations, every fourth one also under a segment."""
        where = self.sources.select("source_id", F.concat(F.lit("N"), "nation").alias("topic_id"))
        n = tasks_for(self.raw("lineitem"))
        placed = spread(self.members.select("claim_id", "source_id", "created_at"), n, "source_id").join(spread(where, n, "source_id"), "source_id")
        own = spread(placed, n, "claim_id").groupBy("claim_id", "topic_id").agg(F.min("created_at").alias("filed_at"))
        deep = own.filter(F.col("claim_id") % 4 == 0).select("claim_id", F.concat("topic_id", F.lit("-BUILDING")).alias("topic_id"), "filed_at")
        return own.union(deep)

    @cached_property
    def links(self) -> DataFrame:
        """Near-duplicate edges as raised, in either direction."""
        key = F.col("claim_id")
        one = self.claims.filter(key % 10 == 0).select(key.alias("a"), (key + 1).alias("b"))
        return one.union(one.filter("a % 20 = 0").select("b", "a")).union(one.filter("a % 50 = 0").select("a", F.col("a").alias("b")))

    @cached_property
    def jobs(self) -> DataFrame:
        """The work queue: kind, state, payload, attempts and times."""
        n, kind = F.col("event_id"), F.create_map(*[F.lit(x) for pair in JOB_OF_EVENT.items() for x in pair])
        source = F.col("user_id") % 100
        return self.raw("events").select(
            n.alias("job_id"),
            kind[F.col("event_type")].alias("kind"),
            F.when(n % 10 == 0, "failed").when(n % 10 == 1, "running").when(n % 10 < 4, "queued").otherwise("done").alias("status"),
            source.alias("source_id"),
            F.concat(F.lit('{"source_id": '), source, F.lit("}")).alias("payload"),
            (n % 4).alias("attempts"),
            F.col("ts").alias("created_at"),
            F.when(n % 10 == 1, F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("locked_at"),
            (F.col("ts") + F.make_dt_interval(F.lit(0), (n % 3).cast("int"))).alias("run_after"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        """Pairs of claims that a judge has looked at."""
        key = F.col("claim_id")
        rows = self.claims.filter(key % 10 == 3).select(key.alias("review_id"), key, (key + 1).alias("candidate_id"))
        verdict = F.when(key % 4 == 3, "SAME").when(key % 3 == 0, "DIFFERENT").otherwise("UNSURE")
        return rows.select("*", (key % 97 / 100).alias("similarity"), verdict.alias("verdict"), (key * 7 % 100 / 100).alias("confidence"), F.when(key % 20 == 13, "accepted").otherwise("pending").alias("status"))

    @cached_property
    def articles(self) -> DataFrame:
        """Versions of a topic's article by audience, with the time of the claims it was written from."""
        nation = F.col("n_nationkey")
        audience = F.explode(F.when(nation % 2 == 0, F.array(F.lit("clinician"), F.lit("patient"))).otherwise(F.array(F.lit("clinician"))))
        rows = self.raw("nation").filter(nation % 5 > 0).select(nation, audience.alias("audience"))
        rows = rows.select(nation, "audience", F.explode(F.sequence(F.lit(1), nation % 3 + 1)).alias("version"))
        at = F.lit("1995-06-01 00:00:00").cast("timestamp") + F.make_dt_interval(nation * 30 + F.col("version") * 10)
        return rows.select(F.concat(F.lit("N"), nation).alias("topic_id"), "audience", "version", F.when(nation % 7 != 3, at).alias("snapshot_at"))

    @cached_property
    def works(self) -> DataFrame:
        """Cited works; some lack year or identifier."""
        key = F.col("o_orderkey")
        title = F.concat(F.lit("Study "), F.col("o_custkey") % 50, F.lit(" of "), F.lower("o_orderpriority"))
        return self.raw("orders").select(
            key.alias("work_id"), title.alias("title"), F.when(key % 7 > 0, F.year("o_orderdate")).alias("year"), F.when(key % 3 == 0, F.concat(F.lit("10.1000/AB"), F.floor(key / 6))).alias("doi"), (F.col("o_totalprice") / 1000).alias("relevance")
        )

    @cached_property
    def mentions(self) -> DataFrame:
        """(work_id, insight_id, claim_id): works cited where an insight was found."""
        lines = self.raw("lineitem")
        rows = spread(lines, tasks_for(lines), "l_orderkey").select(F.col("l_orderkey").alias("work_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("insight_id"), F.when(F.col("l_quantity") < 48, F.col("l_partkey")).alias("claim_id"))
        return rows.join(self.works.select("work_id"), "work_id", "left_semi")

    @cached_property
    def flags(self) -> DataFrame:
        key = F.col("claim_id")
        rule = F.when(key % 3 == 0, "merge_fidelity").when(key % 3 == 1, "orphan_topic").otherwise("extraction_fidelity")
        return self.claims.filter(key % 8 == 5).select(key, rule.alias("rule"), (key % 16 == 13).alias("resolved"))

    @cached_property
    def captions(self) -> DataFrame:
        """Timed captions with the characters that each takes in its joined transcript."""
        rows = self.raw("conversations").filter(F.trim("text") != "").select("conv_id", "turn", F.trim("text").alias("text"))
        order = Window.partitionBy("conv_id").orderBy("turn")
        before = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("char_start", before).withColumn("char_end", before + F.length("text"))
        return rows.withColumn("start_ms", F.col("char_start") * 60).withColumn("end_ms", F.col("char_end") * 60)

    @cached_property
    def rulings(self) -> DataFrame:
        """(item, human, judge): a person's and a judge's verdict on the same document; a judge that failed gives none."""
        human = F.when(F.col("quality") == 1, "SAME").otherwise("DIFFERENT")
        judge = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("toxic") == 1, "DIFFERENT").when(F.col("doc_id") % 13 == 0, "UNSURE").otherwise("SAME")
        return self.raw("labels").select(F.col("doc_id").alias("item"), human.alias("human"), judge.alias("judge"), (F.col("doc_id") * 37 % 101 / 100).alias("confidence"), (F.col("doc_id") % 4 == 1).alias("enrich"))


#: Kind of job by kind of event (fixed values of the derivation).
JOB_OF_EVENT = {"view": "extract", "click": "consolidate", "signup": "tag", "purchase": "refs", "error": "update_topic"}

#: Evidence grades of insights, dealt out by source (fixed values of the derivation).
GRADES = ("MetaAnalysis", "RCT", "Cohort", "CaseSeries", "Mechanistic", "Animal", "ExpertOpinion", "Other")

#: Evidence grade by the kind of part (fixed values of the derivation).
EVIDENCE_OF_TYPE = {"PROMO": "MetaAnalysis", "STANDARD": "RCT", "LARGE": "Cohort", "SMALL": "CaseSeries", "ECONOMY": "ExpertOpinion", "MEDIUM": "Mechanistic"}

CTES = """
topics AS (
  SELECT 'R' || r_regionkey AS topic_id, r_name AS name, CAST(NULL AS VARCHAR) AS parent_id, 'active' AS status, false AS is_hidden FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey, CASE WHEN n_nationkey % 11 = 7 THEN 'archived' ELSE 'active' END, n_nationkey % 9 = 4 FROM nation
  UNION ALL SELECT DISTINCT 'N' || c_nationkey || '-' || c_mktsegment, c_mktsegment, 'N' || c_nationkey, 'active', false FROM customer),
claims AS (
  SELECT p_partkey AS claim_id, p_name AS statement, CASE WHEN p_partkey % 17 = 0 THEN 'merged' ELSE 'active' END AS status,
         CASE WHEN p_partkey % 17 = 0 AND p_partkey > 0 THEN p_partkey // 17 END AS merged_into,
         CASE WHEN p_size % 4 > 0 THEN p_size % 4 END AS importance,
         CASE CAST(substr(p_brand, 7) AS INTEGER) % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' END AS actionability,
         CASE p_type WHEN 'PROMO' THEN 'MetaAnalysis' WHEN 'STANDARD' THEN 'RCT' WHEN 'LARGE' THEN 'Cohort' WHEN 'SMALL' THEN 'CaseSeries' WHEN 'ECONOMY' THEN 'ExpertOpinion' WHEN 'MEDIUM' THEN 'Mechanistic' END AS evidence,
         CASE p_partkey % 3 WHEN 0 THEN 'Both' WHEN 1 THEN 'Patient' ELSE 'Clinician' END AS audience FROM part),
insights AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS insight_id, l_suppkey AS source_id,
         CASE WHEN l_quantity < 48 THEN l_partkey END AS claim_id,
         CASE WHEN l_quantity < 48 THEN CASE WHEN nth = 1 THEN 'seed' WHEN l_returnflag = 'A' THEN 'auto' ELSE 'human' END END AS matched_by,
         CASE WHEN l_linenumber % 4 > 0 THEN CAST(l_linenumber % 4 AS INTEGER) END AS importance,
         (['MetaAnalysis', 'RCT', 'Cohort', 'CaseSeries', 'Mechanistic', 'Animal', 'ExpertOpinion', 'Other'])[CAST(l_suppkey % 8 + 1 AS INTEGER)] AS evidence,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS located_at, l_shipdate AS created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity >= 48 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS nth FROM lineitem)),
members AS (SELECT * FROM insights WHERE claim_id IS NOT NULL),
sources AS (
  SELECT s_suppkey AS source_id, s_name AS title, s_nationkey AS nation, CASE WHEN s_suppkey % 13 > 0 THEN d END AS date
  FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey),
own_filings AS (SELECT claim_id, 'N' || nation AS topic_id, min(created_at) AS filed_at FROM members JOIN sources USING (source_id) GROUP BY 1, 2),
filings AS (SELECT * FROM own_filings UNION ALL SELECT claim_id, topic_id || '-BUILDING', filed_at FROM own_filings WHERE claim_id % 4 = 0),
raised AS (SELECT claim_id AS a, claim_id + 1 AS b FROM claims WHERE claim_id % 10 = 0),
links AS (SELECT a, b FROM raised UNION ALL SELECT b, a FROM raised WHERE a % 20 = 0 UNION ALL SELECT a, a FROM raised WHERE a % 50 = 0),
closure(root_id, topic_id, depth) AS (
  SELECT topic_id, topic_id, 0 FROM topics
  UNION ALL SELECT root_id, t.topic_id, depth + 1 FROM closure c JOIN topics t ON t.parent_id = c.topic_id WHERE t.status = 'active'),
jobs AS (
  SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'extract' WHEN 'click' THEN 'consolidate' WHEN 'signup' THEN 'tag' WHEN 'purchase' THEN 'refs' WHEN 'error' THEN 'update_topic' END AS kind,
         CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 10 = 1 THEN 'running' WHEN event_id % 10 < 4 THEN 'queued' ELSE 'done' END AS status,
         user_id % 100 AS source_id, '{"source_id": ' || (user_id % 100) || '}' AS payload, event_id % 4 AS attempts, ts AS created_at,
         CASE WHEN event_id % 10 = 1 THEN ts + INTERVAL 5 MINUTE END AS locked_at, ts + to_hours(CAST(event_id % 3 AS INTEGER)) AS run_after FROM events),
reviews AS (
  SELECT claim_id AS review_id, claim_id, claim_id + 1 AS candidate_id, CAST(claim_id % 97 AS DOUBLE) / 100 AS similarity,
         CASE WHEN claim_id % 4 = 3 THEN 'SAME' WHEN claim_id % 3 = 0 THEN 'DIFFERENT' ELSE 'UNSURE' END AS verdict, CAST(claim_id * 7 % 100 AS DOUBLE) / 100 AS confidence,
         CASE WHEN claim_id % 20 = 13 THEN 'accepted' ELSE 'pending' END AS status FROM claims WHERE claim_id % 10 = 3),
articles AS (
  SELECT 'N' || n_nationkey AS topic_id, audience, CAST(version AS INTEGER) AS version,
         CASE WHEN n_nationkey % 7 <> 3 THEN TIMESTAMP '1995-06-01 00:00:00' + to_days(CAST(n_nationkey * 30 + version * 10 AS INTEGER)) END AS snapshot_at
  FROM nation, (VALUES ('clinician'), ('patient')) a(audience), range(1, 4) v(version) WHERE n_nationkey % 5 > 0 AND (audience = 'clinician' OR n_nationkey % 2 = 0) AND version <= n_nationkey % 3 + 1),
works AS (
  SELECT o_orderkey AS work_id, 'Study ' || (o_custkey % 50) || ' of ' || lower(o_orderpriority) AS title, CASE WHEN o_orderkey % 7 > 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
         CASE WHEN o_orderkey % 3 = 0 THEN '10.1000/AB' || (o_orderkey // 6) END AS doi, o_totalprice / 1000 AS relevance FROM orders),
mentions AS (
  SELECT l_orderkey AS work_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS insight_id, CASE WHEN l_quantity < 48 THEN l_partkey END AS claim_id
  FROM lineitem WHERE l_orderkey IN (SELECT work_id FROM works)),
flags AS (
  SELECT claim_id, CASE claim_id % 3 WHEN 0 THEN 'merge_fidelity' WHEN 1 THEN 'orphan_topic' ELSE 'extraction_fidelity' END AS rule, claim_id % 16 = 13 AS resolved FROM claims WHERE claim_id % 8 = 5),
captions AS (
  SELECT *, char_start * 60 AS start_ms, char_end * 60 AS end_ms FROM (SELECT *, char_start + length(text) AS char_end FROM (
    SELECT conv_id, turn, trim(text) AS text, CAST(coalesce(sum(length(trim(text)) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
    FROM conversations WHERE trim(text) <> ''))),
rulings AS (
  SELECT doc_id AS item, CASE WHEN quality = 1 THEN 'SAME' ELSE 'DIFFERENT' END AS human,
         CASE WHEN doc_id % 11 = 0 THEN NULL WHEN toxic = 1 THEN 'DIFFERENT' WHEN doc_id % 13 = 0 THEN 'UNSURE' ELSE 'SAME' END AS judge, CAST(doc_id * 37 % 101 AS DOUBLE) / 100 AS confidence, doc_id % 4 = 1 AS enrich FROM labels),
redirects(claim_id, at_id, hops) AS (
  SELECT claim_id, claim_id, 0 FROM claims
  UNION ALL SELECT r.claim_id, c.merged_into, hops + 1 FROM redirects r JOIN claims c ON c.claim_id = r.at_id WHERE c.merged_into IS NOT NULL AND hops < 20)
"""
