"""Scans, filters, projections and joins over the evidence model, second part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silexa.operators import claims as C
from silexa.operators import ranks, tree
from silexa.sources.tables import Tables

from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
NOW = "2024-01-20 00:00:00"
#: Priorities of a reader and the measures they lead to (fixed values).
LEVERS = {"sleep": ("light", "timing"), "weight": ("protein", "walking", "timing"), "heart": ("walking", "salt"), "mood": ("light", "walking")}
TIERS = ("free", "annual", "lifetime")


@_R.add("SELECT claim_id, statement FROM claims ORDER BY claim_id LIMIT 25 OFFSET 50")
def scan_02_page(t: Tables) -> DataFrame:
    """The third page of 25 rows in a fixed order."""
    return t.claims.orderBy("claim_id").select("claim_id", "statement").offset(50).limit(25)


@_R.add("SELECT topic_id, name FROM topics WHERE topic_id = 'N7'")
def scan_05_point(t: Tables) -> DataFrame:
    """At most one row by its key; more than one is an error."""
    rows = t.topics.filter("topic_id = 'N7'").select("topic_id", "name").limit(2)
    n = F.count(F.lit(1)).over(Window.partitionBy("topic_id"))
    return rows.withColumn("n", F.when(n > 1, F.raise_error(F.lit("more than one row"))).otherwise(n)).filter("n = 1").drop("n")


@_R.add("SELECT claim_id FROM claims WHERE contains(lower(statement || ' ' || coalesce(evidence, '') || ' ' || coalesce(actionability, '')), 'ring e')")
def fil_03_contains(t: Tables) -> DataFrame:
    """A literal phrase anywhere in the joined text columns."""
    joined = F.concat(F.col("statement"), F.lit(" "), F.coalesce("evidence", F.lit("")), F.lit(" "), F.coalesce("actionability", F.lit("")))
    return t.claims.filter(F.contains(F.lower(joined), F.lower(F.trim(F.lit(" Ring E "))))).select("claim_id")


@_R.add("SELECT (SELECT count(*) FROM filings WHERE topic_id IN (SELECT topic_id FROM topics WHERE name = 'no such topic')) AS of_unknown, (SELECT count(*) FROM filings WHERE topic_id IN (SELECT topic_id FROM topics WHERE name = 'NATION_3')) AS of_known")
def fil_04_unknown_value(t: Tables) -> DataFrame:
    """A filter value that no topic has keeps nothing, instead of being ignored."""
    kept = lambda name: t.filings.join(t.topics.filter(F.col("name") == name), "topic_id", "left_semi").select(F.lit(name).alias("name"))
    return kept("no such topic").union(kept("NATION_3")).agg(F.count_if(F.col("name") == "no such topic").alias("of_unknown"), F.count_if(F.col("name") == "NATION_3").alias("of_known"))


@_R.add("SELECT claim_id, audience = 'Both' OR audience = 'Patient' AS patient, audience = 'Both' OR audience = 'Clinician' AS other FROM claims")
def fil_05_audience(t: Tables) -> DataFrame:
    """Who may read a claim: patients, or any other named audience."""
    return t.claims.select("claim_id", C.for_audience(F.col("audience"), "patient").alias("patient"), C.for_audience(F.col("audience"), "anyone").alias("other"))


@_R.add("SELECT claim_id, statement FROM claims WHERE status = 'active'")
def fil_06_active(t: Tables) -> DataFrame:
    """Active claims."""
    return t.claims.filter("status = 'active'").select("claim_id", "statement")


@_R.add("""SELECT kind, payload, min(job_id) AS first_job, count(*)::BIGINT AS n FROM jobs WHERE status IN ('queued', 'running') AND CAST(json_extract_string(payload, '$.source_id') AS BIGINT) < 20 GROUP BY 1, 2""")
def fil_08_same_payload(t: Tables) -> DataFrame:
    """Live jobs whose payload has a source below 20, once for each serialised payload."""
    live = t.jobs.filter(F.col("status").isin("queued", "running")).filter(F.get_json_object("payload", "$.source_id").cast("long") < 20)
    return live.groupBy("kind", "payload").agg(F.min("job_id").alias("first_job"), F.count(F.lit(1)).alias("n"))


@_R.add("SELECT claim_id, importance IS NULL AS unrated, merged_into IS NOT NULL AS merged, evidence IS DISTINCT FROM 'RCT' AS not_rct FROM claims WHERE importance IS DISTINCT FROM 3")
def fil_09_nulls(t: Tables) -> DataFrame:
    """Null tests and comparisons that treat null as a value."""
    return t.claims.filter(~F.col("importance").eqNullSafe(3)).select("claim_id", F.col("importance").isNull().alias("unrated"), F.col("merged_into").isNotNull().alias("merged"), (~F.col("evidence").eqNullSafe("RCT")).alias("not_rct"))


@_R.add(f"""SELECT c_custkey AS member_id, CASE WHEN c_custkey % 3 = 2 THEN true WHEN TIMESTAMP '{NOW}' > TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_custkey % 40 AS INTEGER)) THEN false ELSE c_custkey % 3 >= 1 END AS allowed FROM customer""", model=False)
def fil_12_access(t: Tables) -> DataFrame:
    """Whether a member's tier opens a feature for the second tier: the last tier never expires, others do."""
    rank = F.col("c_custkey") % len(TIERS)
    expires = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval((F.col("c_custkey") % 40).cast("int"))
    return t.raw("customer").select(F.col("c_custkey").alias("member_id"), F.when(rank == len(TIERS) - 1, True).when(F.lit(NOW).cast("timestamp") > expires, False).otherwise(rank >= 1).alias("allowed"))


@_R.add(r"""SELECT work_id FROM works WHERE doi IS NOT NULL OR len(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: length(w) > 3)) >= 3 OR (relevance > 400 AND year IS NOT NULL)""")
def fil_13_worth_resolving(t: Tables) -> DataFrame:
    """Works with an identifier, a telling title, or a journal and a year."""
    from silexa.functions.text import normal_title

    telling = F.size(F.filter(F.split(normal_title(F.col("title")), " "), lambda w: F.length(w) > 3)) >= 3
    return t.works.filter(F.col("doi").isNotNull() | telling | ((F.col("relevance") > 400) & F.col("year").isNotNull())).select("work_id")


@_R.add("SELECT claim_id, statement FROM claims WHERE NOT regexp_matches(statement, '^(red|small) ', 'i') AND NOT regexp_matches(statement, 'bolt|ring$', 'i')")
def fil_14_exclusions(t: Tables) -> DataFrame:
    """Rows that no exclusion pattern fits."""
    return t.claims.filter(~F.rlike("statement", F.lit("(?i)^(red|small) ")) & ~F.rlike("statement", F.lit("(?i)bolt|ring$"))).select("claim_id", "statement")


@_R.add("SELECT job_id, coalesce(s.title, t.name) AS target FROM jobs j LEFT JOIN sources s ON s.source_id = j.source_id AND j.kind <> 'update_topic' LEFT JOIN topics t ON t.topic_id = 'N' || j.source_id AND j.kind = 'update_topic'")
def prj_03_job_targets(t: Tables) -> DataFrame:
    """What a job works on: the source's title, else the topic's name, else nothing."""
    named = t.sources.select("source_id", "title")
    topics = t.topics.select(F.col("topic_id").alias("_topic"), "name")
    jobs = t.jobs.withColumn("_source", F.when(F.col("kind") != "update_topic", F.col("source_id"))).withColumn("_of", F.when(F.col("kind") == "update_topic", F.concat(F.lit("N"), "source_id")))
    rows = jobs.join(named.withColumnRenamed("source_id", "_s"), F.col("_source") == F.col("_s"), "left").join(topics, F.col("_of") == F.col("_topic"), "left")
    return rows.select("job_id", F.coalesce("title", "name").alias("target"))


@_R.add("SELECT insight_id, source_id, importance, evidence, located_at FROM insights WHERE importance = 3")
def prj_04_flatten(t: Tables) -> DataFrame:
    """Fields of nested records as columns."""
    nested = t.insights.select("insight_id", F.struct("source_id", F.struct("importance", "evidence").alias("facets"), F.struct("located_at").alias("quote")).alias("record"))
    return nested.filter("record.facets.importance = 3").select("insight_id", "record.source_id", "record.facets.importance", "record.facets.evidence", "record.quote.located_at")


@_R.add("""SELECT c_custkey AS member_id, array_to_string(list_distinct_ordered, ',') AS levers FROM (SELECT c_custkey, list_transform(list_filter(range(len(l)), lambda i: list_position(l, l[i + 1]) = i + 1), lambda i: l[i + 1]) AS list_distinct_ordered FROM (
 SELECT c_custkey, list_concat(CASE c_custkey % 4 WHEN 0 THEN ['light', 'timing'] WHEN 1 THEN ['protein', 'walking', 'timing'] WHEN 2 THEN ['walking', 'salt'] ELSE ['light', 'walking'] END,
   CASE c_custkey % 3 WHEN 0 THEN ['light', 'timing'] WHEN 1 THEN ['protein', 'walking', 'timing'] ELSE ['walking', 'salt'] END) AS l FROM customer))""", model=False)
def prj_05_levers(t: Tables) -> DataFrame:
    """Each member's two priorities expanded to measures, each once, in the order in which they first come."""
    names = F.array(*[F.lit(x) for x in LEVERS])
    levers = F.create_map(*[x for k, v in LEVERS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    chosen = F.array(*[F.get(names, (F.col("c_custkey") % n).cast("int")) for n in (4, 3)])
    return t.raw("customer").select(F.col("c_custkey").alias("member_id"), F.array_join(F.array_distinct(F.flatten(F.transform(chosen, lambda k: levers[k]))), ",").alias("levers"))


@_R.add("SELECT i.insight_id, i.claim_id, c.statement, coalesce(busy, false) AS busy FROM insights i LEFT JOIN claims c USING (claim_id) LEFT JOIN (SELECT DISTINCT source_id, true AS busy FROM jobs WHERE status IN ('queued', 'running')) USING (source_id) WHERE source_id = 3")
def prj_06_source_page(t: Tables) -> DataFrame:
    """A source's insights with their claims, and whether a job of the source is waiting or running."""
    busy = t.jobs.filter(F.col("status").isin("queued", "running")).select("source_id").distinct().withColumn("busy", F.lit(True))
    rows = t.insights.filter("source_id = 3").join(t.claims.select("claim_id", "statement"), "claim_id", "left").join(busy, "source_id", "left")
    return rows.select("insight_id", "claim_id", "statement", F.coalesce("busy", F.lit(False)).alias("busy"))


@_R.add("SELECT m.claim_id, m.insight_id, c.statement FROM members m JOIN claims c USING (claim_id)")
def join_01_members(t: Tables) -> DataFrame:
    """Members with the claim they belong to."""
    return t.members.join(t.claims, "claim_id").select("claim_id", "insight_id", "statement")


@_R.add("SELECT claim_id, max(date) AS newest FROM members JOIN sources USING (source_id) GROUP BY 1")
def join_02_newest_source(t: Tables) -> DataFrame:
    """Date of each claim's newest source: the per-claim subquery as one join and one grouping."""
    return t.members.select("claim_id", "source_id").distinct().join(t.sources.select("source_id", "date"), "source_id").groupBy("claim_id").agg(F.max("date").alias("newest"))


@_R.add("SELECT m.claim_id, m.insight_id, m.matched_by, s.title, s.date FROM members m LEFT JOIN sources s USING (source_id) WHERE m.claim_id IN (5, 6, 7)")
def join_04_drill_down(t: Tables) -> DataFrame:
    """From claims to their members and the members' sources."""
    return t.members.filter(F.col("claim_id").isin(5, 6, 7)).join(t.sources, "source_id", "left").select("claim_id", "insight_id", "matched_by", "title", "date")


@_R.add("SELECT f.topic_id, f.claim_id FROM filings f JOIN claims c USING (claim_id) WHERE c.status = 'active' AND c.evidence = 'RCT'")
def join_05_inner_filter(t: Tables) -> DataFrame:
    """Filings of those claims only that pass a filter of their own."""
    return t.filings.join(t.claims.filter("status = 'active' AND evidence = 'RCT'"), "claim_id").select("topic_id", "claim_id")


_MEMBER_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


@_R.add("""WITH members AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS nth FROM lineitem WHERE l_quantity < 48)
SELECT concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, strftime(l.l_shipdate, '%Y%m%d')) AS insight_id, CASE WHEN nth = 1 THEN 'seed' WHEN m.l_returnflag = 'A' THEN 'auto' WHEN nth IS NOT NULL THEN 'human' END AS matched_by, nth IS NOT NULL AS filed
FROM lineitem l LEFT JOIN members m ON m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber AND m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey AND m.l_shipdate = l.l_shipdate""", model=False)
def join_06_membership(t: Tables) -> DataFrame:
    """Every insight with its membership, if any, joined by the columns of its key."""
    rows = t.raw("lineitem")
    order = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    by = F.when(F.row_number().over(order) == 1, "seed").when(F.col("l_returnflag") == "A", "auto").otherwise("human")
    members = rows.filter("l_quantity < 48").select(*_MEMBER_KEY, by.alias("matched_by"))
    own = rows.select(*_MEMBER_KEY).join(members, list(_MEMBER_KEY), "left")
    name = F.concat_ws("-", *_MEMBER_KEY[:4], F.date_format("l_shipdate", "yyyyMMdd"))
    return own.select(name.alias("insight_id"), "matched_by", F.col("matched_by").isNotNull().alias("filed"))


@_R.add("SELECT review_id, c.statement AS claim, k.statement AS candidate, verdict FROM reviews r JOIN claims c ON c.claim_id = r.claim_id JOIN claims k ON k.claim_id = r.candidate_id WHERE r.status = 'pending'")
def join_07_review_pairs(t: Tables) -> DataFrame:
    """Pending reviews with both statements: one table joined twice."""
    one, two = t.claims.select("claim_id", F.col("statement").alias("claim")), t.claims.select(F.col("claim_id").alias("candidate_id"), F.col("statement").alias("candidate"))
    return t.reviews.filter("status = 'pending'").join(one, "claim_id").join(two, "candidate_id").select("review_id", "claim", "candidate", "verdict")


@_R.add("SELECT l.slug, t.topic_id, l.place FROM (VALUES ('nation_1', 1), ('nation_5', 2), ('no such', 3), ('nation_9', 4)) l(slug, place) JOIN topics t ON lower(t.name) = l.slug AND t.status = 'active'")
def join_08_lookup(t: Tables) -> DataFrame:
    """A configured list against topics; entries without a topic drop out. The list is a handful of rows."""
    levers = t.spark.createDataFrame([("nation_1", 1), ("nation_5", 2), ("no such", 3), ("nation_9", 4)], "slug string, place int")
    return t.topics.filter("status = 'active'").join(F.broadcast(levers), F.lower("name") == F.col("slug")).select("slug", "topic_id", "place")


@_R.add("""SELECT conv_id, chunk, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT conv_id, c AS chunk, c * 500 AS a, c * 500 + 500 AS b FROM (SELECT conv_id, max(char_end) AS n FROM captions GROUP BY 1), range(0, 1000) r(c) WHERE c * 500 < n) k JOIN captions USING (conv_id)
 WHERE char_end > a AND char_start < b GROUP BY 1, 2""")
def join_10_chunk_times(t: Tables) -> DataFrame:
    """Times of each stretch of 500 characters: the captions that overlap it. A caption meets the stretches it touches by their number, so the join is an equality."""
    touched = F.sequence(F.floor(F.col("char_start") / 500), F.floor((F.col("char_end") - 1) / 500))
    return t.captions.select("conv_id", "start_ms", "end_ms", F.explode(touched).alias("chunk")).groupBy("conv_id", "chunk").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@_R.add("SELECT f.topic_id, f.claim_id, f.filed_at FROM filings f JOIN (SELECT topic_id, max(snapshot_at) AS at FROM articles WHERE audience = 'clinician' GROUP BY 1) s USING (topic_id) WHERE f.filed_at > s.at")
def join_11_since_snapshot(t: Tables) -> DataFrame:
    """Filings behind their topic's snapshot: equality with a residual comparison."""
    at = t.articles.filter("audience = 'clinician'").groupBy("topic_id").agg(F.max("snapshot_at").alias("at"))
    return t.filings.join(at, "topic_id").filter(F.col("filed_at") > F.col("at")).select("topic_id", "claim_id", "filed_at")


@_R.add("SELECT a.topic_id, b.topic_id AS child_id, c.topic_id AS grandchild_id FROM topics a JOIN topics b ON b.parent_id = a.topic_id LEFT JOIN topics c ON c.parent_id = b.topic_id WHERE a.parent_id IS NULL")
def join_12_levels(t: Tables) -> DataFrame:
    """The tree's levels by joining the table with itself."""
    at = lambda name: t.topics.select(F.col("topic_id").alias(name), F.col("parent_id").alias(f"of_{name}"))
    rows = t.topics.filter("parent_id IS NULL").select("topic_id").join(at("child_id"), F.col("topic_id") == F.col("of_child_id"))
    return rows.join(at("grandchild_id"), F.col("child_id") == F.col("of_grandchild_id"), "left").select("topic_id", "child_id", "grandchild_id")


@_R.add("SELECT claim_id FROM claims c WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM members m WHERE m.claim_id = c.claim_id AND m.importance = 1 AND m.matched_by = 'auto')")
def join_15_not_exists(t: Tables) -> DataFrame:
    """Active claims to which no minor insight was attached automatically."""
    return t.claims.filter("status = 'active'").join(t.members.filter("importance = 1 AND matched_by = 'auto'"), "claim_id", "left_anti").select("claim_id")


@_R.add("SELECT source_id, title FROM sources s WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.status = 'running' AND j.kind = 'refs' AND CAST(json_extract_string(j.payload, '$.source_id') AS BIGINT) = s.source_id)")
def join_16_no_live_job(t: Tables) -> DataFrame:
    """Sources that no running job for references names in its payload."""
    live = t.jobs.filter("status = 'running' AND kind = 'refs'").select(F.get_json_object("payload", "$.source_id").cast("long").alias("source_id"))
    return t.sources.join(live, "source_id", "left_anti").select("source_id", "title")


@_R.add("SELECT DISTINCT claim_id, work_id FROM mentions WHERE claim_id IS NOT NULL")
def join_19_claim_works(t: Tables) -> DataFrame:
    """Works of each claim: those cited where its insights were found."""
    return t.mentions.join(t.members.select("insight_id", F.col("claim_id").alias("own")), "insight_id").filter("own = claim_id").select("claim_id", "work_id").distinct()


@_R.add("SELECT p.claim_id AS episode, min(c.page_id) AS page_id FROM claims p JOIN pages c ON c.page_id % 50 = p.claim_id % 50 WHERE p.claim_id NOT IN (SELECT source_id FROM sources) GROUP BY 1")
def join_21_plan(t: Tables) -> DataFrame:
    """Planned episodes that are not there yet, each with the first page of its number."""
    first = t.raw("pages").groupBy((F.col("page_id") % 50).alias("number")).agg(F.min("page_id").alias("page_id"))
    plan = t.claims.select(F.col("claim_id").alias("episode")).join(t.sources.select(F.col("source_id").alias("episode")), "episode", "left_anti")
    return plan.join(first, F.col("episode") % 50 == F.col("number")).select("episode", "page_id")


@_R.add("SELECT item, human, judge FROM rulings WHERE judge IS NOT NULL")
def join_22_gold_and_run(t: Tables) -> DataFrame:
    """Gold verdicts with a run's verdicts; items without one, and failed ones, drop out."""
    gold, run = t.rulings.select("item", "human"), t.rulings.select("item", "judge").filter("judge IS NOT NULL")
    return gold.join(run, "item")


@_R.add("""WITH p AS (SELECT c_custkey AS proposal_id, list_transform(range(7), lambda i: (c_custkey * 3 + i * i) % 150) AS ids FROM customer),
u AS (SELECT proposal_id, unnest(ids[1:5]) AS id, unnest(range(1, 6)) AS pos FROM p) SELECT proposal_id, string_agg(p_name, '; ' ORDER BY pos) AS statements FROM u JOIN part ON p_partkey = id GROUP BY 1""", model=False)
def join_23_array_lookup(t: Tables) -> DataFrame:
    """Statements of a proposal's first five claims, in the order of the array."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (F.col("c_custkey") * 3 + i * i) % 150)
    rows = t.raw("customer").select(F.col("c_custkey").alias("proposal_id"), F.posexplode(F.slice(ids, 1, 5)).alias("pos", "claim_id"))
    rows = rows.join(t.claims.select("claim_id", "statement"), "claim_id")
    return rows.groupBy("proposal_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "statement"))), lambda x: x["statement"]), "; ").alias("statements"))


@_R.add("SELECT root_id, topic_id FROM closure")
def rec_02_closure(t: Tables) -> DataFrame:
    """Every topic with all active topics below it."""
    return tree.closure(t.topics).select("root_id", "topic_id")


@_R.add(""", up(topic_id, ancestor_id) AS (SELECT topic_id, topic_id FROM topics UNION ALL SELECT u.topic_id, t.parent_id FROM up u JOIN topics t ON t.topic_id = u.ancestor_id WHERE t.parent_id IS NOT NULL),
moves AS (SELECT a.topic_id, b.topic_id AS new_parent_id FROM topics a JOIN topics b ON (length(a.name) * 7 + length(b.name)) % 5 = 1)
SELECT topic_id, new_parent_id, EXISTS (SELECT 1 FROM up WHERE up.topic_id = new_parent_id AND up.ancestor_id = moves.topic_id) AS cycle FROM moves""")
def rec_04_cycles(t: Tables) -> DataFrame:
    """Whether a topic may be moved below another one without closing a loop."""
    other = t.topics.select(F.col("topic_id").alias("new_parent_id"), F.length("name").alias("b"))
    moves = t.topics.join(other, (F.length("name") * 7 + F.col("b")) % 5 == 1).select("topic_id", "new_parent_id")
    return tree.makes_cycle(t.topics, moves)


@_R.add("SELECT p.topic_id, p.name, coalesce(string_agg(c.name, ',' ORDER BY c.name), '') AS children FROM topics p LEFT JOIN topics c ON c.parent_id = p.topic_id AND c.status = 'active' WHERE p.status = 'active' GROUP BY 1, 2")
def rec_05_menu(t: Tables) -> DataFrame:
    """Each topic with its children, sorted."""
    active = t.topics.filter("status = 'active'")
    own = active.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("children"))
    return active.join(own.withColumnRenamed("parent_id", "_p"), F.col("topic_id") == F.col("_p"), "left").select("topic_id", "name", F.coalesce("children", F.lit("")).alias("children"))


@_R.add("SELECT r.claim_id, CASE WHEN c.status = 'active' THEN r.at_id END AS survivor FROM redirects r JOIN claims c ON c.claim_id = r.at_id WHERE c.merged_into IS NULL AND r.hops > 0")
def rec_07_survivors(t: Tables) -> DataFrame:
    """Merged claims and what is left of them."""
    return tree.resolve_redirects(t.claims).filter("hops > 0").select("claim_id", F.col("target_id").alias("survivor"))


@_R.add(", edges AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM links WHERE a <> b) SELECT a AS claim_id FROM edges UNION SELECT b FROM edges")
def rec_08_linked(t: Tables) -> DataFrame:
    """Claims at either end of a near-duplicate edge."""
    edges = C.near_duplicate_edges(t.links)
    return edges.select("claim_id").union(edges.select("related_claim_id")).distinct()


@_R.add(""", path(topic_id, depth, place) AS (SELECT topic_id, 0, name || '#' || topic_id FROM topics WHERE parent_id IS NULL UNION ALL SELECT t.topic_id, depth + 1, place || '/' || t.name || '#' || t.topic_id FROM path p JOIN topics t ON t.parent_id = p.topic_id)
SELECT topic_id, depth, row_number() OVER (ORDER BY place)::BIGINT AS nth FROM path""")
def rec_09_listing(t: Tables) -> DataFrame:
    """The tree as a list, each topic before its children; topics in no tree come last at depth 0."""
    up = tree.ancestors(t.topics).join(t.topics.select(F.col("topic_id").alias("ancestor_id"), "name", F.col("parent_id").isNull().alias("top")), "ancestor_id")
    path = up.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.concat("name", F.lit("#"), "ancestor_id").alias("n")))).alias("p"), F.max("top").alias("rooted"))
    rows = path.select("topic_id", F.when(F.col("rooted"), F.size("p") - 1).otherwise(0).alias("depth"), (~F.col("rooted")).alias("loose"), F.array_join(F.transform("p", lambda x: x["n"]), "/").alias("place"))
    return ranks.placed(rows, [F.col("loose"), F.col("place")], "nth").select("topic_id", "depth", "nth")


@_R.add("SELECT topic_id FROM closure WHERE root_id IN ('R0', 'R2') GROUP BY 1")
def set_01_union(t: Tables) -> DataFrame:
    """Topics under either of two roots, each once."""
    return tree.closure(t.topics, t.topics.filter(F.col("topic_id").isin("R0", "R2"))).select("topic_id").distinct()


@_R.add("SELECT claim_id FROM claims WHERE status = 'active' EXCEPT SELECT claim_id FROM flags EXCEPT SELECT claim_id FROM reviews")
def set_02_difference(t: Tables) -> DataFrame:
    """Active claims that are neither flagged nor under review."""
    return t.claims.filter("status = 'active'").select("claim_id").subtract(t.flags.select("claim_id")).subtract(t.reviews.select("claim_id"))


@_R.add("SELECT claim_id FROM filings WHERE topic_id LIKE 'N1%' INTERSECT SELECT claim_id FROM members WHERE importance = 3")
def set_03_intersection(t: Tables) -> DataFrame:
    """Claims under some topics that also have a core member."""
    return t.filings.filter(F.startswith("topic_id", F.lit("N1"))).select("claim_id").intersect(t.members.filter("importance = 3").select("claim_id"))


@_R.add("SELECT DISTINCT claim_id FROM filings WHERE topic_id IN ('N2', 'N3', 'N4')")
def set_04_distinct(t: Tables) -> DataFrame:
    """Claims of several topics, each once."""
    return t.filings.filter(F.col("topic_id").isin("N2", "N3", "N4")).select("claim_id").distinct()


@_R.add("""SELECT key, origin, work_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY origin, work_id) AS n FROM (
 SELECT coalesce(lower(doi), lower(title)) AS key, 1 AS origin, work_id FROM works WHERE relevance > 450 UNION ALL SELECT coalesce(lower(doi), lower(title)), 2, work_id FROM works WHERE relevance < 20)) WHERE n = 1""")
def set_05_first_list_wins(t: Tables) -> DataFrame:
    """Two lists of candidates one behind the other, each key once, the first list's row before the second's."""
    key = F.coalesce(F.lower("doi"), F.lower("title"))
    pick = lambda where, n: t.works.filter(where).select(key.alias("key"), F.lit(n).alias("origin"), "work_id")
    rows = pick("relevance > 450", 1).unionByName(pick("relevance < 20", 2))
    return rows.groupBy("key").agg(F.min(F.struct("origin", "work_id")).alias("r")).select("key", "r.origin", "r.work_id")
