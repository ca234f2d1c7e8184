"""Queries written in SQL through the library's functions, the stored index, and windows over event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silexa.functions import sql
from silexa.operators import claims as C
from silexa.operators import index, tree, vector
from silexa.session import checkpointed, shared_folder
from silexa.sources.tables import Tables
from silexa.streaming import windows

from .evidence import _SCORED, AS_OF, ROOT
from .registry import Registry

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

#: Share of the lists that a search reads: the given vectors have hardly any clusters, so most lists hold some of the nearest.
PROBED = 0.7


def _index(t: Tables) -> index.Index:
    path = f"{shared_folder(t.spark)}/index/{uuid.uuid4().hex}"
    index.build(t.raw("embeddings").select("vec_id", "embedding"), path)
    return index.Index(t.spark, path)


def _asked(t: Tables) -> DataFrame:
    return t.raw("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@_R.add()
def vec_07_approximate(t: Tables) -> DataFrame:
    """Nearest vectors of each query through a stored index, from the nearest lists alone."""
    stored = _index(t)
    return stored.search(_asked(t), 0.2, 10, max(1, round(PROBED * len(stored.centres))))


_NEAR = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, d.vec_id, list_cosine_similarity(d.e, q.e) AS exact FROM v d JOIN v q ON q.vec_id % 50 = 0)"


@_R.add(f"WITH {_NEAR} SELECT query_id, vec_id, similarity, nth::INTEGER AS nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS nth FROM (SELECT query_id, vec_id, round(exact, 6) AS similarity FROM p WHERE exact >= 0.25 AND query_id <> vec_id)) WHERE nth <= 6", model=False)
def vec_07_all_lists(t: Tables) -> DataFrame:
    """The same index with all lists read: exact."""
    stored = _index(t)
    return stored.search(_asked(t), 0.25, 6, len(stored.centres)).withColumn("nth", F.col("nth").cast("int"))


@_R.add(f"WITH {_NEAR} SELECT query_id, vec_id, similarity, nth::INTEGER AS nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS nth FROM (SELECT query_id, vec_id, round(exact, 6) AS similarity FROM p WHERE exact >= 0.2)) WHERE nth <= 5", model=False)
def udf_01_match_vectors(t: Tables) -> DataFrame:
    """A table function joined LATERAL: the nearest vectors of every query, itself included. All queries are matched in blocks; the function looks up its own."""
    vectors = t.raw("embeddings").select("vec_id", "embedding")
    sql.register_tables(t.spark, vectors=vectors, matches=vector.match(vectors, _asked(t), 0.2, 5, itself=True))
    return t.spark.sql("SELECT q.vec_id AS query_id, m.vec_id, m.similarity, m.nth FROM vectors q, LATERAL nearest_to(q.vec_id, 5) m WHERE q.vec_id % 50 = 0")


def _views(t: Tables) -> None:
    number = F.substring("topic_id", 2, 9).cast("int")
    nations = t.topics.filter(F.rlike("topic_id", F.lit("^N[0-9]+$"))).filter(number % 5 > 0)
    snapshots = nations.select("topic_id", (F.lit("1995-06-01 00:00:00").cast("timestamp") + F.make_dt_interval(number * 30)).alias("snapshot_at"))
    sql.register_tables(t.spark, claims_scored=C.scored(t.claims, t.members, t.sources, AS_OF), topics=t.topics, topic_closure=checkpointed(tree.closure(t.topics)), filings=t.filings, claims=t.claims, snapshots=snapshots)


@_R.add(f""", {_SCORED}
SELECT claim_id, statement, source_count, score FROM scored
WHERE status = 'active' AND (audience = 'Both' OR audience = 'Patient') AND claim_id IN (SELECT claim_id FROM filings JOIN closure USING (topic_id) WHERE root_id = '{ROOT}')
ORDER BY score DESC, source_count DESC, claim_id LIMIT 40 OFFSET 10""")
def udf_02_topic_claims(t: Tables) -> DataFrame:
    """A topic's ranked claims as a table function."""
    _views(t)
    return t.spark.sql(f"SELECT * FROM topic_claims('{ROOT}', 'patient', 40, 10)")


@_R.add("""SELECT t.topic_id, c.claim_id FROM topics t JOIN (SELECT root_id, claim_id, row_number() OVER (PARTITION BY root_id ORDER BY score DESC, source_count DESC, claim_id) AS nth FROM (SELECT DISTINCT root_id, claim_id FROM filings JOIN closure USING (topic_id)) JOIN scored USING (claim_id) WHERE status = 'active') c ON c.root_id = t.topic_id AND nth <= 3 WHERE t.status = 'active' AND t.topic_id LIKE 'R%'""".replace("SELECT t.topic_id", f", {_SCORED}\nSELECT t.topic_id", 1))
def udf_02_topic_claims_lateral(t: Tables) -> DataFrame:
    """The three best claims of each region, one call a row."""
    _views(t)
    return t.spark.sql("SELECT t.topic_id, c.claim_id FROM topics t, LATERAL topic_claims(t.topic_id, NULL, 3, 0) c WHERE t.topic_id LIKE 'R%'")


@_R.add("""SELECT doc_id, substr(regexp_replace(regexp_replace(trim(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS title, CAST(len(regexp_split_to_array(trim(text), '[ \\t\\n\\r]+')) AS BIGINT) AS words,
 array_to_string(regexp_extract_all(regexp_replace(regexp_replace(text, '([0-9]),([0-9]{3})', '\\1\\2', 'g'), '([0-9]),([0-9]{3})', '\\1\\2', 'g'), '[0-9]+(?:\\.[0-9]+)?'), '|') AS numbers, '"' || replace(coalesce(text, ''), '"', '""') || '"' AS cell, CASE WHEN n_chars = 0 THEN 0 ELSE floor(CAST(100 AS DOUBLE) * doc_id / n_chars + 0.5)::BIGINT END AS pct FROM documents""", model=False)
def udf_03_scalars(t: Tables) -> DataFrame:
    """Scalar functions called from SQL over whole texts."""
    sql.register_tables(t.spark, documents_view=t.raw("documents"))
    return t.spark.sql("SELECT doc_id, slugify(text) AS slug, normalize_title(text) AS title, word_count(text) AS words, array_join(number_literals(text), '|') AS numbers, csv_cell(text) AS cell, percent(doc_id, n_chars) AS pct FROM documents_view")


@_R.add("""SELECT s.topic_id, count(DISTINCT f.claim_id)::BIGINT AS new_claims FROM (SELECT topic_id, TIMESTAMP '1995-06-01 00:00:00' + to_days(CAST(substr(topic_id, 2) AS INTEGER) * 30) AS snapshot_at FROM topics WHERE topic_id NOT LIKE '%-%' AND topic_id LIKE 'N%' AND CAST(substr(topic_id, 2) AS INTEGER) % 5 > 0) s JOIN closure c ON c.root_id = s.topic_id JOIN filings f ON f.topic_id = c.topic_id AND f.filed_at > s.snapshot_at JOIN claims k ON k.claim_id = f.claim_id AND k.status = 'active' GROUP BY 1""")
def udf_04_stale_topics(t: Tables) -> DataFrame:
    """Stale topics as a table function."""
    _views(t)
    return t.spark.sql("SELECT * FROM stale_topics()")


def _events(t: Tables, build: windows.Build, mode: str) -> DataFrame:
    """What a stream over the events, in files by time, has written after two starts."""
    base = f"{shared_folder(t.spark)}/events/{uuid.uuid4().hex}"
    events = t.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", "value")
    low, middle, high = (F.lit(x).cast("timestamp") for x in _thirds(events))
    for n, part in enumerate((F.col("at") <= low, (F.col("at") > low) & (F.col("at") <= middle), (F.col("at") > middle) & (F.col("at") <= high), F.col("at") > high)):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if n in (1, 3):
            windows.follow(t.spark, f"{base}/in", f"{base}/out", f"{base}/check", events.schema, build, mode)
    return t.spark.read.parquet(f"{base}/out")


def _thirds(events: DataFrame) -> list[str]:
    cuts = events.select(F.col("at").cast("double").alias("x")).approxQuantile("x", [0.25, 0.5, 0.75], 0.01)
    return [str(r[0]) for r in events.sparkSession.createDataFrame([(c,) for c in cuts], "x double").select(F.col("x").cast("timestamp").cast("string")).collect()]


@_R.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", model=False)
def stm_11_tumbling(t: Tables) -> DataFrame:
    """Events and values by hour and kind, from a stream's updates."""
    out = windows.latest(_events(t, windows.per_window("at", "event_type", "1 hour", late="10 minutes", value="value"), "update"), "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_R.add("SELECT s AS start, event_type, count(*)::BIGINT AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 4 HOUR]) AS s FROM events) GROUP BY 1, 2", model=False)
def stm_12_sliding(t: Tables) -> DataFrame:
    """Events of six hours by kind, every two hours."""
    out = windows.latest(_events(t, windows.per_window("at", "event_type", "6 hours", "2 hours", late="10 minutes"), "update"), "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@_R.add("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS ended, count(*)::BIGINT AS n FROM s GROUP BY user_id, k)
SELECT * FROM g WHERE ended <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""", model=False)
def stm_13_sessions(t: Tables) -> DataFrame:
    """Sessions of users, given once the watermark has passed their end."""
    out = _events(t, windows.per_session("at", "user_id", "30 minutes", late="10 minutes"), "append")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("ended"), "n")
