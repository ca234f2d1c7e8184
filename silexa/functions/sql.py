"""Functions for those who write SQL: scalar ones over text, and table functions that a query can join LATERAL.

All are SQL functions of the session, so the optimizer sees through them and no Python runs for a row. ``register`` makes the scalar ones; ``register_tables`` makes temporary views of the model and the
table functions over them. ``match_vectors`` reads all vectors for one given vector; for the vectors of a table ``nearest_to`` is joined LATERAL, which becomes a join with the view ``matches``
(what ``vector.match`` gives). The scalar ones mean the same as the Column functions of ``functions.text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name with arguments, type, and body.
SCALARS = (
    ("slugify(s STRING)", "STRING", r"substring(regexp_replace(regexp_replace(trim(lower(s)), r'[^a-z0-9]+', '-'), r'^-+|-+$', ''), 1, 60)"),
    ("normalize_title(s STRING)", "STRING", r"trim(regexp_replace(regexp_replace(lower(s), r'[^a-z0-9 ]', ' '), ' +', ' '))"),
    ("fingerprint(doi STRING, title STRING, year INT)", "STRING", r"CASE WHEN doi IS NOT NULL THEN concat('doi:', lower(doi)) ELSE concat('t:', trim(regexp_replace(regexp_replace(lower(title), r'[^a-z0-9 ]', ' '), ' +', ' ')), coalesce(concat(':', year), '')) END"),
    ("word_count(s STRING)", "BIGINT", r"CAST(coalesce(size(split(trim(s), r'[ \t\n\r]+')), 0) AS BIGINT)"),
    ("number_literals(s STRING)", "ARRAY<STRING>", r"regexp_extract_all(regexp_replace(s, r'([0-9]),(?=[0-9]{3})', '$1'), r'[0-9]+(?:\.[0-9]+)?', 0)"),
    ("missing_numbers(wanted STRING, have STRING)", "ARRAY<STRING>", r"filter(number_literals(wanted), n -> NOT array_contains(number_literals(have), n))"),
    ("video_id(s STRING)", "STRING", r"coalesce(nullif(regexp_extract(s, r'(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|shorts/|v/)|youtu\.be/)([A-Za-z0-9_-]{11})', 1), ''), CASE WHEN s RLIKE r'^[A-Za-z0-9_-]{11}$' THEN s END)"),
    ("clock(ms BIGINT)", "STRING", r"CASE WHEN ms >= 3600000 THEN format_string('%d:%02d:%02d', ms div 3600000, (ms div 60000) % 60, (ms div 1000) % 60) ELSE format_string('%d:%02d', ms div 60000, (ms div 1000) % 60) END"),
    ("strip_claim_ids(s STRING)", "STRING", r"trim(regexp_replace(regexp_replace(regexp_replace(s, r'\s*\[[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\]', ''), r' +([.,;:)])', '$1'), r'[ \t]{2,}', ' '))"),
    ("table_cell(s STRING)", "STRING", r"regexp_replace(replace(s, '|', r'\|'), r'\n+', ' ')"),
    ("csv_cell(s STRING)", "STRING", "concat('\"', replace(coalesce(s, ''), '\"', '\"\"'), '\"')"),
    ("percent(n BIGINT, d BIGINT)", "BIGINT", "CASE WHEN d = 0 THEN 0 ELSE floor(100D * n / d + 0.5D) END"),
    ("cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>)", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x) * aggregate(b, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))"),
)

#: Table functions: name with arguments, columns, and body over the views vectors, matches, claims_scored, topics, topic_closure, filings, claims and snapshots.
TABLES = (
    (
        "match_vectors(query ARRAY<FLOAT>, threshold DOUBLE, k INT)",
        "vec_id BIGINT, similarity DOUBLE, nth INT",
        """SELECT vec_id, similarity, nth FROM (SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS nth
           FROM (SELECT vec_id, cosine(embedding, query) AS exact, round(cosine(embedding, query), 6) AS similarity FROM vectors WHERE embedding IS NOT NULL) WHERE exact >= threshold) WHERE nth <= k""",
    ),
    (
        "nearest_to(query BIGINT, most INT)",
        "vec_id BIGINT, similarity DOUBLE, nth INT",
        "SELECT vec_id, similarity, CAST(nth AS INT) FROM matches WHERE query_id = query AND nth <= most",
    ),
    (
        "topic_claims(topic STRING, audience STRING, most INT, skip INT)",
        "claim_id BIGINT, statement STRING, source_count BIGINT, score DOUBLE",
        """SELECT claim_id, statement, source_count, score FROM (SELECT c.claim_id, c.statement, c.source_count, c.score, row_number() OVER (ORDER BY c.score DESC, c.source_count DESC, c.claim_id) AS nth FROM claims_scored c
           JOIN (SELECT DISTINCT f.claim_id FROM filings f JOIN topic_closure t ON f.topic_id = t.topic_id JOIN topics r ON r.topic_id = t.root_id AND r.status = 'active' WHERE t.root_id = topic) i ON i.claim_id = c.claim_id
           WHERE c.status = 'active' AND (topic_claims.audience IS NULL OR c.audience = 'Both' OR c.audience = CASE WHEN topic_claims.audience = 'patient' THEN 'Patient' ELSE 'Clinician' END)) WHERE nth > skip AND nth <= skip + most""",
    ),
    (
        "stale_topics()",
        "topic_id STRING, new_claims BIGINT",
        """SELECT s.topic_id, count(DISTINCT f.claim_id) FROM snapshots s JOIN topic_closure t ON t.root_id = s.topic_id JOIN filings f ON f.topic_id = t.topic_id AND f.filed_at > s.snapshot_at
           JOIN claims c ON c.claim_id = f.claim_id AND c.status = 'active' GROUP BY s.topic_id""",
    ),
)


def register(spark: SparkSession) -> None:
    """Make the scalar functions in the session."""
    for name, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")


def register_tables(spark: SparkSession, **views: DataFrame) -> None:
    """Make a temporary view of each table given, and those table functions whose views are all there."""
    register(spark)
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    needs = {"match_vectors": {"vectors"}, "nearest_to": {"matches"}, "topic_claims": {"claims_scored", "topics", "topic_closure", "filings"}, "stale_topics": {"snapshots", "topic_closure", "filings", "claims"}}
    for name, columns, body in TABLES:
        if needs[name.split("(")[0]] <= views.keys():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS TABLE ({columns}) RETURN {body}")
