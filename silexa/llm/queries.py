"""The queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, licenses, media, mixing, quality, runs, suffixes, tokenfiles, tokens, toxicity, urls, whitening
from .common import delete, materialise, new_path, table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as concatenated baseline JPEG files, read back, with a thumbnail feature."""
    return media.media_columns(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; the labels of fold 0 are never read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(quality.fold(F.col("doc_id"), 5) != 0))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (quality.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document as repeats of 100 bytes or more."""
    return suffixes.removal_report(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram piece counts of every document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """A stand-in for a published host list: hosts of the table whose MD5 begins with 0."""
    host, _ = urls.url_parts(F.col("url"))
    return pages.select(host.alias("host")).distinct().filter(F.startswith(F.md5("host"), F.lit("0")))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for the url of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, listed_hosts(pages)).drop("url")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and link components of every document."""
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixed_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; the labels of fold 1 are never read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fit = labels.filter(quality.fold(F.col("doc_id"), 3) != 1)
    lexicon = toxicity.learn(*quality.labelled_sample(docs, fit, "toxic", toxicity.FIT_ROWS, toxicity.FIT_BYTES))
    scored = toxicity.score_toxicity(docs, lexicon)
    return scored.select("doc_id", (quality.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, every tenth of which is made to repeat itself."""
    return runs.run_report(runs.find_runs(table(spark, sf_dir, "documents"), rewrite=runs.planted))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every embedding."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written to ORC files and read back."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "tokens")
    tokenfiles.write_tokens(docs, path)
    digests = materialise(tokenfiles.token_digests(tokenfiles.read_tokens(spark, path, docs.schema["doc_id"].dataType.simpleString())), "digests")
    delete(spark, path)
    return tokenfiles.token_report(digests)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_media, op2_quality, op3_suffix, op4_licenses, op5_tokens, op6_urls, op7_jaccard, op8_decontaminate, op9_mixing, op10_toxicity, op11_runs, op12_whitening, op13_tokenfiles, pipeline)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op6_urls": f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules AS (SELECT split_part(rule, '/', 1) AS h, substr(rule, instr(rule, '/')) AS p, rule, action
          FROM (VALUES {", ".join(f"('{r}', '{a}')" for r, a in urls.RULES)}) AS t(rule, action)),
hosts AS (SELECT DISTINCT host FROM parts),
listed AS (SELECT host FROM hosts WHERE starts_with(md5(host), '0')),
blocked AS (SELECT DISTINCT a.host FROM hosts a JOIN listed b ON a.host = b.host OR ends_with(a.host, '.' || b.host)),
best AS (SELECT page_id, rule, action FROM (
           SELECT page_id, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS n
           FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) WHERE n = 1)
SELECT parts.page_id, parts.host, parts.path, best.rule,
       coalesce(best.action, CASE WHEN blocked.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id) LEFT JOIN blocked ON parts.host = blocked.host""",
    "op9_mixing": f"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END AS weight, {mixing.MOST} * source_size AS cap FROM per),
o AS (SELECT *, CAST(cap AS DOUBLE) / weight AS by_weight FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
             CAST(coalesce(sum(cap) OVER (ORDER BY by_weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS filled,
             CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY by_weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS open FROM o),
m AS (SELECT *, (CAST({mixing.BUDGET} AS DOUBLE) * total - filled) / open AS level FROM l),
f AS (SELECT max(level) AS fixed FROM (SELECT level FROM m WHERE level * weight <= cap ORDER BY by_weight, source NULLS LAST LIMIT 1)),
t AS (SELECT source, source_size, coalesce(least(fixed * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM m, f),
r AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, CAST({mixing.MOST} AS DOUBLE)) ELSE 0 END AS rate,
             CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS draw
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
}
