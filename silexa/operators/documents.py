"""Articles of sections, blocks and sentences as rows, and their Markdown; ids of claims are never rendered.

``blocks`` has article_id, section, title, pos, kind, sentences (array of text, kind, claim_ids), tone, headers, cells and claim_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silexa.functions.text import table_cell, without_claim_ids

LABELS = {"caution": "Caution"}


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: table_cell(without_claim_ids(c))), " | "), F.lit(" |"))


def rendered(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``markdown``, null where a block has nothing to show."""
    texts = F.filter(F.transform("sentences", lambda s: without_claim_ids(s["text"])), lambda x: x != "")
    prose, bullets = F.array_join(texts, " "), F.array_join(F.transform(texts, lambda x: F.concat(F.lit("- "), x)), "\n")
    some, kind = F.size(texts) > 0, F.col("kind")
    rule = F.concat(F.lit("| "), F.array_join(F.transform("headers", lambda _: F.lit("---")), " | "), F.lit(" |"))
    table = F.array_join(F.concat(F.array(_row(F.col("headers")), rule), F.transform("cells", _row)), "\n")
    label = F.when(F.col("tone") == "caution", LABELS["caution"]).otherwise("Note")
    out = (
        F.when((kind == "prose") & some, prose)
        .when((kind == "bullets") & some, bullets)
        .when((kind == "key_takeaways") & some, F.concat(F.lit("**Key Takeaways**\n\n"), bullets))
        .when((kind == "callout") & some, F.concat(F.lit("> **"), label, F.lit(":** "), prose))
        .when((kind == "heading") & some, F.concat(F.lit("### "), prose))
        .when((kind == "table") & (F.size("headers") > 0), table)
    )
    return blocks.withColumn("markdown", out)


def articles(blocks: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """(article_id, markdown): sections under their titles, blocks in order, then the references (article_id, marker, citation) by number."""
    rows = rendered(blocks).filter("markdown IS NOT NULL").select("article_id", "section", F.col("pos").alias("pos"), "markdown")
    heads = blocks.groupBy("article_id", "section").agg(F.first("title").alias("title")).select("article_id", "section", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("## "), without_claim_ids(F.col("title"))).alias("markdown"))
    parts = rows.select("article_id", F.col("section").cast("long").alias("section"), F.col("pos").cast("long").alias("pos"), "markdown").unionByName(heads.withColumn("section", F.col("section").cast("long")))
    if references is not None:
        number, last = F.regexp_replace("marker", "^R", ""), F.lit((1 << 62)).cast("long")
        parts = parts.unionByName(references.select("article_id", last.alias("section"), number.cast("long").alias("pos"), F.concat(number, F.lit(". "), "citation").alias("markdown")))
        parts = parts.unionByName(references.select("article_id").distinct().select("article_id", last.alias("section"), F.lit(-1).cast("long").alias("pos"), F.lit("## References").alias("markdown")))
    return parts.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "pos", "markdown"))), lambda x: x["markdown"]), "\n\n").alias("markdown"))


def issues(blocks: DataFrame) -> DataFrame:
    """(article_id, section, pos, sentence, issue): sourced sentences without a claim, syntheses of fewer than two, tables without any."""
    bare = blocks.filter((F.col("kind") == "table") & (F.coalesce(F.size("claim_ids"), F.lit(0)) < 1)).select("article_id", "section", "pos", F.lit(None).cast("int").alias("sentence"), F.lit("table without claims").alias("issue"))
    each = blocks.filter("kind <> 'table'").select("article_id", "section", "pos", F.posexplode("sentences").alias("sentence", "s"))
    n = F.size("s.claim_ids")
    issue = F.when((F.col("s.kind") == "sourced") & (n < 1), "sourced without claims").when((F.col("s.kind") == "synthesis") & (n < 2), "synthesis of fewer than two claims")
    return bare.unionByName(each.select("article_id", "section", "pos", "sentence", issue.alias("issue")).filter("issue IS NOT NULL"))


def cited(blocks: DataFrame) -> DataFrame:
    """(article_id, claim_id, place): claims in the order in which an article first cites them; tables cite by block."""
    own = blocks.select("article_id", "section", "pos", F.posexplode(F.when(F.col("kind") == "table", F.array("claim_ids")).otherwise(F.transform("sentences", lambda s: s["claim_ids"]))).alias("sentence", "ids"))
    rows = own.select("article_id", F.struct("section", "pos", "sentence").alias("at"), F.posexplode("ids").alias("nth", "claim_id"))
    first = rows.groupBy("article_id", "claim_id").agg(F.min(F.struct("at", "nth")).alias("at"))
    from pyspark.sql import Window

    return first.select("article_id", "claim_id", F.row_number().over(Window.partitionBy("article_id").orderBy("at")).cast("long").alias("place"))


def update_tier(new: Column, total: Column, has_article: Column) -> Column:
    """How much of an article is written anew."""
    return F.when(~has_article, "full").when(new == 0, "metadata").when(new / total > 0.25, "full").otherwise("sections")


def write_markdown(articles: DataFrame, path: str) -> None:
    """``articles`` (article_id, markdown) as text files, many articles a file: each begins with a comment that holds its id and ends with a form feed; form feeds within become line ends. A null text is the empty one."""
    body = F.translate(F.coalesce("markdown", F.lit("")), "\f", "\n")
    rows = articles.select("article_id", F.concat(F.lit("<!-- article "), F.col("article_id").cast("string"), F.lit(" -->\n"), body).alias("value"))
    rows.repartition("article_id").select("value").write.option("lineSep", "\f").text(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(article_id as text, markdown) of such files."""
    rows = spark.read.option("lineSep", "\f").text(path)
    head = r"(?s)^<!-- article (.*?) -->\n(.*)$"
    return rows.select(F.regexp_extract("value", head, 1).alias("article_id"), F.regexp_extract("value", head, 2).alias("markdown"))
