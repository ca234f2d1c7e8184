"""A corpus pipeline of five stages over ``documents``: quality, near duplicates, repeated passages, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns the columns of ``documents``; the last one adds ``copy``.
``run`` writes what a stage returns as Parquet to the shared folder and reads it back as the next stage's ``docs``; what a stage has read is deleted then.

Defined cases: a null text is the empty text for the first, second and fourth stage and stays null in the others; rows with a null doc_id pass the second and fourth
stage; repeated rows are one document in the second stage, in which ties go to the smaller id; an empty table gives an empty result. The stages say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silexa.llm import decontaminate, jaccard, mixing, quality, suffixes
from silexa.llm.common import delete, fresh, materialise, scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at its threshold or above; it learns from the labels outside fold 0."""
    labels = table(spark, sf_dir, "labels").filter(quality.fold(F.col("doc_id"), 5) != 0)
    model = quality.train(docs, labels)
    (score,) = fresh(docs.columns, "_score")
    return quality.score_quality(docs, model, keep=tuple(docs.columns), name=score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return jaccard.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document has as well."""
    return suffixes.remove_repeats(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


STAGES = [("quality", keep_good), ("near_duplicates", one_of_near_copies), ("repeated_passages", without_repeats), ("decontamination", without_leaks), ("mixing", mix)]

#: The stages are not expressible in SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as own:
            docs = own.keep(materialise(stage(spark, docs, sf_dir), name))
        if path:
            delete(spark, path)
        path = docs.silexa_path
    return docs
