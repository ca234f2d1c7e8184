"""corpus_pipeline.py against a plain version of its stages."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from silexa.llm import mixing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    rows = brute.documents(80)
    spark.createDataFrame(rows, brute.DOCUMENTS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1 - (n % 5 == 0), 0) for n, (i, *_) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    leaked = next(t for _, t, *_ in rows if t and 500 < len(t) < 1500)
    spark.createDataFrame([(1, leaked[:300])], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_work_on_what_the_one_before_has_kept(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "mixing"]
    docs, inputs = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append([tuple(r) for r in docs.collect()])
        out = stage(spark, docs, folder)
        rows = [tuple(r) for r in out.collect()]
        docs = spark.createDataFrame(rows, out.schema)
    good, single, cut, clean = inputs[1:]
    assert {r[0] for r in single} == {c for _, c in brute.components(good).values()}
    want = brute.repeats(single)
    assert {r[0]: r[1] for r in cut} == {r[0]: None if r[1] is None else want[r[0]][0].decode("utf-8", "ignore") for r in single}
    assert {r[0] for r in clean} <= {r[0] for r in cut}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed_sizes(spark.createDataFrame(clean, brute.DOCUMENTS)).collect()}
    assert docs.groupBy("doc_id").count().agg(F.sum("count")).first()[0] == sum(copies.values())
    assert corpus_pipeline.run(spark, folder).count() == sum(copies.values())
