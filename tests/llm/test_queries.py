"""The registered queries: contract columns, held-out accuracy, and the SQL that checks them."""

import os
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")

CONTRACT = {
    "op1_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op2_quality": "doc_id held_out score predicted",
    "op4_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op5_tokens": "doc_id n_tokens",
    "op9_mixing": "doc_id size source_size target taken",
    "op10_toxicity": "doc_id held_out score predicted",
}


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


@pytest.mark.parametrize("name", CONTRACT)
def test_contract_columns(spark, entry, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns[: len(CONTRACT[name].split())] == CONTRACT[name].split()
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize(("name", "label"), [("op2_quality", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_accuracy(spark, entry, name, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = entry.queries()[name](spark, SF).filter("held_out").join(labels, "doc_id")
    right = rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
    assert right > 0.9


def test_jaccard_and_suffix_of_the_whole_table(spark, entry):
    import hashlib

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in entry.queries()["op3_suffix"](spark, SF).collect()}
    want = {i: (n, s, hashlib.sha256(k).hexdigest()) for i, (k, n, s) in brute.repeats(rows).items()}
    assert found == want
    linked = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in entry.queries()["op7_jaccard"](spark, SF).collect()}
    assert linked == brute.components(rows)


@pytest.mark.parametrize("name", ["op6_urls", "op9_mixing"])
def test_sql_agrees(spark, entry, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    sql = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    key = lambda row: tuple((x is None, str(round(x, 6) if isinstance(x, float) else x)) for x in row)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(key, sql.fetchall())) == sorted(key(r) for r in df.select(*names).collect())
