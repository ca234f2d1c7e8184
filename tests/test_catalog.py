"""Every registered query outside the training-data operators against its SQL twin."""

import os
from pathlib import Path

import pytest

from silexa import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def cell(x):
    return x is None, str(round(x, 6) + 0.0 if isinstance(x, float) else x)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_and_sql_agree(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    if name not in catalog.ORACLE_SQL:
        assert df.count() >= 0
        return
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(map(cell, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(cell, r)) for r in want)


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["claim_id", "statement", "source_count", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_spans_with_nulls_and_parts_of_units_merge_as_in_sql(spark, tmp_path):
    """No two spans of a key are equal here: SQL leaves the order of equal ones open in each of its windows."""
    import duckdb

    rows = [(1, 1, 0, 5.0), (1, 1, 0, None), (1, 3, 0, 2.0), (1, None, 0, 50.0), (1, 2, None, 1.0), (2, 1, 0, 9.6), (2, 2, 0, 1.0), (3, 1, 0, 8.5), (3, 1, 4, 4.5), (3, 1, 3, 2.5), (4, 1, 1, None), (None, 1, 0, 5.0), (None, 1, 2, 6.0)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT k, start_at, end_at FROM ({catalog.ORACLE_SQL['win_07_merge_spans']})").fetchall()
    got = catalog.QUERIES["win_07_merge_spans"](spark, f"file://{tmp_path}").select("k", "start_at", "end_at").collect()
    assert sorted(tuple(map(cell, r)) for r in got) == sorted(tuple(map(cell, r)) for r in want)
