import os

import duckdb
import pytest

import __spark_entry__ as entry
from ionflow import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, con, name):
    df, rel = catalog.QUERIES[name](spark, SF), con.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = sorted(str([str(dict(zip(rel.columns, r, strict=True))[c]) for c in df.columns]) for r in rel.fetchall())
    assert sorted(str([str(v) for v in r]) for r in df.collect()) == want


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0
