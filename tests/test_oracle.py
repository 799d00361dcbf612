"""Every registered query with SQL, held against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from docweir import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if type(v).__name__ == "Decimal":
        return int(v) if v == int(v) else float(v)
    return v


@pytest.mark.parametrize("name", sorted(plans.all_queries()))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    want = db.sql(plans.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall()) == rows
