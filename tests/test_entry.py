import os

import duckdb
import pytest

import __spark_entry__ as entry
from nearfield.plans import exact

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "vec_id", "distance", "rank"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(exact.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(exact.ORACLE_SQL[name])
    got = entry.queries()[name](spark, SF)
    assert set(got.columns) == set(want.columns)
    rows = sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)
