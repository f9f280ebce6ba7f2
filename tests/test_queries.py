"""Every query against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from tessera import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    mine, oracle = Q.QUERIES[name](spark, SF), db.sql(Q.ORACLE_SQL[name])
    assert sorted(mine.columns) == sorted(oracle.columns)
    assert rows(mine.columns, mine.collect()) == rows(oracle.columns, oracle.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
