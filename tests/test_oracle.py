"""Every query with SQL against DuckDB on the same tables."""

import decimal

import duckdb
import pytest

from twinscope.plans.oracle import ORACLE_SQL
from twinscope.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(row):
    return tuple(round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else int(v) if isinstance(v, bool) else v for v in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    said = con.sql(ORACLE_SQL[name])
    assert sorted(said.columns) == columns
    at = [list(said.columns).index(c) for c in columns]
    expected = sorted((plain([row[i] for i in at]) for row in said.fetchall()), key=str)
    assert sorted((plain(r) for r in df.select(*columns).collect()), key=str) == expected


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 0
