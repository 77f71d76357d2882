"""The driver's contract, and every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from maskwright.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "text"] and df.count() == 200


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())


def rows(df):
    columns = sorted(df.columns)
    return sorted(repr([None if x != x else x for x in r]) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert rows(plans.QUERIES[name](spark, small).toPandas()) == rows(con.sql(plans.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0
