"""Every registered query of the retrieval engine against its DuckDB SQL on the smallest tables."""

import os

import pytest

from ragloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "benchmark", "conversations", "pages", "labels"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if type(value).__name__ == "Decimal":
        value = float(value)
    return round(value, 9) if isinstance(value, float) else value


def sorted_rows(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as entry

    assert len(entry.entry(spark).collect()) == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
