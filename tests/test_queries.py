"""Every registered query that SQL can state gives the rows of its SQL; the others give rows of a stable schema."""

import os

import duckdb
import pytest
from contourflow.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    return float(x) if isinstance(x, (int, float)) or hasattr(x, "as_integer_ratio") else str(x)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_query_equals_its_sql(spark, duck, name):
    f, sql = REGISTRY[name]
    got = f(spark, SF)
    expect = duck.sql(sql)
    assert sorted(got.columns) == sorted(expect.columns)
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(expect.columns, expect.fetchall())


def test_curvature_of_straights_equals_its_sql_on_larger_tables(spark):
    larger, (f, sql) = "/root/testdata/sf0.1", REGISTRY["curve_radii"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{larger}/events.parquet'")
    got, expect = f(spark, larger), con.sql(sql)
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(expect.columns, expect.fetchall())


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if not sql])
def test_query_without_sql_gives_rows(spark, name):
    assert REGISTRY[name][0](spark, SF).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
