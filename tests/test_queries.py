"""Every registered query against DuckDB on the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def order(row):
    return tuple((v is None, str(type(v)) if not isinstance(v, int | float | datetime.date) else "", 0 if v is None else v) for v in row)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=order)
    got = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=order)
    assert mine == theirs


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
