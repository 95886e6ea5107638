"""Queries against DuckDB on rows that the test tables don't hold."""

import datetime

import duckdb

from tidemark.plans import registry

from .test_queries import order, plain

_DAY = datetime.datetime(1998, 1, 1)


def order_rows(*rows):
    return "orders", "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp", [(k, c, p, _DAY) for k, c, p in rows]


def line_rows(*rows):
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    return "lineitem", names, [(*r, 7.0, "N") for r in rows]


def agrees(spark, tmp_path, name, *tables):
    con = duckdb.connect()
    for table, schema, rows in tables:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    mine = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=order)
    theirs = sorted((tuple(plain(v) for v in r) for r in con.execute(registry.oracle_sql()[name]).fetchall()), key=order)
    assert mine == theirs
    return mine


def test_prices_between_two_steps(spark, tmp_path):
    # 1.5 and 2.5 steps of 5,000 are both 2
    got = agrees(spark, tmp_path, "documents_registered", order_rows((2, 1, 7_500.0), (3, 1, 12_500.0), (4, 1, 10_000.0), (5, 1, 2_500.0)))
    assert sorted(r[4] for r in got) == [1, 1, 2, 3]


def test_lines_that_exchange_their_confidences(spark, tmp_path):
    # two alike lines of an order: each is now as sure as the other was at the verdict
    pair = next((a, b) for a in range(1, 200) for b in range(1, 200) if a % 70 + 30 == b % 20 + 80 and b % 70 + 30 == a % 20 + 80 and a % 70 + 30 != a % 20 + 80)
    tables = order_rows((7, 10, 1.0)), line_rows((7, 15, pair[0], 3), (7, 15, pair[1], 3))
    assert [r[4] for r in agrees(spark, tmp_path, "guards_rechecked", *tables)] == [True]
