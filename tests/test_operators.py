"""Identities and negative cases of the operators."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import pick, project, recon, recurrence, series, upsert
from tidemark.sources import readers
from tidemark.streaming.upserts import upsert_stream



def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_verdict_flips(spark):
    df = spark.createDataFrame([(1000.0, 1090.0), (1000.0, 1101.0), (1e6, 1.004e6), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(recon.verdict(F.col("a"), F.col("b"), 100, 0.005)).collect()] == ["ok", "divergent", "ok", "unmet"]


def test_guards(spark):
    df = spark.createDataFrame([(1, f"l{i}", 500.0) for i in range(4)] + [(1, "big", 9000.0), (2, "a", 1.0)], "k int, l string, v double")
    assert rows(recon.repeated_values(df, ["k"], "v", "l"), "k") == [(1, 500.0, 4, True), (2, 1.0, 1, False)]


def test_merge_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e"), (None, "n")], "k int, v string")
    once = upsert.merge(old, new, ["k"], ["v"])
    assert {(r.k, r.v, r.action) for r in once.collect()} == {(1, "a", "kept"), (2, "c", "update"), (3, "e", "insert"), (None, "n", "insert")}
    twice = upsert.merge(once.select("k", "v"), new, ["k"], ["v"])
    assert {r.action for r in twice.collect()} == {"kept", "noop"}


def test_series(spark):
    months = [(dt.date(2024, m, 1), 1.0, "taxa") for m in range(1, 13)]
    df = spark.createDataFrame([("a", *m) for m in months], "s string, d date, v double, n string")
    assert abs(series.annual_return(df, ["s"], "d", "v", "n").first()["annual_return"] - 12.682503) < 1e-6
    level = spark.createDataFrame([("b", dt.date(2023, 12, 1), 5.0, "nivel"), ("b", dt.date(2024, 12, 1), 6.0, "nivel")], df.schema)
    got = {r["year"]: r["annual_return"] for r in series.annual_return(level, ["s"], "d", "v", "n").collect()}
    assert got[2023] is None and abs(got[2024] - 20) < 1e-9
    share = series.seasonality(df.select("s", F.month("d").alias("m"), "v"), ["s"], "m", "v")
    assert abs(share.agg(F.sum("share")).first()[0] - 1) < 1e-12
    assert series.seasonality(df.where("month(d) < 12").select("s", F.month("d").alias("m"), "v"), ["s"], "m", "v").count() == 0


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([(1, 5), (1, 6), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 4, "w")], "k int, t int, v string")
    assert rows(pick.as_of(left, right, ["k"], "t", "t", "v"), "k", "t") == [(1, 5, "w"), (1, 6, "x"), (2, 1, None)]


def test_schedules(spark):
    loans = spark.createDataFrame([(1, 100.0, 0.1, 4)], "k int, p double, r double, t int")
    out = project.amortisation(loans, "p", "r", "t")
    assert abs(out.agg(F.sum("payment")).first()[0] - 100) < 1e-9 and out.orderBy(F.desc("period")).first()["closing"] == 0
    split = spark.createDataFrame([("k", i, 1.0, 100.0) for i in range(3)], "k string, o int, w double, t double")
    got = [r["allocated"] for r in project.with_residual(split, ["k"], "o", "w", "t").orderBy("o").collect()]
    assert got == [33.33, 33.33, 33.34]
    flows = spark.createDataFrame([("k", 1, -10.0), ("k", 2, 30.0), ("k", 3, 0.0)], "k string, y int, f double")
    got = rows(recurrence.cash_sweep(flows, ["k"], "y", "f", 5.0, 1.0).select("y", "draw", "debt", "cash"), "y")
    assert got == [(1, 6.0, 6.0, 1.0), (2, -6.0, 0.0, 25.0), (3, 0.0, 0.0, 25.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a; b ;\n1; x;y\n\n2;;\r\n")
    got = readers.read_separated(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["a", "b", "col2"] and rows(got, "a") == [("1", "x", "y"), ("2", "", "")]
    df = spark.createDataFrame([("01/02/2024", "1,5"), ("2024-01-01", "1"), ("01/03/2024", "x")], "date string, value string")
    assert [(r["date_ref"], r["value"]) for r in readers.monthly_series(df, "date", "value").collect()] == [(dt.date(2024, 2, 1), 1.5)]


def test_stream_upserts(spark, tmp_path):
    for i, part in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        spark.createDataFrame(part, "k int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
        upsert_stream(stream, str(tmp_path / "out"), ["k"], ["v"], str(tmp_path / "ck")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out" / f"v{i}")).count() == 2 + i
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out" / "v1")).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_heading_lines_that_repeat_are_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;2\na;b\n3;4\n\n")
    got = [tuple(r) for r in readers.read_separated(spark, str(tmp_path / "a.csv")).collect()]
    assert sorted(got) == [("1", "2"), ("3", "4"), ("a", "b")]


def test_long_groups_as_text_are_cut_with_a_note(spark):
    df = spark.range(500).selectExpr("id % 2 as k", "id as n", "concat('v', id) as v")
    got = {r["k"]: r["text"] for r in readers.rows_as_text(df, ["k"], "n", rows=3).collect()}
    assert got[0] == "n | v\n0 | v0\n2 | v2\n4 | v4\n... (+247)" and got[1].endswith("5 | v5\n... (+247)")


def test_first_per_key_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (1, 7, "c"), (2, None, "d")], "k int, o int, v string")
    assert {r["k"]: r["v"] for r in pick.first_per_key(df, ["k"], [F.col("o"), F.col("v")]).collect()} == {1: "b", 2: "d"}
