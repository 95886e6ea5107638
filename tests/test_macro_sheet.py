"""Sheets of series: complete years only, windows over gaps, sources by preference."""

import math

from pyspark.sql import functions as F

from tidemark.operators import macro_sheet

RETURNS = "series string, year int, months int, annual_return double"
EXPECTED = "series string, ref_year int, median double"


def row(spark, returns, expected=()):
    out = macro_sheet.sheet(spark.createDataFrame(returns, RETURNS), spark.createDataFrame(list(expected), EXPECTED), range(2010, 2026), [2026, 2027], (3, 5))
    return {r.series: r for r in out.collect()}


def test_windows_go_over_complete_years_only(spark):
    rows = [("a", 2018, 12, None), ("a", 2019, 12, 10.0), ("a", 2020, 7, 99.0), ("a", 2021, 12, 4.0), ("a", 2024, 12, -5.0), ("a", 2025, 4, 1.0), ("b", 2024, 12, 1.0), ("c", 2022, 12, 1.0), ("c", 2023, 12, -100.0), ("c", 2024, 12, 2.0), ("d", 2024, None, 3.0)]
    got = row(spark, rows, [("a", 2026, 4.5), ("e", 2027, None), ("e", 2026, 3.0)])
    a = got["a"]
    assert math.isclose(a.mean_3, ((1.10 * 1.04 * 0.95) ** (1 / 3) - 1) * 100) and a.years_3 == [2019, 2021, 2024]
    assert a.mean_5 is None and a.years_5 is None
    assert (a.y2018, a.y2019, a.y2020, a.y2024, a.y2025) == (None, 10.0, None, -5.0, None)
    assert a.partial_years == [2020, 2025] and a.baseless_years == [2018] and (a.x2026, a.x2027, a.expected_from, a.expected_to) == (4.5, None, 2026, 2026)
    assert got["b"].mean_3 is None and got["c"].mean_3 is None and got["c"].years_3 == [2022, 2023, 2024] and got["d"].partial_years == [2024]
    assert got["e"].y2024 is None and got["e"].x2026 == 3.0 and (got["e"].expected_from, got["e"].expected_to) == (2026, 2026)


def test_a_year_of_twelve_months_gives_the_same_as_its_mean(spark):
    got = row(spark, [("a", 2020 + k, 12, 7.0) for k in range(5)])
    assert math.isclose(got["a"].mean_3, 7.0) and math.isclose(got["a"].mean_5, 7.0) and got["a"].years_5 == [2020, 2021, 2022, 2023, 2024]
    assert row(spark, [("a", 2020, 12, 7.0)][:0]) == {}


def test_sources_by_preference(spark):
    obs = spark.createDataFrame([("a", 1, "bcb", 1.0), ("a", 1, "ibge", 2.0), ("a", 2, "bcb", 3.0), ("a", 3, "y", 5.0), ("a", 3, "x", 4.0), ("a", 4, None, 6.0), ("a", 4, "z", 7.0)], "series string, date_ref int, source string, value double")
    got = macro_sheet.preferred(obs, ["ibge", "bcb"])
    assert sorted((r.date_ref, r.source, r.value) for r in got.collect()) == [(1, "ibge", 2.0), (2, "bcb", 3.0), (3, "x", 4.0), (4, "z", 7.0)]
    assert got.where(F.col("date_ref").isNull()).isEmpty()
