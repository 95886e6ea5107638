"""Series by year in one row a series: returns, means of complete years, expectations, and what is lacking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pick import first_per_key

#: Windows of the means, in complete years.
WINDOWS = (3, 5, 10)


def preferred(observations: DataFrame, sources: Sequence[str], keys: Sequence[str] = ("series", "date_ref"), source: str = "source") -> DataFrame:
    """One observation a series and date: that of the first of the sources, of others the first by name."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, sources)), F.col(source)), F.lit(0))
    return first_per_key(observations, list(keys), [F.when(rank > 0, rank).otherwise(len(sources) + 1), F.col(source)])


def _mean(years: Column, n: int) -> Column:
    """The geometric mean of the last n of the complete years, in percent; null where there are fewer or one is -100 or less."""
    last = F.slice(years, -n, n)
    growth = F.aggregate(last, F.lit(0.0), lambda a, x: a + F.log1p(x["annual_return"] / 100.0))
    return F.when((F.size(years) >= n) & ~F.exists(last, lambda x: x["annual_return"] <= -100), (F.exp(growth / n) - 1) * 100)


def sheet(returns: DataFrame, expectations: DataFrame, years: Sequence[int], expected_years: Sequence[int], windows: Sequence[int] = WINDOWS) -> DataFrame:
    """A row a series of either table, its columns known beforehand.

    returns: series, year (unique together), months, annual_return; expectations: series, ref_year,
    median. y<year>: the return of a complete year, of twelve months and a return, else null: a part
    of a year would pull the means down, and a level's first year has no base. mean_<n> and years_<n>:
    the geometric mean of the last n complete years and which they are, whatever lies between, null
    where there are fewer. x<year>: the expectation. partial_years, baseless_years and
    expected_from/expected_to say what is lacking. A series has as many years as it has, one array.
    """
    year = F.col("year")
    full = F.coalesce((F.col("months") == 12) & F.col("annual_return").isNotNull(), F.lit(False))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, year)))
    wide = returns.groupBy("series").agg(
        *(F.max(F.when(full & (year == y), F.col("annual_return"))).alias(f"y{y}") for y in years),
        F.array_sort(F.collect_list(F.when(full, F.struct("year", "annual_return")))).alias("_full"),
        listed(~F.coalesce(F.col("months") == 12, F.lit(False))).alias("partial_years"),
        listed((F.col("months") == 12) & F.col("annual_return").isNull()).alias("baseless_years"),
    )
    means = [c for n in windows for c in (_mean(F.col("_full"), n).alias(f"mean_{n}"), F.when(F.size("_full") >= n, F.transform(F.slice("_full", -n, n), lambda x: x["year"])).alias(f"years_{n}"))]
    wide = wide.select("series", *(f"y{y}" for y in years), *means, "partial_years", "baseless_years")
    at = F.when(F.col("median").isNotNull(), F.col("ref_year"))
    seen = expectations.groupBy("series").agg(*(F.max(F.when(F.col("ref_year") == y, F.col("median"))).alias(f"x{y}") for y in expected_years), F.min(at).alias("expected_from"), F.max(at).alias("expected_to"))
    return wide.join(seen, "series", "full_outer")
