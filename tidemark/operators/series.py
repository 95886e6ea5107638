"""Time series: compounding, level returns, geometric means, divergences, seasonality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pick import as_of


def compounded(rate: Column) -> Column:
    """Aggregate: rates in percent compounded, in percent. Rates of -100 or less give null."""
    growth = F.exp(F.sum(F.log1p(rate / 100.0)))
    return F.when(F.min(rate) > -100, (growth - 1) * 100)


def annual_return(df: DataFrame, keys: Sequence[str], date: str, value: str, nature: str, since: int | None = None) -> DataFrame:
    """Per key and year: months, and the return by the nature of the series.

    `taxa` compounds the rates of the year; anything else is the last value of the year
    over the last one before the year. `since` limits the years shown, not the base.
    """
    year = F.year(date)
    per = df.groupBy(*keys, nature, year.alias("year")).agg(
        F.count("*").alias("months"), compounded(F.col(value)).alias("_rate"), F.max(F.struct(date, value))[value].alias("_close")
    )
    per = per.withColumn("_start", F.make_date("year", F.lit(1), F.lit(1)).cast(df.schema[date].dataType))
    based = as_of(per, df.select(*keys, F.col(date).alias("_d"), F.col(value).alias("_base")), keys, "_start", "_d", "_base")
    level = (F.col("_close") / F.nullif(F.col("_base"), F.lit(0.0)) - 1) * 100
    out = based.select(*keys, "year", "months", F.when(F.col(nature) == "taxa", F.col("_rate")).otherwise(level).alias("annual_return"), nature)
    return out.where(F.col("year") >= since) if since is not None else out


def geometric_mean(df: DataFrame, keys: Sequence[str], year: str, value: str, months: str, last: int) -> DataFrame:
    """Per key the geometric mean of the last complete years; null where there are too few."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(year))
    full = df.where((F.col(months) == 12) & F.col(value).isNotNull()).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last)
    mean = (F.exp(F.avg(F.log1p(F.col(value) / 100.0))) - 1) * 100
    return full.groupBy(*keys).agg(F.when(F.count("*") == last, mean).alias("geo_mean"))


def divergences(df: DataFrame, keys: Sequence[str], source: str, value: str, tolerance: float) -> DataFrame:
    """Pairs of sources whose values for the same keys differ by more than the tolerance."""
    a = df.select(*keys, F.col(source).alias("source_a"), F.col(value).alias("value_a"))
    b = df.select(*keys, F.col(source).alias("source_b"), F.col(value).alias("value_b"))
    return a.join(b, list(keys)).where((F.col("source_b") > F.col("source_a")) & (F.abs(F.col("value_a") - F.col("value_b")) > tolerance))


def seasonality(df: DataFrame, keys: Sequence[str], month: str, value: str) -> DataFrame:
    """Per key and month the share of the year's absolute sum, only where all 12 months are there."""
    monthly = df.groupBy(*keys, month).agg(F.abs(F.sum(value)).alias("_v"))
    whole = Window.partitionBy(*keys)
    return monthly.withColumn("_n", F.count("*").over(whole)).withColumn("share", F.col("_v") / F.sum("_v").over(whole)).where("_n = 12").drop("_n", "_v")


def monthly_rate(annual: Column) -> Column:
    return F.pow(1 + annual, F.lit(1.0 / 12)) - 1


def cagr(first: Column, last: Column, n: Column) -> Column:
    return F.when((first > 0) & (n > 0), F.pow(last / first, 1 / n) - 1)


def real_growth(nominal: Column, index: Column) -> Column:
    return (1 + nominal) / (1 + index) - 1
