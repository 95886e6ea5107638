"""Projections over years in closed forms, as windows; recurrences are in `recurrence`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(keys: Sequence[str], year: str):
    return Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def compound_growth(df: DataFrame, keys: Sequence[str], year: str, base: str, growth: str, out: str = "projected") -> DataFrame:
    """base * product of (1 + growth) up to each year."""
    return df.withColumn(out, F.col(base) * F.exp(F.sum(F.log1p(F.col(growth))).over(_upto(keys, year))))


def hold_flat(df: DataFrame, keys: Sequence[str], year: str, value: str, out: str = "held") -> DataFrame:
    """The last known value up to each year."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_upto(keys, year)))


def combined_index(index: Column, spread: Column) -> Column:
    return (1 + index) * (1 + spread) - 1


def turnover_days(balance: Column, base: Column, days: int = 360) -> Column:
    return F.when(base != 0, balance / base * days)


def balance_of_days(days: Column, base: Column, year_days: int = 360) -> Column:
    return days / year_days * base


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b, or `otherwise` where b is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def variation(df: DataFrame, keys: Sequence[str], year: str, value: str, out: str = "variation") -> DataFrame:
    """What the value takes out of cash: minus its change since the year before."""
    return df.withColumn(out, -(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(year))))


def vertical_share(df: DataFrame, keys: Sequence[str], value: str, anchor: Column, out: str = "av_pct") -> DataFrame:
    """The value as a part of the anchor line of its keys."""
    total = F.max(F.when(anchor, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(total != 0, F.col(value) / total))


def horizontal_change(df: DataFrame, keys: Sequence[str], year: str, value: str, out: str = "delta_pct") -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(year))
    return df.withColumn(out, F.when(before != 0, F.col(value) / before - 1))


def amortisation(loans: DataFrame, principal: str, rate: str, term: str) -> DataFrame:
    """Constant amortisation: a row a year with opening, payment, interest and closing."""
    k = F.col("period") - 1
    part = F.col(principal) / F.col(term)
    out = loans.where(F.col(term) > 0).withColumn("period", F.explode(F.sequence(F.lit(1), F.col(term))))
    out = out.withColumn("opening", F.col(principal) - part * k).withColumn("payment", part)
    return out.withColumn("interest", F.col("opening") * F.col(rate)).withColumn("closing", F.col("opening") - F.col("payment"))


def vintages(issues: DataFrame, keys: Sequence[str], year: str, amount: str, term: int, last: int) -> DataFrame:
    """Linear amortisation of each year's new issue in the years after it, up to `last`."""
    end = F.least(F.col(year) + term, F.lit(last))
    due = issues.where(F.col(year) < last).withColumn("due_year", F.explode(F.sequence(F.col(year) + 1, end)))
    return due.groupBy(*keys, "due_year").agg(F.sum(F.col(amount) / term).alias("amortised"))


def income_cascade(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "running") -> DataFrame:
    """Running subtotals of a statement's lines in their order."""
    return df.withColumn(out, F.sum(value).over(_upto(keys, order)))


def equity_method(share: Column, equity: Column) -> tuple[Column, Column]:
    """(investment, provision): a part of the equity; what is negative becomes a provision."""
    part = F.round(share * equity, 2)
    return F.greatest(F.lit(0.0), part), -F.least(F.lit(0.0), part)


def with_residual(df: DataFrame, keys: Sequence[str], order: str, weight: str, total: str, scale: int = 2, out: str = "allocated") -> DataFrame:
    """The total split by weight and rounded; the last of a key takes what rounding left."""
    whole = Window.partitionBy(*keys)
    share = F.round(F.col(total) * F.col(weight) / F.sum(weight).over(whole), scale)
    df = df.withColumn("_share", share).withColumn("_last", F.row_number().over(whole.orderBy(F.desc(order))) == 1)
    rest = F.col(total) - (F.sum("_share").over(whole) - F.col("_share"))
    return df.withColumn(out, F.when(F.col("_last"), F.round(rest, scale)).otherwise(F.col("_share"))).drop("_share", "_last")
