"""Schedules and drivers of a model: linear instalments, cost of debt, signs by block, methods of projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 360


def instalments(df: DataFrame, balance: str, term: Column, years: int) -> DataFrame:
    """Linear instalments of a balance over a term in years, whole or not: a row a year.

    A year pays min(1, 1 / (term - years gone)) of what is open, and nothing after the term.
    These parts telescope, so what is open after i years is balance * max(0, term - i) / term
    and no year needs the one before. Without a positive term nothing is ever paid.
    """
    i = F.col("period") - 1
    left = lambda n: F.when(term > 0, F.greatest(F.lit(0.0), term - n) / term).otherwise(1.0)
    out = df.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(years))))
    out = out.withColumn("opening", F.col(balance) * left(i)).withColumn("closing", F.col(balance) * left(i + 1))
    return out.withColumn("paid", F.col("opening") - F.col("closing"))


def implied_spread(rate: Column, curve: Column) -> Column:
    """What a rate holds above a curve, compounded; 0 where the curve leaves nothing."""
    return F.when(1 + curve == 0, 0.0).otherwise((1 + rate) / F.nullif(1 + curve, F.lit(0.0)) - 1)


def implied_term(short: Column, whole: Column, most: float = 10.0) -> Column:
    """The term whose linear instalment of a year is the short part; `most` where nothing is short."""
    return F.when((whole > 0) & (short > 0), F.least(F.lit(most), whole / F.nullif(short, F.lit(0.0)))).otherwise(most)


def signs_normalised(df: DataFrame, keys: Sequence[str], block: str, value: str, blocks: Sequence[str], historical: Column) -> DataFrame:
    """Blocks of expenses as magnitudes: one whose historical sum is negative has all its signs turned.

    `turned` marks its lines. Sums are combined before they are joined back, null keys included.
    """
    sums = df.where(F.col(block).isin(*blocks) & historical).groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate((*keys, block)))).agg(F.sum(value).alias("_sum"))
    same = F.lit(True)
    for i, k in enumerate((*keys, block)):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = df.join(sums, same, "left").withColumn("turned", F.coalesce(F.col("_sum") < 0, F.lit(False)))
    return out.withColumn(value, F.when(F.col("turned"), -F.col(value)).otherwise(F.col(value))).drop("_sum", *(f"_k{i}" for i in range(len(keys) + 1)))


def projected(df: DataFrame, keys: Sequence[str], year: str, method: str, base: str, driver: str, other: str, out: str = "projected") -> DataFrame:
    """A line's years by its method, one of

    crescimento_composto (base times the product of 1 + driver), pct_de_linha (driver times
    the other line), dias_de_giro (the other line over 360 times the driver in days),
    valor_por_ano (the driver), preco_x_volume (driver times other), indice_macro (the base
    with the driver's last value as its growth in every year so far: held where it is null)
    and curva_mensal (base times the driver's share of its sum). An unknown method gives null.
    """
    upto = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d, o, b = F.col(driver), F.col(other), F.col(base)
    grown = b * F.exp(F.sum(F.log1p(d)).over(upto))
    macro = b * F.exp(F.sum(F.log1p(F.coalesce(d, F.lit(0.0)))).over(upto))
    whole = F.sum(d).over(Window.partitionBy(*keys))
    m = F.col(method)
    return df.withColumn(
        out,
        F.when(m == "crescimento_composto", grown).when(m == "pct_de_linha", d * o).when(m == "dias_de_giro", o * d / DAYS).when(m == "valor_por_ano", d)
        .when(m == "preco_x_volume", d * o).when(m == "indice_macro", macro).when(m == "curva_mensal", F.when(whole != 0, b * d / whole)),
    )
