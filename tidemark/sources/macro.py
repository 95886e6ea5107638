"""Payloads of statistics services as columns of JSON text: expectations and monthly indices.

A payload is one answer of a service, so its array is bounded by what the service returns;
everything happens within its row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import locale_number

# The names of the fields in the answers, and the basis that counts.
EXPECTATION = "struct<value: array<struct<Data: string, DataReferencia: string, Mediana: string, Media: string, numeroRespondentes: string, baseCalculo: string>>>"
INDEX = "array<struct<D3C: string, V: string>>"
BASIS = 0


def _whole(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(n == F.floor(n), n.try_cast("int"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def expectations(df: DataFrame, payload: str) -> DataFrame:
    """A row a reference year of the newest collection in each payload.

    Rows of another basis fall away (a missing basis counts as the right one), and so do those
    without a whole year or a readable median; of several for a year the first stands. Null,
    unreadable and empty payloads give no rows. The new columns are year, median, mean,
    respondents and collected; columns of df with these names are replaced.
    """
    basis = lambda i: i["baseCalculo"].isNull() | (i["baseCalculo"].try_cast("double") == BASIS)

    def kept(items: Column) -> Column:
        newest = F.array_max(F.transform(items, lambda i: i["Data"]))
        usable = lambda i, d: (i["Data"] == d) & basis(i) & _whole(i["DataReferencia"]).isNotNull() & locale_number(i["Mediana"]).isNotNull()
        return _bound(newest, lambda d: F.filter(items, lambda i: usable(i, d)))

    def firsts(rows: Column) -> Column:
        # by year and place, so that the first of a year comes after one of another year
        placed = F.array_sort(F.transform(rows, lambda i, at: F.struct(_whole(i["DataReferencia"]).alias("year"), at.alias("at"))))
        begin = _bound(placed, lambda p: F.filter(p, lambda x, at: (at == 0) | (F.get(p, at - 1)["year"] != x["year"])))
        return F.transform(begin, lambda x: F.get(rows, x["at"]))

    first = _bound(F.from_json(F.col(payload), EXPECTATION)["value"], lambda items: _bound(kept(items), firsts))
    # outer, and then without the empty ones: else Spark reads the payload twice to drop these
    one = df.withColumn("_i", F.explode_outer(first)).where("_i is not null")
    return one.withColumns({
        "year": _whole(F.col("_i.DataReferencia")),
        "median": locale_number(F.col("_i.Mediana")),
        "mean": locale_number(F.col("_i.Media")),
        "respondents": _whole(F.col("_i.numeroRespondentes")),
        "collected": F.col("_i.Data"),
    }).drop("_i")


def monthly_index(df: DataFrame, payload: str) -> DataFrame:
    """A row a month of each payload; its first element only describes the others.

    Months are yyyymm and stand as their first day; unreadable months and values fall away.
    The new columns are date_ref and value.
    """
    items = F.from_json(F.col(payload), INDEX)
    one = df.withColumn("_i", F.explode(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))))
    month = F.when(F.col("_i.D3C").rlike(r"^\d{6}$"), F.try_to_date(F.concat(F.col("_i.D3C"), F.lit("01")), "yyyyMMdd"))
    return one.withColumn("date_ref", month).withColumn("value", locale_number(F.col("_i.V"))).drop("_i").where("date_ref is not null and value is not null")


def covered(wanted: DataFrame, known: DataFrame, series: str, year: str, median: str) -> DataFrame:
    """The wanted (series, year) with the expectation as a fraction, or null and why.

    reason is `no_series` (nothing of the series is known), `not_covered` (other years are) or
    null; first_year and last_year say what the series covers. A gap stays null: it is not an
    expectation of zero. Of repeated (series, year) the least median stands.
    """
    known = known.where(F.col(median).isNotNull())
    value = known.groupBy(F.col(series).alias("_s"), F.col(year).alias("_y")).agg(F.min(median).alias("_m"))
    span = known.groupBy(F.col(series).alias("_s")).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    out = wanted.join(value, (F.col(series) == F.col("_s")) & (F.col(year) == F.col("_y")), "left").drop("_s", "_y").join(span, F.col(series) == F.col("_s"), "left").drop("_s")
    reason = F.when(F.col("first_year").isNull(), "no_series").when(F.col("_m").isNull(), "not_covered")
    return out.withColumn("fraction", F.col("_m") / 100).withColumn("reason", reason).drop("_m")
