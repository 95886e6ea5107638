"""The sheet of series by year, from orders as observations of several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import macro_sheet, series
from .registry import query, read

_YEARS, _EXPECTED = range(1995, 2003), range(2003, 2007)
_years = ", ".join(f"round(max(case when full_ and y = {y} then r end), 6) as y{y}" for y in _YEARS)
_means = ", ".join(
    f"case when count(*) filter (where k <= {n}) = {n} then round((exp(avg(ln(1 + r / 100)) filter (where k <= {n})) - 1) * 100, 6) end as mean_{n}, case when count(*) filter (where k <= {n}) = {n} then array_to_string(list_sort(list(y) filter (where k <= {n})), ',') end as years_{n}"
    for n in macro_sheet.WINDOWS
)
_expected = ", ".join(f"max(case when y = {y} then median end) as x{y}" for y in _EXPECTED)


@query(f"""
with o as (select o_orderpriority || '/' || (o_custkey % 8) as series, o_custkey % 2 = 0 as rate, date_trunc('month', o_orderdate)::date as d, (['other', 'bcb', 'ibge'])[o_orderkey % 3 + 1] as source, count(*) / 10 as v from orders group by all),
p as (select * from o qualify row_number() over (partition by series, d order by case source when 'ibge' then 0 when 'bcb' then 1 else 2 end) = 1),
t as (select series, rate, year(d) as y, count(*) as months, (exp(sum(ln(1 + v / 100))) - 1) * 100 as compounded, arg_max(v, d) as close from p group by all),
a as (select series, y, months, case when rate then compounded else (close / lag(close) over (partition by series order by y) - 1) * 100 end as r from t),
f as (select *, months = 12 and r is not null as full_ from a), n as (select *, case when full_ then row_number() over (partition by series, full_ order by y desc) end as k from f),
w as (select series, {_years}, {_means}, coalesce(array_to_string(list_sort(list(y) filter (where months < 12)), ','), '') as partial_years, coalesce(array_to_string(list_sort(list(y) filter (where months = 12 and r is null)), ','), '') as baseless_years from n group by series),
e as (select o_orderpriority || '/' || (o_custkey % 8) as series, 2003 + o_orderkey % 4 as y, arg_max(floor(o_totalprice / 1000) / 10, o_orderkey) as median from orders where o_custkey % 7 = 0 group by all),
x as (select series, {_expected}, min(y) as expected_from, max(y) as expected_to from e group by series)
select * from w full join x using (series)""")
def macro_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the series compound rates, half are levels; a month may lack, a source may be the second best."""
    o = read(spark, sf_dir, "orders").withColumn("series", F.concat("o_orderpriority", F.lit("/"), (F.col("o_custkey") % 8).cast("string")))
    source = F.element_at(F.array(*map(F.lit, ("other", "bcb", "ibge"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    obs = o.groupBy("series", F.when(F.col("o_custkey") % 2 == 0, "taxa").otherwise("nivel").alias("nature"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date_ref"), source.alias("source")).agg((F.count("*") / 10).alias("v"))
    returns = series.annual_return(macro_sheet.preferred(obs, ["ibge", "bcb"]), ["series"], "date_ref", "v", "nature")
    expected = o.where("o_custkey % 7 = 0").groupBy("series", (F.col("o_orderkey") % 4 + 2003).alias("ref_year")).agg(F.max_by(F.floor(F.col("o_totalprice") / 1000) / 10, "o_orderkey").alias("median"))
    out = macro_sheet.sheet(returns, expected, _YEARS, _EXPECTED)
    listed = {c: F.array_join(c, ",") for c in ("partial_years", "baseless_years", *(f"years_{n}" for n in macro_sheet.WINDOWS))}
    return out.withColumns(listed | {c: F.round(c, 6) for c in (*(f"y{y}" for y in _YEARS), *(f"mean_{n}" for n in macro_sheet.WINDOWS))})
