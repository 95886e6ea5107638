"""Queries of the joins by likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match
from .labels import _FOLD, _choose, _sql_choose
from .registry import query, read

_REFS = ["1995", "12M96", "95,97", "31/12/1998", "L24M", "", "1T99"]
_YEARS = {"1995": [1995], "12M96": [1996], "95,97": [1995, 1997], "31/12/1998": [1998], "L24M": [], "": [], "1T99": [1999]}


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they come from files: whole, with a suffix, or with their first word cut."""
    k, first = F.col("p_partkey"), F.split("p_name", " ")[0]
    name = F.when(k % 3 == 0, F.concat(F.upper("p_name"), F.lit(" Ltda."))).when(k % 3 == 1, F.concat(F.left(first, F.lit(4)), F.lit(" "), F.split("p_name", " ")[1])).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), name.alias("filed"), k.alias("k"))


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), F.concat(F.initcap("p_name"), F.lit(" Participações S.A.")).alias("registered"), F.col("p_partkey").alias("k")).where("k % 4 = 0").drop("k")


_FILED = "case p_partkey % 3 when 0 then upper(p_name) || ' Ltda.' when 1 then left(split_part(p_name, ' ', 1), 4) || ' ' || split_part(p_name, ' ', 2) else p_name end"
_CANON = lambda c: f"trim(regexp_replace(regexp_replace(translate(lower({c}), {_FOLD}), '\\s+(ltda|s\\.?a)\\.?\\s*$', ''), '[.]', ' ', 'g'))"


@query(f"""
with a as (select distinct p_brand as scope, {_FILED} as filed from part), b as (select distinct p_brand as scope, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' Participações S.A.' as registered from part where p_partkey % 4 = 0),
x as (select a.scope, filed, registered, {_CANON('filed')} as s, {_CANON('registered')} as l from a join b using (scope)),
t as (select *, string_split(s, ' ') as st, string_split(l, ' ') as lt from x)
select scope, filed, registered from t where len(list_filter(st, lambda w: length(w) >= 4)) > 0
  and list_reduce(lt, lambda j, w: case when try_cast(j as int) < len(st) and starts_with(w, st[try_cast(j as int) + 1]) then cast(try_cast(j as int) + 1 as varchar) else j end, '0') = cast(len(st) as varchar)""")
def entities_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered companies that names of files stand for, by brand as the case."""
    return match.same_entities(_filed(spark, sf_dir), _registered(spark, sf_dir), ["scope"], "filed", "registered")


@query(f"""
with o as (select o_orderkey, floor(o_custkey / 3) as case_id, {_sql_choose(_REFS, 'o_orderkey')} as ref from orders), y(ref, years) as (values {', '.join(f"('{r}', cast({v} as int[]))" for r, v in _YEARS.items())}),
p as (select o.*, years from o join y using (ref))
select a.case_id, a.o_orderkey as one, b.o_orderkey as two from p a join p b on a.case_id = b.case_id and a.o_orderkey % 2 = 0 and b.o_orderkey % 2 = 1 where len(a.years) = 0 or len(b.years) = 0 or list_has_any(a.years, b.years)""")
def periods_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an even and an odd order of a case whose periods share a year, or name none."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_custkey") / 3).alias("case_id"), _choose(_REFS, "o_orderkey").alias("ref"))
    one = o.where("o_orderkey % 2 = 0").select("case_id", F.col("o_orderkey").alias("one"), F.col("ref").alias("ref_a"))
    two = o.where("o_orderkey % 2 = 1").select("case_id", F.col("o_orderkey").alias("two"), F.col("ref").alias("ref_b"))
    return match.overlapping(one, two, ["case_id"], "ref_a", "ref_b").select("case_id", "one", "two")
