"""Queries of links: parts are the lines of a case (their brand), orders ask to link and to remove."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links
from .labels import _choose, _sql_choose
from .registry import query, read

_ROLES = ["conta", "conta", "conta", "subtotal", "derivado"]
_CODES = ["growth", "inflation", "curve", "rate", "margin"]


def _case(c: str):
    """25 brands as cases, by number."""
    return F.concat(F.lit("Brand#"), (F.floor(F.col(c) / 5) % 5 + 1).cast("string"), (F.col(c) % 5 + 1).cast("string"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("case_id"), F.when(k % 4 > 0, F.concat(F.lit("s"), (k % 4).cast("string"))).alias("section"), F.concat(F.lit("Conta "), (k % 30).cast("string")).alias("label"), F.lit(None).cast("string").alias("entity"), k)


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a label's lines in a section the greatest part number has the role."""
    lines = _lines(spark, sf_dir)
    return lines.groupBy("case_id", "section", "label").agg(F.max("p_partkey").alias("k")).select("case_id", "section", "label", _choose(_ROLES, "k").alias("role"))


def _assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers activate assumptions for cases; the last customer decides."""
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(_case("c_custkey").alias("case_id"), F.element_at(F.array(*map(F.lit, _CODES)), (k % 4 + 1).cast("int")).alias("code"), (k % 3 > 0).alias("active"), k)
    return rows.groupBy("case_id", "code").agg(F.max_by("active", "c_custkey").alias("active"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        _case("o_custkey").alias("case_id"),
        F.when(o % 4 > 0, F.concat(F.lit("s"), (o % 4).cast("string"))).alias("section"),
        F.concat(F.lit(" CONTA  "), (o % 33).cast("string")).alias("label"),
        F.lit(None).cast("string").alias("entity"),
        F.when(o % 6 > 0, _choose(_CODES, "o_orderkey")).alias("assumption"),
        F.when(o % 7 == 0, "curve").alias("seasonality"),
        o.alias("at"),
        F.lit("ana").alias("author"),
    )


_CASE = lambda c: f"'Brand#' || ({c} // 5 % 5 + 1) || ({c} % 5 + 1)"
_SQL = f"""
with l as (select p_brand as case_id, case when p_partkey % 4 > 0 then 's' || (p_partkey % 4) end as section, 'conta ' || (p_partkey % 30) as label, p_partkey from part),
ro as (select case_id, section, label, {_sql_choose(_ROLES, 'max(p_partkey)')} as role from l group by all),
ac as (select {_CASE('c_custkey')} as case_id, {_sql_choose(_CODES[:4], 'c_custkey')} as code, arg_max(c_custkey % 3 > 0, c_custkey) as active from customer group by all),
rq as (select {_CASE('o_custkey')} as case_id, case when o_orderkey % 4 > 0 then 's' || (o_orderkey % 4) end as section, 'conta ' || (o_orderkey % 33) as label, case when o_orderkey % 6 > 0 then {_sql_choose(_CODES, 'o_orderkey')} end as assumption, case when o_orderkey % 7 = 0 then 'curve' end as seasonality, o_orderkey as at_ from orders),
dn as (select rq.*, ro.role, case when assumption is not null and coalesce(role <> 'conta', false) then 'not_an_account' when assumption is not null and not coalesce(a.active, false) then 'assumption_inactive' when seasonality is not null and not coalesce(s.active, false) then 'seasonality_inactive' else 'linked' end as outcome
  from rq left join ro on ro.case_id = rq.case_id and ro.section is not distinct from rq.section and ro.label = rq.label left join ac a on a.case_id = rq.case_id and a.code = assumption left join ac s on s.case_id = rq.case_id and s.code = seasonality),
lk as (select case_id, section, label, arg_max(coalesce(assumption, '-'), at_) as assumption, arg_max(coalesce(seasonality, '-'), at_) as seasonality from dn where outcome = 'linked' group by all)
"""


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.outcomes(_requests(spark, sf_dir), _roles(spark, sf_dir), _assumptions(spark, sf_dir))


@query(_SQL + """select case_id, section, label, assumption, seasonality, at_ as "at", role, outcome from dn""")
def links_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request to link a line with its outcome."""
    return _done(spark, sf_dir).drop("entity", "author")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _done(spark, sf_dir)
    return links.after_links(done.limit(0).select(*links.KEY, "assumption", "seasonality"), done)


@query(_SQL + "select case_id, section, label, nullif(assumption, '-') as assumption, nullif(seasonality, '-') as seasonality from lk")
def links_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that the last accepted requests leave."""
    return _links(spark, sf_dir).drop("entity")


@query(_SQL + f""", re as (select distinct {_CASE('s_suppkey')} as case_id, {_sql_choose([*_CODES, 'none'], 's_suppkey')} as code from supplier)
select re.case_id, re.code, outcome, case when outcome = 'removed' then (select count(*) from lk where lk.case_id = x.case_id and lk.assumption = x.code) else 0 end as n_links,
  case when outcome = 'removed' then (select count(*) from lk where lk.case_id = x.case_id and lk.seasonality = x.code) else 0 end as n_curves
from re join (select re.*, case when re.code = 'none' then 'unknown' when coalesce(ac.active, false) then 'removed' else 'not_active' end as outcome from re left join ac using (case_id, code)) x on x.case_id = re.case_id and x.code = re.code""")
def assumptions_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers ask to remove assumptions of cases; what goes with each."""
    asked = read(spark, sf_dir, "supplier").select(_case("s_suppkey").alias("case_id"), _choose([*_CODES, "none"], "s_suppkey").alias("code")).distinct()
    catalogue = spark.createDataFrame([(c,) for c in _CODES], "code string")
    return links.removals(asked, _assumptions(spark, sf_dir), catalogue, _links(spark, sf_dir))


@query(_SQL + """,
ba as (select distinct case_id, section, (['growth', 'inflation', 'curve', 'rate'])[at_ % 4 + 1] as assumption from rq where at_ % 50 = 0),
st as (select ba.*, coalesce(active, false) as active from ba left join ac on ac.case_id = ba.case_id and ac.code = assumption)
select st.case_id, st.section, st.assumption, case when active then 'applied' else 'assumption_inactive' end as outcome, case when active then count(l.label) filter (where role = 'conta') else 0 end as n_linked, case when active then count(l.label) filter (where role <> 'conta') else 0 end as n_passed
from st left join (select l.case_id, l.section, l.label, ro.role from l join ro on ro.case_id = l.case_id and ro.section is not distinct from l.section and ro.label = l.label) l on l.case_id = st.case_id and l.section is not distinct from st.section group by st.case_id, st.section, st.assumption, active""")
def sections_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sections linked at once: lines of other roles are passed over."""
    batches = _requests(spark, sf_dir).where("at % 50 = 0").select("case_id", "section", F.element_at(F.array(*map(F.lit, _CODES[:4])), (F.col("at") % 4 + 1).cast("int")).alias("assumption"), F.lit(None).cast("string").alias("seasonality"), F.lit(1).alias("at"), F.lit("ana").alias("author")).distinct()
    active = _assumptions(spark, sf_dir)
    done = links.outcomes(links.of_sections(batches, _lines(spark, sf_dir)), _roles(spark, sf_dir), active)
    return links.of_batches(batches, done, active).select("case_id", "section", "assumption", "outcome", "n_linked", "n_passed")
