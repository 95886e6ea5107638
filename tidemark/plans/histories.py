"""Queries of histories: orders are the reviews of customers, the requests of dials, and diagnoses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import period
from ..operators import history
from ..operators import registration as reg
from .registry import query, read


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("document"),
        F.floor(k / 10).alias("case_id"),
        F.when(k % 4 > 0, F.col("c_mktsegment")).alias("kind"),
        F.when(k % 3 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("entity_id"),
        F.lit(None).cast("string").alias("period_id"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(0.5).alias("confidence"),
        F.lit("machine").alias("source"),
    )


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit(" Grupo "), (k % 5).cast("string"), F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("GRUPO "), (k % 5).cast("string")))
    reviews = o.select(
        F.col("o_custkey").alias("document"),
        k.alias("at"),
        F.when(k % 2 == 0, "ana").otherwise("rui").alias("author"),
        F.when(k % 4 == 0, F.element_at(F.array(*map(F.lit, ("BUILDING", "MACHINERY"))), (k % 8 / 4 + 1).cast("int"))).alias("kind"),
        name.alias("entity_name"),
        F.when(k % 5 > 1, "annual").alias("period_kind"),
        F.when(k % 2 == 0, F.year("o_orderdate").cast("string")).when(k % 7 == 0, " ").alias("period_ref"),
        F.when(k % 6 == 0, F.concat(F.lit("r"), k.cast("string"))).alias("reason"),
    )
    cases = read(spark, sf_dir, "customer").where("c_custkey % 10 < 3").select(F.floor(F.col("c_custkey") / 10).alias("case_id"), F.col("c_custkey"))
    entities = cases.select("case_id", F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("entity_id"), F.concat(F.lit("Grupo "), (F.col("c_custkey") % 10).cast("string")).alias("name"))
    periods = cases.select("case_id", F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("period_id"), F.lit("annual").alias("period_kind"), (F.lit(1998) + F.col("c_custkey") % 10).cast("string").alias("period_ref"))
    return history.reviewed(_documents(spark, sf_dir), reviews, entities, periods)


_SQL = """
with d as (select c_custkey as document, c_custkey // 10 as case_id, case when c_custkey % 4 > 0 then c_mktsegment end as kind, case when c_custkey % 3 = 0 then 'e' || c_custkey end as entity_id from customer),
r as (select o_custkey as document, o_orderkey as at_, case when o_orderkey % 2 = 0 then 'ana' else 'rui' end as author, case o_orderkey % 8 when 0 then 'BUILDING' when 4 then 'MACHINERY' end as new_kind,
  case when o_orderkey % 3 < 2 then 'grupo ' || (o_orderkey % 5) end as name, case when o_orderkey % 5 > 1 then 'annual' else 'other' end as period_kind, case when o_orderkey % 2 = 0 then year(o_orderdate)::varchar end as ref, case when o_orderkey % 6 = 0 then 'r' || o_orderkey end as new_reason from orders),
e as (select c_custkey // 10 as case_id, 'grupo ' || (c_custkey % 10) as name, 'e' || c_custkey as id from customer where c_custkey % 10 < 3),
p as (select c_custkey // 10 as case_id, 'annual' as period_kind, (1998 + c_custkey % 10)::varchar as ref, 'p' || c_custkey as id from customer where c_custkey % 10 < 3),
x as (select r.*, d.case_id, d.kind, d.entity_id, case when r.name is not null then coalesce(e.id, sha256(d.case_id || chr(1) || r.name)) end as new_entity, case when r.ref is not null then coalesce(p.id, sha256(d.case_id || chr(1) || r.period_kind || chr(1) || r.ref)) end as new_period
  from r join d using (document) left join e on e.case_id = d.case_id and e.name = r.name left join p on p.case_id = d.case_id and p.period_kind = r.period_kind and p.ref = r.ref),
h as (select document, case_id, at_ as "at", author, coalesce(last_value(new_kind ignore nulls) over b, kind) as kind_before, coalesce(last_value(new_kind ignore nulls) over u, kind) as kind_after,
  coalesce(last_value(new_entity ignore nulls) over b, entity_id) as entity_id_before, coalesce(last_value(new_entity ignore nulls) over u, entity_id) as entity_id_after,
  last_value(new_period ignore nulls) over b as period_id_before, last_value(new_period ignore nulls) over u as period_id_after, last_value(new_reason ignore nulls) over b as reason_before, last_value(new_reason ignore nulls) over u as reason_after
  from x window b as (partition by document order by at_ rows between unbounded preceding and 1 preceding), u as (partition by document order by at_ rows between unbounded preceding and current row))
"""


@query(_SQL + "select *, case when kind_before is distinct from kind_after then 'correction' else 'approval' end as decision from h")
def reviews_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review of a document with its kind, entity, period and reason before and after."""
    return _history(spark, sf_dir)


@query(_SQL + """select d.document, d.case_id, case when l.document is null then d.kind else l.kind_after end as kind, case when l.document is null then d.entity_id else l.entity_id_after end as entity_id,
  l.period_id_after as period_id, l.reason_after as reason, case when l.document is null then 0.5 else 1.0 end as confidence, case when l.document is null then 'machine' else 'human' end as source
  from d left join (select * from h qualify row_number() over (partition by document order by "at" desc) = 1) l using (document)""")
def documents_after_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as people left them; those without a review as they were."""
    return history.after_reviews(_documents(spark, sf_dir), _history(spark, sf_dir))


@query("""
with r as (select 's' || (o_custkey % 500) as stage, o_orderkey as at_, 'N' || (o_orderkey % 4) as level, case when o_orderkey % 3 = 0 then (o_orderkey % 10) / 10 end as threshold, o_custkey % 500 as s from orders),
k as (select *, case when s % 10 = 9 then null else 'N' || (1 + s % 3) end as ceiling from r),
m as (select *, case when ceiling is null then 'unknown' when level <= ceiling then 'moved' else 'refused' end as outcome from k)
select stage, at_ as "at", 'ana' as author, level as asked, outcome, case when ceiling is not null then coalesce(last_value(case when outcome = 'moved' then level end ignore nulls) over b, 'N0') end as level_before,
  case when ceiling is not null then coalesce(last_value(case when outcome = 'moved' then threshold end ignore nulls) over b, 0.9) end as threshold_before, case when ceiling is not null then coalesce(last_value(case when outcome = 'moved' then level end ignore nulls) over u, 'N0') end as level_after,
  case when ceiling is not null then coalesce(last_value(case when outcome = 'moved' then threshold end ignore nulls) over u, 0.9) end as threshold_after
from m window b as (partition by stage order by at_ rows between unbounded preceding and 1 preceding), u as (partition by stage order by at_ rows between unbounded preceding and current row)""")
def dials_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to move the level of a stage: moved, refused above its ceiling, or unknown."""
    s = F.col("o_custkey") % 500
    k = F.col("o_orderkey")
    name = F.concat(F.lit("s"), s.cast("string"))
    dials = read(spark, sf_dir, "orders").select(s.alias("s"), name.alias("stage")).where("s % 10 <> 9").distinct()
    dials = dials.select("stage", F.lit("N0").alias("level"), F.concat(F.lit("N"), (F.col("s") % 3 + 1).cast("string")).alias("ceiling"), F.lit(0.9).alias("threshold"))
    asked = read(spark, sf_dir, "orders").select(name.alias("stage"), k.alias("at"), F.lit("ana").alias("author"), F.concat(F.lit("N"), (k % 4).cast("string")).alias("level"), F.when(k % 3 == 0, k % 10 / 10).alias("threshold"))
    return history.dials_moved(dials, asked)


@query("""
with d as (select c_custkey as document, c_custkey // 10 as case_id, c_mktsegment as kind, case when c_custkey % 5 > 0 then 'Grupo ' || (c_custkey % 3) end as name, 1996 + c_custkey % 4 as y from customer),
g as (select o_custkey as document, o_orderkey as version, case when o_orderkey % 4 = 0 then o_orderkey % 8 = 0 end as confirms, case when o_orderkey % 6 = 0 then 'BUILDING' end as found_kind, case o_orderkey % 3 when 0 then ' GRUPO ' || (o_orderkey % 2) when 1 then ' ' end as found, case when o_orderkey % 5 > 0 then 1996 + o_orderkey % 4 end as fy, o_orderkey % 9 = 0 as illegible from orders),
x as (select * from g join d using (document)),
s as (select case_id, document, version, 'wrong_entity' as kind, lower(name) <> lower(trim(found)) as fires from x where name is not null and trim(found) <> '' union all
  select case_id, document, version, 'wrong_kind', not coalesce(confirms, true) or coalesce(found_kind <> kind, false) from x union all
  select case_id, document, version, 'wrong_period', coalesce(fy <> y, false) from x union all select case_id, document, version, 'illegible', illegible from x),
l as (select case_id, document, kind, arg_max(fires, version) as fires from s group by all),
h as (select case_id, document, 'wrong_kind' as kind from d where document % 2 = 0 union all select case_id, document, 'wrong_period' from d where document % 3 = 0),
b as (select coalesce(l.case_id, h.case_id) as case_id, coalesce(l.document, h.document) as document, coalesce(l.kind, h.kind) as kind, fires, h.document is not null as had from l full join h on l.document = h.document and l.kind = h.kind)
select case_id, document, kind, case when not had then 'opened' when coalesce(fires, true) then 'kept' else 'resolved' end as action from b where had or fires""")
def diagnosis_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that diagnoses of documents open, keep and resolve; periods are written in two ways."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    text = lambda n: n.cast("string")
    docs = read(spark, sf_dir, "customer").select(
        c.alias("document"), F.floor(c / 10).alias("case_id"), F.col("c_mktsegment").alias("kind"), F.when(c % 5 > 0, F.concat(F.lit("Grupo "), text(c % 3))).alias("entity_name"), F.concat(F.lit("12M"), F.right(text(F.lit(1996) + c % 4), F.lit(2))).alias("period_ref")
    )
    found = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document"), o.alias("version"), F.when(o % 4 == 0, o % 8 == 0).alias("confirms"), F.when(o % 6 == 0, "BUILDING").alias("found_kind"),
        F.when(o % 3 == 0, F.concat(F.lit(" GRUPO "), text(o % 2))).when(o % 3 == 1, " ").alias("found_entity"), F.when(o % 5 > 0, F.concat(F.lit("31/12/"), text(F.lit(1996) + o % 4))).alias("found_period"), F.when(o % 9 == 0, "illegible").alias("legibility"),
    )
    had = docs.where("document % 2 = 0").select("case_id", "document", F.lit("wrong_kind").alias("kind")).unionByName(docs.where("document % 3 = 0").select("case_id", "document", F.lit("wrong_period").alias("kind")))
    return reg.issues(history.diagnosed(docs, found, ~period.equivalent(F.col("period_ref"), F.col("found_period"))), had)
