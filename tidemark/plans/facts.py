"""Queries of the picking, reconciliation, guard, upsert and time-series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import pick, recon, series, upsert
from .registry import query, read


def _money(c: str):
    return F.col(c).cast("decimal(18,2)")


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(_money("l_extendedprice")).alias("det"), F.count("*").alias("n_lines"))


@query("""
with d as (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) det from lineitem group by l_orderkey),
j as (select o_orderkey, cast(o_totalprice as decimal(18,2)) hdr, det from orders left join d on l_orderkey = o_orderkey)
select o_orderkey, cast(hdr as double) as header, cast(det as double) as detail,
       case when det is null then 'unmet'
            when cast(abs(hdr - det) as double) > greatest(100.0, cast(abs(hdr) as double) * 0.005) then 'divergent' else 'ok' end as verdict
from j""")
def recon_header_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = read(spark, sf_dir, "orders").select("o_orderkey", _money("o_totalprice").alias("hdr"))
    joined = head.join(_details(spark, sf_dir), "o_orderkey", "left")
    return joined.select("o_orderkey", F.col("hdr").cast("double").alias("header"), F.col("det").cast("double").alias("detail"), recon.verdict(F.col("hdr"), F.col("det"), 100, 0.005).alias("verdict"))


@query("""
with d as (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) det, count(*) n from lineitem group by l_orderkey)
select o_orderkey, cast(case when n >= 5 then det when cast(o_totalprice as decimal(18,2)) > 400000 then cast(o_totalprice as decimal(18,2)) else coalesce(det, 0) end as double) as value,
  case when n >= 5 then 'lines' when cast(o_totalprice as decimal(18,2)) > 400000 then 'header' when det is not null then 'few lines' else 'none' end as origin
from orders left join d on l_orderkey = o_orderkey""")
def recon_cascade_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", _money("o_totalprice").alias("hdr")).join(_details(spark, sf_dir), "o_orderkey", "left")
    steps = [("lines", F.when(F.col("n_lines") >= 5, F.col("det"))), ("header", F.when(F.col("hdr") > 400000, F.col("hdr"))), ("few lines", F.col("det")), ("none", F.lit(0).cast("decimal(28,2)"))]
    return pick.cascade(rows, steps).select("o_orderkey", F.col("value").cast("double").alias("value"), "origin")


@query("select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events group by user_id")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick.latest_version(read(spark, sf_dir, "events"), ["user_id"], "event_id", "value")


@query("""select o_custkey, max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders
where exists (select 1 from lineitem where l_orderkey = o_orderkey) group by o_custkey""")
def latest_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return pick.latest_version(full, ["o_custkey"], "o_orderkey", "o_totalprice")


@query("""
with r as (select user_id, cast(ts as date) as day, event_type, event_id, value, row_number() over (partition by user_id, cast(ts as date) order by case event_type when 'purchase' then 0 else 1 end, event_id) as k from events)
select user_id, day, event_type, event_id, value from r where k = 1""")
def distinct_on_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id", "value")
    return pick.first_per_key(rows, ["user_id", "day"], [F.when(F.col("event_type") == "purchase", 0).otherwise(1), F.col("event_id")])


@query("""
with c as (select p_brand, p_type, count(*) n from part group by all), r as (select *, row_number() over (partition by p_brand order by n desc, p_type) k from c)
select p_brand, p_type, n from r where k = 1""")
def mode_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick.mode(read(spark, sf_dir, "part"), ["p_brand"], "p_type")


@query("""
with p as (select event_id, user_id, ts from events where event_type = 'purchase'), e as (select user_id, ts, value from events where event_type = 'error')
select p.event_id, p.user_id, e.value as last_error from p asof left join e on p.user_id = e.user_id and p.ts > e.ts""")
def as_of_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'error'").select("user_id", "ts", F.col("value").alias("last_error"))
    return pick.as_of(left, right, ["user_id"], "ts", "ts", "last_error").select("event_id", "user_id", "last_error")


@query("""
with t as (select l_suppkey, max(abs(l_quantity)) as top from lineitem group by 1),
c as (select l_suppkey, l_quantity, count(distinct l_partkey) as n from lineitem group by 1, 2),
r as (select c.*, row_number() over (partition by l_suppkey order by n desc, abs(l_quantity) desc, l_quantity desc) as k from c join t using (l_suppkey) where abs(l_quantity) >= greatest(top * 0.01, 1.0))
select l_suppkey, l_quantity, n as n_labels, n >= 4 as suspicious from r where k = 1""")
def repeated_value_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.repeated_values(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_partkey")


@query("""select l_suppkey, count(*) as n, count(*) filter (where l_discount * 10 < 0.35) as n_low,
  count(*) filter (where l_discount * 10 < 0.35) >= 3 and count(*) filter (where l_discount * 10 < 0.35) / count(*) >= 0.3 as too_low from lineitem group by l_suppkey""")
def low_confidence_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") * 10).alias("score"))
    return recon.low_confidence(rows, ["l_suppkey"], "score", below=0.35)


@query("""select l_suppkey, year(l_shipdate) as year, arg_max(v, (abs(v), v)) as value, count(*) as n
from (select *, cast(l_extendedprice as decimal(18,2)) - 50000 as v from lineitem) group by 1, 2""")
def values_by_year_maxabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _money("l_extendedprice") - 50000
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), v.cast("decimal(18,2)").alias("v"))
    return rows.groupBy("l_suppkey", "year").agg(F.max_by("v", F.struct(F.abs("v"), "v")).cast("double").alias("value"), F.count("*").alias("n"))


@query("""
with l as (select p_brand, p_name, p_type, l_returnflag, cast(l_extendedprice as decimal(18,2)) v from lineitem join part on l_partkey = p_partkey),
g as (select p_brand, p_name, count(*) n, cast(max(abs(v)) as double) top, max(l_returnflag) unit, array_to_string(list_sort(list_distinct(list(p_type))), '|') kinds from l group by 1, 2)
select g.*, exists (select 1 from g h where h.p_brand = g.p_brand and h.p_name <> g.p_name and split_part(h.p_name, ' ', 2) = split_part(g.p_name, ' ', 2)) as overlaps from g""")
def modelling_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical lines of a section; two overlap where they share their last word."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = rows.groupBy("p_brand", "p_name").agg(
        F.count("*").alias("n"), F.max(F.abs(_money("l_extendedprice"))).cast("double").alias("top"), F.max("l_returnflag").alias("unit"),
        F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("kinds"),
    )
    last = F.element_at(words(F.col("p_name")), 2)
    shared = g.groupBy("p_brand", last.alias("_w")).agg((F.count("*") > 1).alias("overlaps"))
    return g.withColumn("_w", last).join(shared, ["p_brand", "_w"], "left").select(*g.columns, F.coalesce("overlaps", F.lit(False)).alias("overlaps"))


_MONTHLY = """with m as (select o_orderpriority as serie, cast(date_trunc('month', o_orderdate) as date) as d, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'taxa' else 'nivel' end as nature,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then count(*) / 1000.0 else cast(sum(cast(o_totalprice as decimal(18,2))) as double) end as v from orders group by 1, 2),
y as (select serie, nature, cast(year(d) as integer) as year, count(*) as months, (exp(sum(ln(1 + v / 100))) - 1) * 100 as rate, arg_max(v, d) as last_v from m group by all),
a as (select y.*, (select v from m where m.serie = y.serie and m.d < make_date(y.year, 1, 1) order by d desc limit 1) as base from y),
r as (select serie, nature, year, months, round(case when nature = 'taxa' then rate else (last_v / nullif(base, 0) - 1) * 100 end, 6) as annual_return from a)
"""


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("serie"), month.alias("d")).agg(F.count("*").alias("n"), F.sum(_money("o_totalprice")).cast("double").alias("s"))
    rate = F.col("serie").isin("1-URGENT", "2-HIGH")
    return rows.select("serie", "d", F.when(rate, "taxa").otherwise("nivel").alias("nature"), F.when(rate, F.col("n") / 1000.0).otherwise(F.col("s")).alias("v"))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = series.annual_return(_monthly(spark, sf_dir), ["serie"], "d", "v", "nature")
    return r.withColumn("annual_return", F.round("annual_return", 6))


@query(_MONTHLY + "select serie, nature, year, months, annual_return from r")
def annual_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returns(spark, sf_dir).select("serie", "nature", "year", "months", "annual_return")


@query(_MONTHLY + """, k as (select *, row_number() over (partition by serie order by year desc) as i from r where months = 12 and annual_return is not null)
select serie, case when count(*) = 3 then round((exp(avg(ln(1 + annual_return / 100))) - 1) * 100, 6) end as geo_mean from k where i <= 3 group by serie""")
def geo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.geometric_mean(_returns(spark, sf_dir), ["serie"], "year", "annual_return", "months", 3).withColumn("geo_mean", F.round("geo_mean", 6))


@query("""
with s as (select user_id, cast(ts as date) as day, event_type, cast(sum(cast(value as decimal(18,2))) as double) as v from events group by all)
select a.user_id, a.day, a.event_type as source_a, b.event_type as source_b, a.v as value_a, b.v as value_b from s a join s b using (user_id, day) where b.event_type > a.event_type and abs(a.v - b.v) > 50""")
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.sum(_money("value")).cast("double").alias("v"))
    return series.divergences(rows, ["user_id", "day"], "event_type", "v", 50).select("user_id", "day", "source_a", "source_b", "value_a", "value_b")


@query("""
with m as (select o_orderpriority, cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, cast(abs(sum(cast(o_totalprice as decimal(18,2)))) as double) as v from orders group by all),
w as (select *, count(*) over (partition by o_orderpriority, year) as n, sum(v) over (partition by o_orderpriority, year) as t from m)
select o_orderpriority, year, month, round(v / t, 9) as share from w where n = 12""")
def seasonality_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), _money("o_totalprice").alias("v"))
    out = series.seasonality(rows, ["o_orderpriority", "year"], "month", "v")
    return out.select("o_orderpriority", "year", "month", F.round(F.col("share").cast("double"), 9).alias("share"))


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def completeness_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.missing(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""
with c as (select o_custkey, count(*) filter (where o_orderstatus = 'P') as n_open, count(*) filter (where o_orderpriority = '1-URGENT') as n_urgent, count(*) as n from orders group by 1)
select o_custkey, n_open <= 3 and n_urgent <= 2 and n <= 12 as passes, concat_ws(',', case when n_open > 3 then 'open' end, case when n_urgent > 2 then 'urgent' end, case when n > 12 then 'many' end) as reasons from c""")
def gate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("n_open"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"), F.count("*").alias("n"))
    passes, reasons = recon.gate([("open", F.col("n_open"), F.lit(3)), ("urgent", F.col("n_urgent"), F.lit(2)), ("many", F.col("n"), F.lit(12))])
    return c.select("o_custkey", passes.alias("passes"), F.array_join(reasons, ",").alias("reasons"))


_SPLIT = "2024-01-15"
_BATCHES = f"""with o as (select user_id, event_type, count(*) as n from events where ts < timestamp '{_SPLIT}' and user_id % 7 <> 3 group by all),
n as (select user_id, event_type, count(*) as n from events where ts >= timestamp '{_SPLIT}' and user_id % 5 <> 1 group by all),
j as (select coalesce(o.user_id, n.user_id) as user_id, coalesce(o.event_type, n.event_type) as event_type, coalesce(n.n, o.n) as n,
  case when o.n is null then 'insert' when n.n is null then 'kept' when o.n = n.n then 'noop' else 'update' end as action from o full join n on o.user_id = n.user_id and o.event_type = n.event_type)
"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    at = F.lit(_SPLIT).cast("timestamp")
    count = lambda df: df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return upsert.merge(count(e.where((F.col("ts") < at) & (F.col("user_id") % 7 != 3))), count(e.where((F.col("ts") >= at) & (F.col("user_id") % 5 != 1))), ["user_id", "event_type"], ["n"])


@query(_BATCHES + "select user_id, event_type, n, action from j")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("user_id", "event_type", "n", "action")


@query(_BATCHES + "select action, count(*) as n from j group by action")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.counts(_merged(spark, sf_dir))


@query(f"""with a as (select distinct user_id, event_type from events where ts < timestamp '{_SPLIT}' and value > 60), b as (select distinct user_id, event_type from events where ts >= timestamp '{_SPLIT}' and value > 60)
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.event_type, b.event_type) as event_type, case when a.user_id is null then 'opened' when b.user_id is null then 'resolved' else 'refreshed' end as state
from a full join b on a.user_id = b.user_id and a.event_type = b.event_type""")
def settle_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("value > 60")
    at = F.lit(_SPLIT).cast("timestamp")
    return upsert.settle(e.where(F.col("ts") < at), e.where(F.col("ts") >= at), ["user_id", "event_type"])


@query("""
with r as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events)
select event_id, user_id, event_type, case when k = 1 then 'open' else 'resolved' end as status from r""")
def newest_stays_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of each key stays open; a join with the newest, not a sort of hot keys."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    newest = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("_m"))
    status = F.when(F.col("event_id") == F.col("_m.event_id"), "open").otherwise("resolved")
    return e.join(newest, ["user_id", "event_type"]).select("event_id", "user_id", "event_type", status.alias("status"))


@query("select p_brand as name from part union select s_name from supplier union select n_name from nation")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("part", "p_brand"), ("supplier", "s_name"), ("nation", "n_name"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("select p_name, n from (select p_name, count(*) n from part group by 1) order by n desc, p_name limit 12")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(12)


@query("select r_name, string_agg(n_name, '; ' order by n_name) as nations from nation join region on n_regionkey = r_regionkey group by r_name")
def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("nations"))


@query("""select conv_id, count(*) as turns, cast(sum(length(text)) as bigint) as chars, round(sum(case role when 'assistant' then length(text) * 0.6 else length(text) * 0.15 end) / 1000000, 9) as cost,
  cast(floor(5 / (sum(case role when 'assistant' then length(text) * 0.6 else length(text) * 0.15 end) / 1000000)) as bigint) as fits from conversations group by conv_id""")
def call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage times price, and how many such calls a budget of 5 pays for."""
    price = F.when(F.col("role") == "assistant", 0.6).otherwise(0.15)
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), (F.sum(F.length("text") * price) / 1000000).alias("c"))
    return c.select("conv_id", "turns", "chars", F.round("c", 9).alias("cost"), F.floor(5 / F.col("c")).cast("long").alias("fits"))
