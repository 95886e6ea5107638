"""Queries of the case operators, of set and array predicates, and of functions over real columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import period, text
from ..operators import cases, project, series, upsert
from ..operators.pick import first_per_key
from .labels import _choose, _sql_choose, _sql_normal
from .registry import query, read

_CASE = "cast(floor(o_custkey / 10) as bigint)"
_KINDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("case_id", F.floor(F.col("o_custkey") / 10))


@query(f"""
with o as (select {_CASE} as case_id, o_orderkey, o_orderpriority as kind from orders where o_orderdate >= '1998-03-01'),
l as (select distinct l_orderkey from lineitem where l_quantity >= 45), c as (select distinct {_CASE} as case_id from orders),
s as (select c.case_id, k.kind, count(o.o_orderkey) as had, count(l.l_orderkey) as full_ from c cross join (select unnest({_KINDS}) as kind) k left join o on o.case_id = c.case_id and o.kind = k.kind left join l on l_orderkey = o_orderkey group by all)
select case_id, coalesce(array_to_string(list_sort(list(kind) filter (where had = 0)), '|'), '') as missing, coalesce(array_to_string(list_sort(list(kind) filter (where had > 0 and full_ = 0)), '|'), '') as empty,
  case when count(*) filter (where had = 0) > 0 then 'missing' when count(*) filter (where full_ = 0) > 0 then 'empty' else 'complete' end as status from s group by case_id""")
def completeness_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the last months' orders: not there, or there without a large line."""
    orders = _orders(spark, sf_dir)
    late = orders.where("o_orderdate >= '1998-03-01'").select("case_id", "o_orderkey", F.col("o_orderpriority").alias("kind"))
    lines = read(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    wanted = spark.createDataFrame([(k,) for k in _KINDS], "kind string")
    out = cases.completeness(orders, wanted, late, lines, "case_id", "kind", "o_orderkey")
    return out.select("case_id", F.concat_ws("|", "missing").alias("missing"), F.concat_ws("|", "empty").alias("empty"), "status")


@query(f"""
with r as (select o_custkey, list(distinct o_orderpriority) as got from orders group by 1)
select o_custkey, coalesce(array_to_string(list_sort(list_filter({_KINDS}, lambda k: not list_contains(got, k))), '|'), '') as missing,
  array_to_string(list_sort(list_filter({_KINDS}, lambda k: list_contains(got, k))), '|') as present, len(got) = 5 as complete from r""")
def completeness_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("got"))
    missing, present, complete = cases.set_completeness(F.array(*map(F.lit, _KINDS)), F.col("got"))
    return rows.select("o_custkey", F.array_join(missing, "|").alias("missing"), F.array_join(present, "|").alias("present"), complete.alias("complete"))


_ROLES = ["subtotal", "serie_mensal", "derivado", "conta"]


@query(f"""
with f as (select {_CASE} as case_id, case when l_suppkey % 4 = 0 then null else 's' || (l_suppkey % 4) end as section, 'p' || (l_partkey % 9) as label, l_linenumber % 4 as p from lineitem join orders on l_orderkey = o_orderkey),
a as (select case_id, label, min(p) as pa from f group by all)
select case_id, section, label, case when section is null then {_sql_choose(_ROLES, 'min(pa)')} else {_sql_choose(_ROLES, 'min(p)')} end as role from f join a using (case_id, label) group by case_id, section, label""")
def role_in_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    section = F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")))
    rows = rows.select("case_id", section.alias("section"), F.concat(F.lit("p"), (F.col("l_partkey") % 9).cast("string")).alias("label"), (F.col("l_linenumber") % 4).alias("p"))
    return cases.role_of_labels(rows, "case_id", "section", "label", _choose(_ROLES, "p"), F.col("p"))


@query(f"""
with d as (select {_CASE} as case_id, o_orderkey as doc, o_orderdate, case when o_orderkey % 11 = 0 then null when o_orderkey % 11 = 1 then ' ' else md5(cast(cast(o_totalprice / 5000 as bigint) as varchar)) end as digest,
  o_orderkey % 13 = 0 as human, {_sql_choose(_ROLES, 'o_orderkey')} as kind, case when o_orderkey % 3 > 0 then o_custkey end as entity from orders),
g as (select *, coalesce('=' || nullif(trim(digest), ''), '#' || doc) as content from d),
v as (select *, row_number() over w as version, min(case when human then n end) over w as first_human, max(case when entity is not null then n end) over w as last_entity from (select *, row_number() over (partition by case_id, content order by o_orderdate, doc) as n from g) window w as (partition by case_id, content order by n)),
e as (select v.*, x.entity as filled from v left join v x on x.case_id = v.case_id and x.content = v.content and x.n = v.last_entity)
select e.case_id, e.digest, e.doc, o.doc as document, cast(e.version as integer) as version, e.version > 1 as repeated, coalesce(h.kind, e.kind) as kind, case when h.n is not null then h.filled else e.filled end as entity
from e join v o on o.case_id = e.case_id and o.content = e.content and o.n = 1 left join e h on h.case_id = e.case_id and h.content = e.content and h.n = e.first_human""")
def documents_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a case with prices in the same step of 5,000 count as the same content; some have no digest, some come from a human."""
    # half a step goes to the even one, as SQL's cast to an integer has it
    step = F.rint(F.col("o_totalprice").cast("double") / 5000).cast("long")
    k = F.col("o_orderkey")
    digest = F.when(k % 11 == 0, None).when(k % 11 == 1, " ").otherwise(F.md5(step.cast("string").cast("binary")))
    docs = read(spark, sf_dir, "orders").withColumn("digest", digest).withColumn("kind", _choose(_ROLES, "o_orderkey")).withColumn("entity", F.when(k % 3 > 0, F.col("o_custkey")))
    docs = docs.select(F.floor(F.col("o_custkey") / 10).alias("case_id"), k.alias("doc"), "o_orderdate", "digest", "kind", "entity")
    return cases.registered(docs, "case_id", "digest", [F.col("o_orderdate")], "doc", F.col("doc") % 13 == 0, replaced=["kind"], filled=["entity"])


@query("""
with f as (select l_suppkey, case l_linenumber % 3 when 0 then 'N1' when 1 then 'N2' else 'N3' end as dial, l_discount * 10 as conf, l_returnflag = 'R' as flagged, l_linenumber = 5 as human, cast(l_quantity as double) as v, case when l_partkey % 5 = 0 then null else floor(l_quantity / 2) * 2 end as t from lineitem),
a as (select *, dial in ('N2', 'N3') and conf >= 0.4 and not flagged and not human as ok from f)
select l_suppkey, count(*) filter (where ok) as eligible, count(*) filter (where ok and t is not null and abs(v - t) <= 0) / count(*) filter (where ok and t is not null) as agreement,
  count(*) filter (where ok and t is null) / count(*) filter (where ok) as uncheckable from a group by 1""")
def auto_accept_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").withColumn("dial", F.when(n % 3 == 0, "N1").when(n % 3 == 1, "N2").otherwise("N3"))
    rows = cases.accepted(rows, F.col("dial"), F.col("l_discount") * 10, F.lit(0.4), F.col("l_returnflag") == "R", n == 5)
    truth = F.when(F.col("l_partkey") % 5 != 0, F.floor(F.col("l_quantity") / 2) * 2)
    return cases.agreement(rows, ["l_suppkey"], F.col("auto_accepted"), F.col("l_quantity"), truth, within=0.0)


_CATALOG = [("growth", True, ["BUILDING", "MACHINERY"]), ("inflation", True, []), ("rate", False, []), ("margin", True, ["AUTOMOBILE"])]


@query("""
with c(name, active, sectors) as (values ('growth', true, ['BUILDING', 'MACHINERY']), ('inflation', true, []), ('rate', false, []), ('margin', true, ['AUTOMOBILE']))
select c_custkey, name from customer join c on active and (len(sectors) = 0 or list_contains(sectors, c_mktsegment))""")
def assumptions_suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.createDataFrame(_CATALOG, "name string, active boolean, sectors array<string>")
    return cases.suggested(catalog, read(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", "sectors", "active").select("c_custkey", "name")


@query("""
with s as (select s_suppkey, s_nationkey, s_acctbal < 0 as off from supplier)
select l_orderkey, l_linenumber, l_suppkey as s_suppkey, not off as active from lineitem join s on s_suppkey = l_suppkey""")
def deactivation_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    return cases.deactivated(links, read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id")), "id", "s_suppkey")


@query("""
with l as (select p_partkey, p_brand, case p_size % 3 when 0 then 'conta' when 1 then 'derivado' else 'serie_mensal' end as role from part),
a as (select p_brand, min(p_partkey) as assumption from part where p_size > 40 and p_partkey % 2 = 0 group by 1)
select p_partkey, p_brand, role, assumption, assumption is null as orphan from l left join a using (p_brand) where role in ('conta', 'serie_mensal')""")
def lines_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole section is linked at once; derived lines take no assumption."""
    k = F.col("p_size") % 3
    parts = read(spark, sf_dir, "part")
    lines = parts.select("p_partkey", "p_brand", F.when(k == 0, "conta").when(k == 1, "derivado").otherwise("serie_mensal").alias("role"))
    chosen = parts.where("p_size > 40 and p_partkey % 2 = 0").groupBy("p_brand").agg(F.min("p_partkey").alias("assumption"))
    return cases.linked(lines, chosen, ["p_brand"], "role", ["conta", "serie_mensal"]).withColumn("orphan", F.col("assumption").isNull())


@query(f"""select {_CASE} as case_id, count(*) as n_lines, count(distinct l_partkey % 40) as n_labels, count(*) filter (where l_discount > 0.08) as orphans, count(*) filter (where l_discount > 0.08) = 0 as ready
from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def modelling_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    orphans = F.count_if(F.col("l_discount") > 0.08)
    return rows.groupBy("case_id").agg(F.count("*").alias("n_lines"), F.count_distinct(F.col("l_partkey") % 40).alias("n_labels"), orphans.alias("orphans"), (orphans == 0).alias("ready"))


@query("""
with o as (select o_custkey, o_orderkey, o_orderdate, o_orderpriority from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 30)),
m as (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) r from o)
select o_custkey, o_orderpriority, count(*) as n_lines from m join lineitem on l_orderkey = o_orderkey where r = 1 group by all""")
def lines_of_a_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the newest order of each kind that has a large line."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    full = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority").join(lines.where("l_quantity > 30"), "o_orderkey", "left_semi")
    newest = full.groupBy("o_custkey", "o_orderpriority").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))
    return newest.join(lines, "o_orderkey").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n_lines"))


@query(f"""
with r as (select *, row_number() over (partition by {_sql_normal('p_type')} order by p_partkey) k, {_sql_normal('p_type')} as key from part)
select key, max(p_type) filter (where k = 1) as label, count(*) as n from r group by key""")
def by_normal_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").withColumn("key", text.normalize(F.col("p_type")))
    return rows.groupBy("key").agg(F.min(F.struct("p_partkey", "p_type"))["p_type"].alias("label"), F.count("*").alias("n"))


@query("select s_nationkey as key, 'both' as side from supplier intersect select c_nationkey, 'both' from customer union all (select c_custkey, 'no orders' from customer except select o_custkey, 'no orders' from orders where o_orderdate < '1993-01-01')")
def intersect_and_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda t, c: read(spark, sf_dir, t).select(F.col(c).cast("long").alias("key"))
    both = key("supplier", "s_nationkey").intersect(key("customer", "c_nationkey")).withColumn("side", F.lit("both"))
    return both.union(key("customer", "c_custkey").subtract(read(spark, sf_dir, "orders").where("o_orderdate < '1993-01-01'").select(F.col("o_custkey").cast("long").alias("key"))).withColumn("side", F.lit("no orders")))


@query("select o_orderkey from orders, (select list(n_nationkey) as keys from nation where n_regionkey = 2) k where o_custkey % 25 = any (keys)")
def equal_to_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantified predicate: the array has as many elements as a region has nations."""
    keys = read(spark, sf_dir, "nation").where("n_regionkey = 2").agg(F.collect_list("n_nationkey").alias("keys"))
    return read(spark, sf_dir, "orders").join(F.broadcast(keys), F.expr("array_contains(keys, o_custkey % 25)")).select("o_orderkey")


@query("""select o_custkey, list_sort(list(o_orderkey))[1] as first_order, list_sum(list(o_totalprice)) > 500000 as large, len(list(o_orderkey)) as n from orders group by 1""")
def embedded_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a customer as a nested column, and what is read back from it; a customer's orders are few."""
    nested = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("orders"))
    total = F.aggregate("orders", F.lit(0.0), lambda a, x: a + x["o_totalprice"].cast("double"))
    return nested.select("o_custkey", F.array_min(F.col("orders.o_orderkey")).alias("first_order"), (total > 500000).alias("large"), F.size("orders").cast("long").alias("n"))


@query("""select n_nationkey as key, n_name as name, cast(null as double) as balance from nation union all select s_suppkey, null, cast(s_acctbal as double) from supplier""")
def column_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_acctbal").cast("double").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""
with s as (select o_custkey, cast(year(o_orderdate) as integer) as year, o_orderdate, o_orderkey, cast(o_totalprice as double) as v from orders)
select o_custkey, year, arg_max(v, (o_orderdate, o_orderkey)) as closing from s group by all""")
def closing_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderdate", "o_orderkey", F.col("o_totalprice").cast("double").alias("v"))
    return rows.groupBy("o_custkey", "year").agg(F.max_by("v", F.struct("o_orderdate", "o_orderkey")).alias("closing"))


@query("""
with r as (select s_suppkey, (s_suppkey % 40) / 100.0 as a, (s_suppkey % 7) / 100.0 as b, s_suppkey % 6 as n from supplier)
select s_suppkey, pow(1 + a, 1.0 / 12) - 1 as monthly, case when a > 0 and n > 0 then pow((a + b) / a, 1.0 / n) - 1 end as growth, (1 + a) / (1 + b) - 1 as real, (1 + a) * (1 + b) - 1 as combined from r""")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    r = read(spark, sf_dir, "supplier").select("s_suppkey", (k % 40 / 100.0).alias("a"), (k % 7 / 100.0).alias("b"), (k % 6).alias("n"))
    a, b = F.col("a"), F.col("b")
    return r.select("s_suppkey", series.monthly_rate(a).alias("monthly"), series.cagr(a, a + b, F.col("n")).alias("growth"), series.real_growth(a, b).alias("real"), project.combined_index(a, b).alias("combined"))


@query("""
with r as (select o_orderkey, year(o_orderdate) as y, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%d/%m/%Y') when 1 then strftime(o_orderdate, '%Y') || ', 1990' when 2 then '' else 'L24M' end as ref, case o_orderkey % 3 when 0 then 'Saldo ' || year(o_orderdate) else 'Saldo' end as col from orders)
select o_orderkey, case o_orderkey % 4 when 0 then cast(y as varchar) when 1 then '1990|' || y else '' end as targets, cast(case when o_orderkey % 3 = 0 then y when o_orderkey % 4 in (0, 1) then case when o_orderkey % 4 = 1 then y else y end end as integer) as column_year,
  case when o_orderkey % 4 in (2, 3) then true when o_orderkey % 4 = 0 then y = 1995 else false end as same_as_1995 from r""")
def period_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    ref = F.when(k % 4 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 4 == 1, F.concat(F.date_format(d, "yyyy"), F.lit(", 1990"))).when(k % 4 == 2, "").otherwise("L24M")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", ref.alias("ref"), F.concat(F.lit("Saldo"), F.when(k % 3 == 0, F.concat(F.lit(" "), F.date_format(d, "yyyy"))).otherwise("")).alias("col"))
    year = F.when((k % 3 == 0) | (k % 4).isin(0, 1), period.year_of_column(F.col("col"), F.when(k % 4 != 2, F.col("ref"))))
    return rows.select("o_orderkey", F.array_join(period.target_years(F.col("ref")), "|").alias("targets"), year.alias("column_year"), period.equivalent(F.col("ref"), F.lit("1995")).alias("same_as_1995"))


@query("""select user_id, max(event_id) as event_id, true as had from events where event_id % 97 = 0 group by user_id
union all select user_id, min(event_id), false from events where user_id not in (select user_id from events where event_id % 97 = 0) group by user_id""")
def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An idempotent seed: rows are put in only for keys that have none."""
    events = read(spark, sf_dir, "events")
    old = events.where("event_id % 97 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id")).withColumn("had", F.lit(True))
    return upsert.insert_missing(old, events.groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("had", F.lit(False)), ["user_id"])


@query("""
with v as (select n_regionkey as node, sum(cast(c_acctbal as double)) as own, count(*) as n from customer join nation on n_nationkey = c_nationkey where c_acctbal < 0 group by 1)
select node, round(own, 2) as own, round(-own, 2) as shown, n from v""")
def signs_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of claims are shown with their sign turned."""
    rows = read(spark, sf_dir, "customer").where("c_acctbal < 0").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.sum(F.col("c_acctbal").cast("double"))
    return rows.groupBy(F.col("n_regionkey").alias("node")).agg(F.round(own, 2).alias("own"), F.round(-own, 2).alias("shown"), F.count("*").alias("n"))


@query("""
with o as (select o_custkey, cast(year(o_orderdate) as integer) as year, count(*) as n from orders group by all),
s(scenario, growth) as (values ('base', 0.05), ('stress', -0.1), ('upside', 0.15))
select o_custkey, year, scenario, n * pow(1 + growth, year - min(year) over (partition by o_custkey, scenario)) as projected from o, s""")
def growth_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios = spark.createDataFrame([("base", 0.05), ("stress", -0.1), ("upside", 0.15)], "scenario string, growth double")
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    first = F.min("year").over(Window.partitionBy("o_custkey"))
    rows = rows.withColumn("k", F.col("year") - first).join(F.broadcast(scenarios), F.lit(True))
    return rows.select("o_custkey", "year", "scenario", (F.col("n") * F.pow(1 + F.col("growth"), F.col("k"))).alias("projected"))


@query("""
with m as (select o_custkey, cast(year(o_orderdate) as integer) as year, month(o_orderdate) as m, sum(cast(o_totalprice as double)) as v, max(o_orderdate) as d from orders group by all)
select o_custkey, year, sum(v) as flow, arg_max(v, m) as stock, avg(v) as rate from m group by all""")
def annual_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of months as a flow (sum), a stock (the last month) and a rate (the mean)."""
    monthly = read(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("m")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("v"))
    return monthly.groupBy("o_custkey", "year").agg(F.sum("v").alias("flow"), F.max_by("v", "m").alias("stock"), F.avg("v").alias("rate"))


@query("""
with b as (select c_custkey, abs(cast(c_acctbal as double)) + 1 as ca, c_custkey % 97 as cl, c_custkey % 11 * 100.0 as lt, c_custkey % 5 * 50.0 as nl, c_custkey % 7 * 10.0 as eq from customer)
select c_custkey, case when cl <> 0 then ca / cl end as current_ratio, case when cl + nl <> 0 then (ca + lt) / (cl + nl) end as general_ratio,
  case when eq <> 0 then (cl + nl) / eq end as debt_to_equity, case when cl + nl <> 0 then cl / (cl + nl) end as short_share, ca + lt - cl - nl - eq as plug, abs(ca + lt - cl - nl - eq) < 0.5 as closes from b""")
def balance_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios with null at zero denominators, the plug that closes the balance, and whether it closes by itself."""
    k = F.col("c_custkey")
    b = read(spark, sf_dir, "customer").select("c_custkey", (F.abs(F.col("c_acctbal").cast("double")) + 1).alias("ca"), (k % 97).alias("cl"), (k % 11 * 100.0).alias("lt"), (k % 5 * 50.0).alias("nl"), (k % 7 * 10.0).alias("eq"))
    ca, cl, lt, nl, eq = (F.col(c) for c in ("ca", "cl", "lt", "nl", "eq"))
    plug = ca + lt - cl - nl - eq
    return b.select(
        "c_custkey", project.ratio(ca, cl).alias("current_ratio"), project.ratio(ca + lt, cl + nl).alias("general_ratio"), project.ratio(cl + nl, eq).alias("debt_to_equity"),
        project.ratio(cl, cl + nl).alias("short_share"), plug.alias("plug"), (F.abs(plug) < 0.5).alias("closes"),
    )


@query("""
with y as (select s_nationkey, s_suppkey % 6 + 2020 as year, sum(abs(cast(s_acctbal as double))) as capex from supplier group by all)
select s_nationkey, year, capex, sum(capex) over w as gross, sum(capex) over w * 0.1 as depreciation, sum(capex) over w - sum(capex * 0.1 * (2025 - year + 1)) over w as net_2025 from y window w as (partition by s_nationkey order by year)""")
def capex_roll_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed assets: gross balance, straight-line depreciation of a tenth a year, net at the last year."""
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = read(spark, sf_dir, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 6 + 2020).alias("year")).agg(F.sum(F.abs(F.col("s_acctbal").cast("double"))).alias("capex"))
    gross = F.sum("capex").over(w)
    return y.select("s_nationkey", "year", "capex", gross.alias("gross"), (gross * 0.1).alias("depreciation"), (gross - F.sum(F.col("capex") * 0.1 * (2025 - F.col("year") + 1)).over(w)).alias("net_2025"))


@query("""
with y as (select o_custkey, cast(year(o_orderdate) as integer) as year, sum(cast(o_totalprice as double)) as profit, count(*) * 100.0 as depreciation, sum(o_orderkey % 9) * 1000.0 as receivables from orders group by all)
select o_custkey, year, profit + depreciation - (receivables - coalesce(lag(receivables) over w, 0)) as operating, profit * 0.3 as dividends, profit * 0.25 as tax from y window w as (partition by o_custkey order by year)""")
def indirect_cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit with depreciation added back and the rise of receivables taken off; dividends and tax as parts of profit."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("year")
    y = read(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.sum(F.col("o_totalprice").cast("double")).alias("profit"), (F.count("*") * 100.0).alias("depreciation"), (F.sum(F.col("o_orderkey") % 9) * 1000.0).alias("receivables")
    )
    rise = F.col("receivables") - F.coalesce(F.lag("receivables").over(w), F.lit(0.0))
    return y.select("o_custkey", "year", (F.col("profit") + F.col("depreciation") - rise).alias("operating"), (F.col("profit") * 0.3).alias("dividends"), (F.col("profit") * 0.25).alias("tax"))


@query("""
with a as (select s_nationkey, sum(abs(cast(s_acctbal as double))) as annual from supplier group by 1),
m as (select c_nationkey, month(o_orderdate) as m, count(*) as n from orders join customer on c_custkey = o_custkey group by all), t as (select c_nationkey, sum(n) as total, count(*) as k from m group by 1)
select s_nationkey, cast(m as integer) as month, annual * n / total as monthly from a join m on c_nationkey = s_nationkey join t using (c_nationkey) where k = 12""")
def annual_to_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annual amount spread by a seasonality that has all twelve months."""
    annual = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sum(F.abs(F.col("s_acctbal").cast("double"))).alias("annual"))
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counted = orders.groupBy(F.col("c_nationkey").alias("s_nationkey"), F.month("o_orderdate").alias("month")).agg(F.count("*").cast("double").alias("n"))
    curve = series.seasonality(counted, ["s_nationkey"], "month", "n")
    return curve.join(annual, "s_nationkey").select("s_nationkey", "month", (F.col("annual") * F.col("share")).alias("monthly"))


@query("""
with d as (select p_partkey, p_brand, p_size, p_retailprice, row_number() over (partition by p_brand order by p_size desc nulls last, p_partkey) r from (select p_partkey, p_brand, case when p_size > 30 then null else p_size end as p_size, p_retailprice from part))
select p_brand, p_partkey, p_size from d where r = 1""")
def largest_known_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of the ordering column come last."""
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") <= 30, F.col("p_size")).alias("p_size"))
    return first_per_key(rows, ["p_brand"], [-F.col("p_size"), F.col("p_partkey")])
