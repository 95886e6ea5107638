"""Queries of payloads, groups of entities, schedules and blocks of accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import accounts, files, text
from ..operators import consolidate, project, schedule
from ..sources import macro
from .labels import _choose, _sql_choose
from .registry import query, read

_EXPECTED = """i as (select p_partkey, k, '2026-01-0' || (1 + (p_partkey + k) % 3) as collected, 2026 + k // 6 as year, case when k % 7 <> 3 then (p_size + k) / 4 end as median,
  case when k % 5 <> 0 then k % 2 end as basis from part, (select unnest(range(12)) as k))"""


@query(f"""with {_EXPECTED}, n as (select *, max(collected) over (partition by p_partkey) as newest from i),
r as (select *, row_number() over (partition by p_partkey, year order by k) as r from n where collected = newest and median is not null and coalesce(basis, 0) = 0)
select p_partkey, cast(year as integer) as year, median, median * 2 as mean, cast(k as integer) as respondents, collected from r where r = 1""")
def expectations_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as text: the newest collection, the right basis, the first of a year."""
    k = F.sequence(F.lit(0), F.lit(11))
    number = lambda n: F.format_string("%d,%02d", F.floor(n / 4).cast("int"), (n % 4 * 25).cast("int"))
    item = lambda i: F.struct(
        F.concat(F.lit("2026-01-0"), (1 + (F.col("p_partkey") + i) % 3).cast("string")).alias("Data"), (2026 + F.floor(i / 6)).cast("string").alias("DataReferencia"),
        F.when(i % 7 != 3, number(F.col("p_size") + i)).otherwise("n/d").alias("Mediana"), number(2 * (F.col("p_size") + i)).alias("Media"), i.alias("numeroRespondentes"), F.when(i % 5 != 0, i % 2).alias("baseCalculo"),
    )
    payloads = read(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.transform(k, item).alias("value"))).alias("payload"))
    return macro.expectations(payloads, "payload").drop("payload")


@query("select s_suppkey, make_date(2025, cast(k as integer), 1) as date_ref, k + (s_suppkey % 10) / 10 as value from supplier, (select unnest(range(1, 13)) as k) where k % 5 <> 0")
def monthly_index_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.array(F.struct(F.lit("code").alias("D3C"), F.lit("value").alias("V")))
    item = lambda i: F.struct((202500 + i).cast("string").alias("D3C"), F.when(i % 5 == 0, "...").otherwise(F.format_string("%d,%d", i, F.col("s_suppkey") % 10)).alias("V"))
    payload = F.to_json(F.concat(head, F.transform(F.sequence(F.lit(0), F.lit(14)), item)))
    return macro.monthly_index(read(spark, sf_dir, "supplier").select("s_suppkey", payload.alias("payload")), "payload").drop("payload")


@query("""
with o as (select o_orderkey, o_orderpriority as series, cast(year(o_orderdate) as integer) as year, o_totalprice from orders),
k as (select series, year, min(o_totalprice) as median from o where series <> '5-LOW' and year % 2 = 0 group by all)
select o_orderkey, k.median / 100 as fraction, case when series = '5-LOW' then 'no_series' when year % 2 <> 0 then 'not_covered' end as reason,
  case when series <> '5-LOW' then (select min(year) from k k2 where k2.series = o.series) end as first_year, case when series <> '5-LOW' then (select max(year) from k k3 where k3.series = o.series) end as last_year from o left join k using (series, year)""")
def expectations_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap stays null and says why."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("year"), "o_totalprice")
    known = o.where("series <> '5-LOW' and year % 2 = 0").select("series", "year", F.col("o_totalprice").alias("median"))
    return macro.covered(o.drop("o_totalprice"), known, "series", "year", "median").drop("series", "year")


@query("""
with c as (select c_custkey, upper(left(c_mktsegment, 1)) || lower(c_mktsegment[2:]) as s from customer)
select c_custkey, case c_custkey % 4 when 0 then 'Grupo Norte ' || s when 1 then 'VT ' || s when 3 then s || ' LTDA' end as entity from c""")
def company_in_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.when(k % 4 == 0, F.format_string("%02d_BP_Combinado_Grupo_Norte_%s_2025x2024.pdf", k % 90, s)).when(k % 4 == 1, F.format_string("DRE_VT_%s_12m25_assinado.pdf", s))
    name = name.when(k % 4 == 2, "Fluxo de Caixa 1T25.pdf").otherwise(F.format_string("%s_Ltda_Estoques_L24M_rev.xlsx", s))
    return read(spark, sf_dir, "customer").select("c_custkey", files.file_entity(text.file_label(name)).alias("entity"))


_LABELS = ["Receita de Vendas", "ICMS sobre Vendas", "Devoluções e Abatimentos", "Caixa e Equivalentes", "Máquinas e Equipamentos", "Bancos conta movimento", "Móveis e Utensílios", "ICMS a Recuperar", "Aplicações em coligadas", "Descontos concedidos"]
_SECTIONS = ["receita_bruta", "custos", "despesas_operacionais", "ativo_circulante", "ativo_nao_circulante", "outra", "patrimonio_liquido"]


@query(f"""
with l as (select p_partkey, {_sql_choose(_LABELS, 'p_partkey')} as label, {_sql_choose(_SECTIONS, 'p_size')} as section, p_retailprice > 980 as on_map from part)
select p_partkey, case when on_map then 'divida' when section = 'receita_bruta' and label in ('ICMS sobre Vendas', 'Devoluções e Abatimentos', 'Descontos concedidos') then 'deducao'
  when section = 'receita_bruta' then 'receita' when section = 'custos' then 'custo' when section = 'despesas_operacionais' then 'sga' when section = 'outra' then 'fora' else section end as block,
  label similar to '(Máq|Móv).*' as fixed, label similar to '(Caixa|Bancos).*' as cash from l""")
def accounts_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", _choose(_LABELS, "p_partkey").alias("label"), _choose(_SECTIONS, "p_size").alias("section"), F.when(F.col("p_retailprice") > 980, F.array(F.lit("MAPA_DIVIDA"))).otherwise(F.array(F.lit("DRE"))).alias("docs"))
    label = F.col("label")
    return rows.select("p_partkey", accounts.block_of_line(F.col("section"), label, F.col("docs")).alias("block"), accounts.is_fixed_asset(label).alias("fixed"), accounts.is_cash(label).alias("cash"))


_BLOCKS = ["receita", "custo", "sga"]


@query(f"""
with l as (select l_suppkey, {_sql_choose(_BLOCKS, 'l_linenumber')} as block, l_quantity - 25 as v, year(l_shipdate) < 1999 as hist from lineitem),
s as (select l_suppkey, block, coalesce(sum(v) filter (where hist) < 0, false) and block <> 'receita' as turned from l group by l_suppkey, block)
select l_suppkey, block, sum(case when turned then -v else v end) as v, count(*) filter (where turned) as turned from l join s using (l_suppkey, block) group by l_suppkey, block""")
def signs_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of expenses that come as negatives are turned as a whole."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", _choose(_BLOCKS, "l_linenumber").alias("block"), (F.col("l_quantity") - 25).alias("v"), F.year("l_shipdate").alias("y"))
    out = schedule.signs_normalised(rows, ["l_suppkey"], "block", "v", ["custo", "sga"], F.col("y") < 1999)
    return out.groupBy("l_suppkey", "block").agg(F.sum("v").alias("v"), F.count_if("turned").alias("turned"))


_METHODS = ["crescimento_composto", "pct_de_linha", "dias_de_giro", "valor_por_ano", "preco_x_volume", "indice_macro", "curva_mensal"]


@query(f"""
with y as (select o_custkey, cast(year(o_orderdate) as integer) as year, count(*) / 10 as d, sum(o_orderkey % 1000) * 1.0::double as o from orders group by all), m as (select *, {_sql_choose(_METHODS, 'o_custkey')} as method from y)
select o_custkey, year, round(case method when 'crescimento_composto' then 1000 * product(1 + d) over w when 'pct_de_linha' then d * o when 'dias_de_giro' then o * d / 360 when 'valor_por_ano' then d when 'preco_x_volume' then d * o
  when 'indice_macro' then 1000 * product(1 + case when year % 2 = 0 then d else 0 end) over w else 1000 * d / sum(d) over (partition by o_custkey) end, 4) as projected from m window w as (partition by o_custkey order by year)""")
def projection_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = read(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg((F.count("*") / 10).alias("n"), F.sum(F.col("o_orderkey") % 1000).cast("double").alias("o"))
    y = y.withColumn("method", _choose(_METHODS, "o_custkey")).withColumn("b", F.lit(1000.0)).withColumn("d", F.when((F.col("method") != "indice_macro") | (F.col("year") % 2 == 0), F.col("n")))
    return schedule.projected(y, ["o_custkey"], "year", "method", "b", "d", "o").select("o_custkey", "year", F.round("projected", 4).alias("projected"))


_STEPS = """with recursive b as (select s_suppkey, s_nationkey, abs(s_acctbal) as v, (s_suppkey % 9) / 2 as term from supplier),
s as (select s_suppkey, s_nationkey, term, 1 as period, v as opening, case when term <= 0 then 0 else v * least(1, 1 / term) end as paid from b
 union all select s_suppkey, s_nationkey, term, period + 1, opening - paid, case when term - period <= 0 then 0 else (opening - paid) * least(1, 1 / (term - period)) end from s where period < 5)"""


def _instalments(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.abs("s_acctbal").alias("v"), (F.col("s_suppkey") % 9 / 2).alias("term"))
    return schedule.instalments(loans, "v", F.col("term"), 5)


@query(f"""{_STEPS} select s_suppkey, period, round(opening, 8) + 0.0 as opening, round(paid, 8) + 0.0 as paid, round(opening - paid, 8) + 0.0 as closing, round(opening * 0.155, 8) + 0.0 as interest from s""")
def debt_instalments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of half years, also shorter than a year and none; interest on the opening balance."""
    rate = project.combined_index(F.lit(0.1), F.lit(0.05))
    out = _instalments(spark, sf_dir).withColumn("interest", F.col("opening") * rate)
    return out.select("s_suppkey", "period", *((F.round(c, 8) + 0.0).alias(c) for c in ("opening", "paid", "closing", "interest")))


@query(f"""{_STEPS}, t as (select s_nationkey, period, sum(opening) as opening, sum(opening - paid) as total from s group by all)
select s_nationkey, period, round(total, 8) + 0.0 as total, round(coalesce(lag(total) over (partition by s_nationkey order by period), opening) - total, 8) + 0.0 as paid from t""")
def tax_instalments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a year pays is by how much the total falls."""
    out = _instalments(spark, sf_dir).groupBy("s_nationkey", "period").agg(F.sum("closing").alias("total"), F.sum("paid").alias("paid"))
    return out.select("s_nationkey", "period", (F.round("total", 8) + 0.0).alias("total"), (F.round("paid", 8) + 0.0).alias("paid"))


@query("""
with d as (select s_suppkey, (s_suppkey % 30) / 100 as rate, (s_suppkey % 21 - 10) / 10 as curve, s_suppkey % 6 * 10.0::double as short, 100.0::double as whole from supplier),
p as (select *, case when s_suppkey % 21 = 0 then 0 else (1 + rate) / (1 + curve) - 1 end as spread from d)
select s_suppkey, round(spread, 8) + 0.0 as spread, round((1 + curve) * (1 + spread) - 1, 8) + 0.0 as cost, case when short > 0 then least(10, whole / short) else 10 end as term from p""")
def cost_of_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rate, curve = k % 30 / 100, (k % 21 - 10) / 10
    spread = schedule.implied_spread(rate, curve)
    term = schedule.implied_term(k % 6 * F.lit(10.0), F.lit(100.0))
    return read(spark, sf_dir, "supplier").select("s_suppkey", (F.round(spread, 8) + 0.0).alias("spread"), (F.round(project.combined_index(curve, spread), 8) + 0.0).alias("cost"), term.alias("term"))


_PARTS = [*consolidate.ASSETS, *consolidate.LIABILITIES, consolidate.EQUITY]
_BOOKS = f"b as (select l_suppkey, {_sql_choose(_PARTS, '(l_linenumber + l_suppkey)')} as section, cast(floor(l_extendedprice) as bigint) as v from lineitem)"
_TOTALS = """e as (select l_suppkey, coalesce(sum(v) filter (where section in ('AC', 'ANC')), 0)::bigint as assets, coalesce(sum(v) filter (where section in ('PC', 'PNC')), 0)::bigint as liabilities, coalesce(sum(v) filter (where section = 'PL'), 0)::bigint as other from b group by 1)"""


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("_at", F.col("l_linenumber") + F.col("l_suppkey"))
    return rows.select("l_suppkey", _choose(_PARTS, "_at").alias("section"), F.floor("l_extendedprice").alias("v"))


@query(f"""with {_BOOKS}, {_TOTALS} select l_suppkey, assets, liabilities, assets - liabilities as equity, assets - liabilities - other as plug, case when assets - liabilities - other < 0 then 'accumulated_loss' else 'accumulated_profit' end as plug_kind from e""")
def entities_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = consolidate.closed(consolidate.section_sums(_books(spark, sf_dir), ["l_suppkey"], "section", "v"))
    return out.select("l_suppkey", "assets", "liabilities", "equity", "plug", "plug_kind")


@query(f"""with {_BOOKS}, {_TOTALS}, f as (select l_suppkey, case when liabilities > 0 and assets - l_suppkey % 50 * 100000 > 0 then (assets - l_suppkey % 50 * 100000)::double / liabilities end as f from e)
select l_suppkey, section, sum(case when section in ('PC', 'PNC') and f is not null then round_even(v * f, 0) else v end)::double as v, count(*) as n from b join f using (l_suppkey) group by all""")
def liabilities_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = consolidate.scaled_to_equity(_books(spark, sf_dir), ["l_suppkey"], "section", "v", F.col("l_suppkey") % 50 * 100000)
    return out.groupBy("l_suppkey", "section").agg(F.sum("v").alias("v"), F.count("*").alias("n"))


@query(f"""with {_BOOKS}, {_TOTALS}, h as (select s_nationkey, min(s_suppkey) as holding from supplier group by 1),
n as (select s_nationkey, l_suppkey = holding as is_holding, assets, liabilities, assets - liabilities as equity, l_suppkey % 7 * 100 as intra,
  case when l_suppkey = holding or l_suppkey % 3 = 2 then null when l_suppkey % 3 = 0 then 1.0::double else 0.7::double end as share from e join supplier on s_suppkey = l_suppkey join h using (s_nationkey)),
g as (select s_nationkey, sum(assets)::double as a, sum(liabilities)::double as l, coalesce(sum(greatest(0, round_even(share * equity, 0))), 0) as investments, coalesce(sum(-least(0, round_even(share * equity, 0))), 0) as provisions,
  sum(intra)::double as intra, coalesce(sum(equity) filter (where is_holding), 0)::double as he, coalesce(sum(round_even((1 - share) * equity, 0)) filter (where share < 1), 0) as minority from n group by 1)
select s_nationkey, investments + 0.0 as investments, provisions + 0.0 as provisions, minority + 0.0 as minority, a - investments - intra as assets, l - provisions - intra as liabilities, he + minority as equity,
  (a - investments - intra) - (l - provisions - intra) - (he + minority) as gap from g""")
def combined_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as a group: the first is the holding, a third of them is not owned."""
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    holdings = suppliers.groupBy("s_nationkey").agg(F.min("l_suppkey").alias("holding"))
    entities = consolidate.closed(consolidate.section_sums(_books(spark, sf_dir), ["l_suppkey"], "section", "v")).join(suppliers, "l_suppkey").join(holdings, "s_nationkey")
    k = F.col("l_suppkey")
    share = F.when((k == F.col("holding")) | (k % 3 == 2), F.lit(None)).when(k % 3 == 0, 1.0).otherwise(0.7)
    out = consolidate.combined(entities, ["s_nationkey"], k == F.col("holding"), share, k % 7 * 100)
    return out.select("s_nationkey", *((F.col(c) + 0.0).alias(c) for c in ("investments", "provisions", "minority")), "assets", "liabilities", "equity", "gap")


@query("""
with l as (select l_orderkey, 'g' || l_linenumber as label, case when l_linenumber % 2 = 0 then 'g1' end as sub, l_quantity as v from lineitem), h as (select l_orderkey, bool_or(sub is not null) as grouped from l group by 1),
s as (select l_orderkey, sum(v) filter (where not (grouped and label = 'g1')) as own_sum, case when l_orderkey % 4 <> 0 then 100.0::double end as informed from l join h using (l_orderkey) group by l_orderkey)
select l_orderkey, own_sum, coalesce(informed, own_sum) as total, informed - own_sum as difference from s""")
def informed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals are left out of the sum; the informed total is shown, with its difference."""
    n = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("g"), n.cast("string")).alias("label"), F.when(n % 2 == 0, "g1").alias("sub"), F.col("l_quantity").alias("v"))
    return consolidate.informed_totals(rows, ["l_orderkey"], "label", "sub", "v", F.when(F.col("l_orderkey") % 4 != 0, 100.0)).drop("informed")


@query("""
with l as (select l_orderkey, l_returnflag, case when l_linenumber % 2 = 0 then 's' || l_suppkey % 3 end as section from lineitem), a as (select l_orderkey, l_returnflag, count(distinct section) = 1 as agree from l group by all)
select l_orderkey, count(*) filter (where section is null and agree) as inherited, count(*) filter (where section is null and not agree) as without from l join a using (l_orderkey, l_returnflag) group by 1""")
def sections_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string"))).alias("section"))
    out = consolidate.inherited_sections(rows, ["l_orderkey", "l_returnflag"], "section")
    return out.groupBy("l_orderkey").agg(F.count_if("inherited").alias("inherited"), F.count_if(F.col("section").isNull()).alias("without"))


@query("""
with n as (select distinct p_brand, lower(case p_partkey % 40 when 0 then split_part(p_name, ' ', 1) when 1 then p_name else p_name || ' ' || p_type end) as entity from part),
m as (select n.p_brand, n.entity, count(w.entity) as c, min(w.entity) as whole from n left join n w on w.p_brand = n.p_brand and starts_with(w.entity, n.entity || ' ') group by all)
select p_brand, entity, case when c = 1 then whole else entity end as stands_for from m""")
def whole_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names stand for the one name that begins with them; some of the names end in a legal suffix."""
    k = F.col("p_partkey")
    name = F.when(k % 40 == 0, F.substring_index("p_name", " ", 1)).when(k % 40 == 1, F.concat("p_name", F.lit(" Ltda."))).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    rows = read(spark, sf_dir, "part").select("p_brand", name.alias("name"))
    return consolidate.whole_names(rows, "p_brand", "name")
