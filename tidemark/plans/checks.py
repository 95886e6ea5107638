"""Queries of the pickers, column resolvers and sums of extracted lines.

The lines are made of line items: a case is ten customers, a document all lines of a case and
type; label, section, columns and unit are chosen by keys, so that all outcomes occur. Some
documents are left out, so that cases lack one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import period, text
from ..operators import checks
from ..operators.checks import Strategy
from ..operators.pick import first_per_key
from .labels import _choose, _sql_choose, _sql_normal, _sql_tokens
from .registry import query, read

_TYPES = ["BALANCO", "FLUXO_CAIXA", "DRE", "FATURAMENTO_24M", "MAPA_DIVIDA"]
_LABELS = [
    "Total do Ativo", "ATIVO", "Total do Ativo Circulante", "Total do Passivo e Patrimônio Líquido", "Passivo", "Patrimônio Líquido", "Total do Passivo", "Total do Patrimônio Líquido",
    "Caixa e equivalentes", "Disponível", "Caixa", "Saldo final do período", "Caixa no fim do período", "Receita Bruta", "Receita Líquida", "Vendas",
    "Jan/23", "Fev/2024", "Mar/24", "Total 2024", "Despesas financeiras", "Juros", "Juros sobre empréstimos",
]
_SECTIONS = ["Ativo", "Passivo", "Patrimônio Líquido", "Disponível", "Receita Bruta", "", "Ativo Circulante"]
_PERIODS = ["2023", "31/12/2024", "Dez/2024", "2024", ""]
_ENTITIES = ["Combinado", "Empresa Alfa", "", "Beta Ltda"]
_UNITS = ["R$", "R$ mil", "", "caixas", "R$"]
_NAMES = ["Alfa", "Empresa Alfa Participacoes S.A.", "Beta", "Gama"]
_YEARS = (2023, 2024)
_DOC = ["case_id", "doc_type"]

_F = f"""
f0 as (select cast(floor(o_custkey / 10) as bigint) as case_id, o_custkey, o_orderkey, {_sql_choose(_TYPES, 'o_orderkey')} as doc_type, o_orderkey % 5 as k,
  {_sql_choose(_LABELS, 'l_partkey')} as label, nullif({_sql_choose(_SECTIONS, 'l_suppkey')}, '') as section,
  nullif({_sql_choose(_PERIODS, '(l_suppkey + l_linenumber)')}, '') as period_col, nullif({_sql_choose(_ENTITIES, '(l_partkey + l_linenumber)')}, '') as entity_col,
  case when l_linenumber = 7 then null else floor(l_quantity / 10) * 1000 end as value, nullif({_sql_choose(_UNITS, 'l_orderkey')}, '') as unit,
  case when l_tax = 0 then null else l_discount end as confidence from lineitem join orders on l_orderkey = o_orderkey),
f as (select *, {_sql_normal('label')} as nl, {_sql_normal('section')} as ns, {_sql_tokens('label')} as toks from f0 where (case_id + k) % 7 <> 3),
fy as (select *, case when period_col like '%2023%' then 2023 when period_col like '%2024%' then 2024 end as y from f),
d as (select case_id, doc_type, count(period_col) as n_cols from f group by all),
yn as (select case_id, doc_type, y as year, period_col, count(*) n from fy where y is not null group by all),
yc as (select case_id, doc_type, year, period_col as col from (select *, row_number() over (partition by case_id, doc_type, year order by n desc, period_col) r from yn) where r = 1
  union all select case_id, doc_type, t.year, null from d, (values (2023), (2024)) t(year) where n_cols = 0),
g as (select f.*, yc.year from f join yc using (case_id, doc_type) where value is not null and (yc.col is null or f.period_col = yc.col))"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    blank = lambda values, key: F.nullif(_choose(values, key), F.lit(""))
    rows = rows.withColumn("_sl", F.col("l_suppkey") + F.col("l_linenumber")).withColumn("_pl", F.col("l_partkey") + F.col("l_linenumber"))
    rows = rows.select(
        F.floor(F.col("o_custkey") / 10).alias("case_id"), _choose(_TYPES, "o_orderkey").alias("doc_type"), (F.col("o_orderkey") % 5).alias("k"),
        _choose(_LABELS, "l_partkey").alias("label"), blank(_SECTIONS, "l_suppkey").alias("section"), blank(_PERIODS, "_sl").alias("period_col"), blank(_ENTITIES, "_pl").alias("entity_col"),
        F.when(F.col("l_linenumber") != 7, F.floor(F.col("l_quantity") / 10) * 1000).cast("double").alias("value"), blank(_UNITS, "l_orderkey").alias("unit"),
        F.when(F.col("l_tax") != 0, F.col("l_discount")).cast("double").alias("confidence"),
    )
    return rows.where((F.col("case_id") + F.col("k")) % 7 != 3).drop("k")


def _yearly(facts: DataFrame) -> DataFrame:
    return checks.in_years(facts, _DOC, checks.columns_of_years(facts, _DOC, _YEARS, period.years_of_text(F.col("period_col"))))


def _sql_match(s: Strategy) -> str:
    has = lambda c, terms: [f"contains({c}, '{t}')" for t in terms]
    lacks = lambda c, terms: [f"not contains({c}, '{t}')" for t in terms]
    if s.kind == "structure":
        return "toks = [" + ", ".join(f"'{t}'" for t in sorted(s.include)) + "]"
    if s.kind == "label":
        return " and ".join(has("nl", s.include) + lacks("nl", s.exclude))
    found = ["section is not null", *has("ns", s.include), *lacks("ns", s.exclude)]
    if s.kind == "section":
        return " and ".join(found + lacks("nl", s.exclude))
    return " and ".join([*found, "nl <> ns", "nl not like 'total%'", "nl not like 'subtotal%'", *lacks("nl", s.spared)])


def _sql_pick(s: Strategy, source: str = "g", keys: str = "case_id, doc_type, year") -> str:
    """A relation (keys, value, unit, origin, n) of what a strategy finds."""
    if s.kind == "sum":
        using = f"using ({keys})"
        return f"""(select s.*, u.unit, '{s.name}' as origin from (select {keys}, sum(value) as value, count(*) as n from {source} where {_sql_match(s)} group by all) s
          left join (select * from (select {keys}, unit, row_number() over (partition by {keys} order by count(*) desc, unit) r from {source} where {_sql_match(s)} and unit is not null group by {keys}, unit) where r = 1) u {using})"""
    length = "-length(label)" if s.kind == "structure" else "length(label)"
    return f"""(select {keys}, value, unit, '{s.name}: ' || label as origin, 1 as n from (select *, row_number() over (partition by {keys}
      order by coalesce(confidence, 0) desc, {length}, label, value, coalesce(unit, '')) r from {source} where value is not null and {_sql_match(s)}) where r = 1)"""


_ONE = {
    "concept_by_column": Strategy("assets", "label", ("ativo", "total"), ("circulante",)),
    "concept_by_section": Strategy("cash", "section", ("disponivel",), ("circulante", "passivo")),
    "structural_pick": Strategy("equity", "structure", ("patrimonio",)),
    "section_leaf_sum": Strategy("leaves", "sum", ("ativo",), ("passivo",), ("total do ativo", "caixa")),
}


def _register(name: str, s: Strategy) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = checks.picked(_yearly(_facts(spark, sf_dir)), [*_DOC, "year"], [s]).where(F.col(s.name).isNotNull())
        return found.select(*_DOC, "year", *(F.col(f"{s.name}.{c}").alias(c) for c in ("value", "unit", "origin", "n")))

    run.__name__ = name
    query(f"with {_F} select case_id, doc_type, cast(year as integer) as year, value, unit, origin, n from {_sql_pick(s)}")(run)


for _name, _s in _ONE.items():
    _register(_name, _s)


@query(f"with {_F} select case_id, doc_type, sum(value) as value, count(*) as n from f where value is not null and contains(nl, 'caixa') and not contains(nl, 'fim') group by all")
def sum_by_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir).where(F.col("value").isNotNull() & text.has_terms(F.col("label"), ("caixa",), ("fim",)))
    return facts.groupBy(*_DOC).agg(F.sum("value").alias("value"), F.count("*").alias("n"))


_BILLING = """(select case_id, doc_type, t.year, sum(value) as value, count(*) as n from f, (values (2023, '23'), (2024, '24')) t(year, short)
  where value is not null and not regexp_matches(nl, 'total|acumulad|media') and (contains(nl, cast(t.year as varchar)) or regexp_matches(nl, '[/. -]' || short || '($|[^0-9])')) group by all)"""


@query(f"with {_F} select case_id, doc_type, cast(year as integer) as year, value, n from {_BILLING}")
def billing_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.sum_of_year(_facts(spark, sf_dir), _DOC, _YEARS)


@query(f"with {_F} select case_id, doc_type, cast(year as integer) as year, col as column from yc")
def column_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.columns_of_years(_facts(spark, sf_dir), _DOC, _YEARS, period.years_of_text(F.col("period_col")))


@query(f"""with {_F}, n as (select *, {_sql_choose(_NAMES, 'case_id')} as name, case_id % 3 = 0 as owner from f),
m as (select *, case name when 'Alfa' then entity_col = 'Empresa Alfa' when 'Empresa Alfa Participacoes S.A.' then entity_col = 'Empresa Alfa' when 'Beta' then entity_col = 'Beta Ltda' else false end as same from n)
select case_id, doc_type, coalesce(min(entity_col) filter (where same), min(entity_col) filter (where owner and entity_col = 'Combinado')) as column,
  count(entity_col) > 0 and coalesce(min(entity_col) filter (where same), min(entity_col) filter (where owner and entity_col = 'Combinado')) is null as blocked from m group by all""")
def column_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`Alfa` and `Empresa Alfa` are the same entity, as the tokens of one follow in the other; `Gama` has no column."""
    return checks.entity_column(_facts(spark, sf_dir), _DOC, _choose(_NAMES, "case_id"), F.col("case_id") % 3 == 0)


@query(f"""
with o as (select cast(floor(o_custkey / 10) as bigint) as case_id, o_orderkey as doc_id, o_orderdate, {_sql_choose(_TYPES, 'o_orderkey')} as doc_type from orders),
p as (select *, row_number() over (partition by case_id order by list_position(['BALANCO', 'MAPA_DIVIDA', 'DRE'], doc_type), o_orderdate desc, doc_id) r from o where doc_type in ('BALANCO', 'MAPA_DIVIDA', 'DRE'))
select case_id, doc_id, doc_type from p where r = 1""")
def document_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ("BALANCO", "MAPA_DIVIDA", "DRE")))
    rows = read(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 10).alias("case_id"), F.col("o_orderkey").alias("doc_id"), "o_orderdate", _choose(_TYPES, "o_orderkey").alias("doc_type"))
    rows = rows.where(F.array_position(wanted, F.col("doc_type")) > 0)
    order = [F.array_position(wanted, F.col("doc_type")), -F.unix_date(F.to_date("o_orderdate")), F.col("doc_id")]
    return first_per_key(rows, ["case_id"], order).select("case_id", "doc_id", "doc_type")


@query(f"""
with o as (select cast(floor(o_custkey / 10) as bigint) as case_id, o_orderkey as doc_id, o_orderdate, {_sql_choose(_TYPES, 'o_orderkey')} as doc_type, case when o_orderkey % 4 = 0 then null else o_custkey % 10 end as entity from orders),
e as (select distinct case_id, entity from o where entity is not null),
p as (select e.case_id, e.entity, o.doc_id, row_number() over (partition by e.case_id, e.entity order by o_orderdate desc, doc_id) r from e join o on e.case_id = o.case_id and (o.entity = e.entity or o.entity is null) and o.doc_type = 'DRE' and year(o_orderdate) in (1995, 1996))
select case_id, entity, doc_id from p where r = 1""")
def document_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest document of a type and of compatible years that is the entity's own or no one's.

    The newest of each entity and of no one are taken first, so that a row each meets them.
    """
    rows = read(spark, sf_dir, "orders").select(
        F.floor(F.col("o_custkey") / 10).alias("case_id"), F.col("o_orderkey").alias("doc_id"), "o_orderdate", _choose(_TYPES, "o_orderkey").alias("doc_type"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") % 10).alias("entity")
    )
    ref = F.concat_ws(",", F.lit("1995"), F.lit("1996"))
    usable = rows.where((F.col("doc_type") == "DRE") & period.compatible(F.date_format("o_orderdate", "yyyy-MM-dd"), ref))
    newest = first_per_key(usable, ["case_id", "entity"], [-F.unix_date(F.to_date("o_orderdate")), F.col("doc_id")]).select("case_id", "entity", "doc_id", "o_orderdate")
    entities = rows.where("entity is not null").select("case_id", "entity").distinct()
    shared = entities.join(newest.where("entity is null").drop("entity"), "case_id")
    mine = entities.join(newest.where("entity is not null"), ["case_id", "entity"])
    return first_per_key(mine.unionByName(shared), ["case_id", "entity"], [-F.unix_date(F.to_date("o_orderdate")), F.col("doc_id")]).select("case_id", "entity", "doc_id")
