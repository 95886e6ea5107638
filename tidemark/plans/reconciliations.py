"""Queries of the reconciliations of documents.

The documents are made of orders: a case is forty customers, a document all orders of a case
with the same entity, type and period; its lines are their line items, whose label, section,
columns and unit are chosen by keys, so that all outcomes occur. Some documents are left out, so
that targets lack one. A target is an entity and a period of a case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import roles
from ..operators import duplicates, reconcile
from ..operators.standard_checks import CHECKS, with_tolerance
from .labels import _choose, _sql_choose, _sql_normal, _sql_tokens
from .registry import query, read

_TYPES = ["BALANCO", "FLUXO_CAIXA", "DRE", "FATURAMENTO_24M", "MAPA_DIVIDA", "COMBINADO", "BALANCETE"]
_REFS = ["2023", "12M24", "23,24", "L24M"]
_LABELS = [
    "Total do Ativo", "ATIVO", "Total do Ativo Circulante", "Total do Passivo e Patrimônio Líquido", "Passivo", "Patrimônio Líquido", "Total do Passivo", "Total do Patrimônio Líquido",
    "Passivo e Patrimônio Líquido", "Caixa e equivalentes de caixa", "Disponibilidades", "Numerário disponível", "Caixa e bancos", "Caixa", "Bancos conta movimento", "Saldo final do período",
    "Caixa no fim do período", "Caixa final", "Receita Bruta", "Receita Líquida", "Vendas de produtos", "Jan/23", "Fev/2024", "Mar/24", "Total 2024", "Média 2023", "Despesa financeira", "Despesas financeiras",
    "Receita e despesa financeira", "Juros e encargos", "Juros do contrato A", "Encargos do contrato B", "Juros total geral", "Total de juros",
]
_SECTIONS = ["Ativo", "Passivo", "Patrimônio Líquido", "Disponível", "Receita Bruta", "", "Ativo Circulante", "Caixa"]
_PERIODS = ["2023", "31/12/2024", "Dez/2024", "2024", ""]
_ENTITIES = ["Combinado", "Empresa Alfa", "", "Beta Ltda"]
_UNITS = ["R$", "R$ mil", "", "caixas", "R$", "R$"]
_NAMES = {1: "Empresa Alfa Participações S.A.", 2: "Beta", 3: "Gama"}
#: The values of line items are small, so the amounts that don't matter are too.
_CHECKS = tuple(with_tolerance(c, min(c.absolute, 500)) for c in CHECKS)
_KEYS = ["case_id", "entity_id", "ref"]
_VERDICT = ["verdict", "checked", "unchecked", "worst_gap", "worst_share"]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.floor(F.col("o_custkey") / 40).alias("case_id"), F.nullif((F.col("o_custkey") % 4).cast("int"), F.lit(0)).alias("entity_id"), _choose(_TYPES, "o_orderkey").alias("doc_type"),
        F.floor(F.col("o_orderkey") / 7).alias("_w"), F.col("o_orderdate").alias("created"),
    )
    rows = rows.withColumn("ref", _choose(_REFS, "_w")).where((F.col("case_id") * 5 + F.coalesce("entity_id", F.lit(0)) + F.length("doc_type")) % 9 != 3)
    return rows.withColumn("doc_id", F.concat_ws("|", "case_id", F.coalesce(F.col("entity_id").cast("string"), F.lit("-")), "doc_type", "ref"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).groupBy("case_id", "doc_id", "doc_type", "entity_id", "ref").agg(F.max("created").alias("created"))


def _name(entity: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv))[entity]


def _targets(documents: DataFrame) -> DataFrame:
    return documents.select(*_KEYS).distinct().withColumn("entity_name", _name(F.col("entity_id")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).select("o_orderkey", "doc_id", (F.col("case_id") + F.coalesce("entity_id", F.lit(0))).alias("_k"))
    rows = read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    blank = lambda values, key: F.nullif(_choose(values, key), F.lit(""))
    rows = rows.withColumn("_sl", F.col("l_suppkey") + F.col("l_linenumber")).withColumn("_pl", F.col("l_partkey") + F.col("l_linenumber"))
    return rows.select(
        "doc_id", _choose(_LABELS, "l_partkey").alias("label"), blank(_SECTIONS, "l_suppkey").alias("section"), F.when(F.col("_k") % 3 != 0, blank(_PERIODS, "_sl")).alias("period_col"),
        F.when(F.col("_k") % 2 != 0, blank(_ENTITIES, "_pl")).alias("entity_col"), F.when(F.col("l_linenumber") != 7, F.floor(F.col("l_quantity") / 25) * 1000 + 1000).cast("double").alias("value"),
        blank(_UNITS, "l_orderkey").alias("unit"), F.when(F.col("l_tax") != 0, F.col("l_discount")).cast("double").alias("confidence"),
    )


# The statement below spells the rules out by itself, with terms and orders of its own.
_DATA = f"""
o as materialized (select * from (select o_orderkey, o_orderdate, cast(floor(o_custkey / 40) as bigint) as case_id, nullif(cast(o_custkey % 4 as int), 0) as entity_id, {_sql_choose(_TYPES, 'o_orderkey')} as doc_type,
  {_sql_choose(_REFS, 'cast(floor(o_orderkey / 7) as bigint)')} as ref from orders) where (case_id * 5 + coalesce(entity_id, 0) + length(doc_type)) % 9 <> 3),
od as materialized (select *, case_id || '|' || coalesce(cast(entity_id as varchar), '-') || '|' || doc_type || '|' || ref as doc_id from o),
docs as materialized (select case_id, doc_id, doc_type, entity_id, ref, max(o_orderdate) as created from od group by all),
refs(ref, years) as (values ('2023', [2023]), ('12M24', [2024]), ('23,24', [2023, 2024]), ('L24M', cast([] as int[]))),
t as materialized (select distinct case_id, entity_id, ref, case entity_id when 1 then 'Empresa Alfa' when 2 then 'Beta Ltda' when 3 then '?' end as col, case_id || '|' || coalesce(cast(entity_id as varchar), '-') || '|' || ref as k from docs),
ty as materialized (select t.*, unnest(case when len(years) = 0 then [null] else years end) as y from t join refs using (ref)),
f0 as (select doc_id, {_sql_choose(_LABELS, 'l_partkey')} as label, nullif({_sql_choose(_SECTIONS, 'l_suppkey')}, '') as section,
  case when (case_id + coalesce(entity_id, 0)) % 3 <> 0 then nullif({_sql_choose(_PERIODS, '(l_suppkey + l_linenumber)')}, '') end as pc, case when (case_id + coalesce(entity_id, 0)) % 2 <> 0 then nullif({_sql_choose(_ENTITIES, '(l_partkey + l_linenumber)')}, '') end as ec,
  case when l_linenumber = 7 then null else floor(l_quantity / 25) * 1000 + 1000 end as value, nullif({_sql_choose(_UNITS, 'l_orderkey')}, '') as unit,
  case when l_tax = 0 then null else l_discount end as confidence from lineitem join od on l_orderkey = o_orderkey),
f as materialized (select *, {_sql_normal('label')} as nl, {_sql_normal('section')} as ns, {_sql_tokens('label')} as toks from f0),
pcs as (select doc_id, y, pc, row_number() over (partition by doc_id, y order by count(*) desc, pc) as r from (select doc_id, pc, case when contains(pc, '2023') then 2023 else 2024 end as y from f where pc is not null) group by doc_id, y, pc),
has as materialized (select doc_id, count(pc) > 0 as has_pc, count(ec) > 0 as has_ec, bool_or(ec = 'Combinado') as has_total, list(distinct ec) filter (where ec is not null) as ecs from f group by doc_id),
du as materialized (select doc_id, unit from (select doc_id, unit, row_number() over (partition by doc_id order by count(*) desc, unit) as r from f where unit is not null group by doc_id, unit) where r = 1)"""


def _sql_doc(name: str, types: str, nobody: bool) -> str:
    """The document that a target takes, with the entity's column: null for any, '?' for none."""
    whose = "d.entity_id = t.entity_id or d.entity_id is null" if nobody else "d.entity_id = t.entity_id"
    return f"""{name} as materialized (select k, p.doc_id, case when not coalesce(has_ec, false) then null when list_contains(ecs, col) then col when owner and has_total then 'Combinado' else '?' end as ec from (
  select t.k, t.col, d.doc_id, coalesce(d.entity_id = t.entity_id, false) as owner, row_number() over (partition by t.k order by list_position([{types}], d.doc_type), d.created desc, d.doc_id) as r
  from t join docs d on d.case_id = t.case_id and d.doc_type in ({types}) and (t.entity_id is null or {whose}) join refs a on a.ref = t.ref join refs b on b.ref = d.ref
  where len(a.years) = 0 or len(b.years) = 0 or list_has_any(a.years, b.years)) p left join has on has.doc_id = p.doc_id where r = 1)"""


def _sql_lines(name: str, doc: str, entity: bool, period: bool) -> str:
    """The lines of a target's document and year."""
    tests = ["f.value is not null"]
    if entity:
        tests.append("(d.ec is null or f.ec = d.ec)")
    if period:
        tests.append("(ty.y is null or not has_pc or f.pc = pcs.pc)")
    return f"""{name} as materialized (select ty.k, coalesce(ty.y, 0) as y, f.* exclude (doc_id), du.unit as doc_unit from ty join {doc} d using (k) join f on f.doc_id = d.doc_id join has on has.doc_id = f.doc_id left join du on du.doc_id = f.doc_id
  left join pcs on pcs.doc_id = f.doc_id and pcs.y = ty.y and pcs.r = 1 where {' and '.join(tests)})"""


def _sql_pick(lines: str, test: str, longest: bool = False) -> str:
    return f"(select k, y, value, unit from (select *, row_number() over (partition by k, y order by coalesce(confidence, 0) desc, {'-' if longest else ''}length(label), label, value, coalesce(unit, '')) as r from {lines} where {test}) where r = 1)"


def _sql_sum(lines: str, test: str, unit: str = "") -> str:
    if unit:
        return f"(select k, y, sum(value) as value, any_value({unit}) as unit from {lines} where {test} group by all)"
    return f"""(select k, y, value, unit from (select k, y, sum(value) as value from {lines} where {test} group by all) left join
  (select k, y, unit from (select k, y, unit, row_number() over (partition by k, y order by count(*) desc, unit) as r from {lines} where {test} and unit is not null group by k, y, unit) where r = 1) using (k, y))"""


def _sql_first(*steps: str) -> str:
    parts = " union all ".join(f"select k, y, value, unit, {n} as step from {s}" for n, s in enumerate(steps))
    return f"(select k, y, value, unit from (select *, row_number() over (partition by k, y order by step) as r from ({parts})) where r = 1)"


def _sql_both(a: str, b: str, kind: str) -> str:
    return f"(select k, y, coalesce(a.value, 0) + coalesce(b.value, 0) as value, coalesce(a.unit, b.unit) as unit from {a} a {kind} join {b} b using (k, y))"


def _has(column: str, *terms: str) -> str:
    return " and ".join(f"contains({column}, '{t}')" for t in terms)


def _not(column: str, *terms: str) -> str:
    return " and ".join(f"not contains({column}, '{t}')" for t in terms)


_LEAF = "section is not null and nl <> ns and nl not like 'total%' and nl not like 'subtotal%'"
_B = "'BALANCO', 'COMBINADO', 'BALANCETE'"
_SIDES = {
    "assets_claims": (
        _sql_first(
            _sql_pick("lb", f"{_has('nl', 'ativo', 'total')} and {_not('nl', 'circulante')}"), _sql_pick("lb", "toks = ['ativo']", True),
            _sql_sum("lb", f"{_LEAF} and {_has('ns', 'ativo')} and {_not('ns', 'passivo', 'patrimonio')} and {_not('nl', 'total do ativo')}"),
        ),
        _sql_first(
            _sql_pick("lb", f"{_has('nl', 'passivo', 'patrimonio', 'total')} and {_not('nl', 'circulante')}"), _sql_pick("lb", "toks = ['passivo', 'patrimonio']", True),
            _sql_both(
                _sql_first(_sql_pick("lb", f"{_has('nl', 'passivo', 'total')} and {_not('nl', 'patrimonio', 'circulante')}"), _sql_pick("lb", "toks = ['passivo']", True)),
                _sql_first(_sql_pick("lb", f"{_has('nl', 'patrimonio', 'liquido', 'total')} and {_not('nl', 'circulante')}"), _sql_pick("lb", "toks = ['patrimonio']", True)), "inner",
            ),
            _sql_both(
                _sql_sum("lb", f"{_LEAF} and {_has('ns', 'passivo')} and {_not('ns', 'patrimonio')} and {_not('nl', 'total do passivo', 'passivo e patrimonio')}"),
                _sql_sum("lb", f"{_LEAF} and {_has('ns', 'patrimonio')} and {_not('nl', 'total do passivo', 'passivo e patrimonio')}"), "full",
            ),
        ),
    ),
    "cash": (
        _sql_first(
            _sql_pick("lb", f"{_has('nl', 'caixa', 'equivalentes')} and {_not('nl', 'circulante', 'fluxo', 'inicio', 'inicial')}"), _sql_pick("lb", f"{_has('nl', 'disponibilidades')} and {_not('nl', 'circulante')}"),
            _sql_pick("lb", f"{_has('nl', 'disponivel')} and {_not('nl', 'circulante')}"), _sql_pick("lb", f"{_has('nl', 'caixa', 'bancos')} and {_not('nl', 'circulante')}"),
            _sql_pick("lb", f"{_has('nl', 'caixa')} and {_not('nl', 'circulante', 'fluxo', 'inicio', 'inicial', 'equivalente')}"),
            _sql_pick("lb", f"section is not null and {_has('ns', 'disponivel')} and {_not('ns', 'circulante')} and {_not('nl', 'circulante')}"),
            _sql_pick("lb", f"section is not null and {_has('ns', 'caixa')} and {_not('ns', 'circulante', 'fluxo')} and {_not('nl', 'circulante', 'fluxo')}"),
        ),
        _sql_first(*(_sql_pick("lf", f"{_has('nl', *x)} and {_not('nl', 'inicial', 'inicio')}") for x in (("saldo", "final"), ("caixa", "final"), ("caixa", "fim")))),
    ),
    "revenue_billing": (
        _sql_first(
            _sql_pick("ld", f"{_has('nl', 'receita', 'bruta')} and {_not('nl', 'liquida', 'deducoes', 'deducao')} and y > 0"),
            _sql_sum("ld", f"{_LEAF} and {_has('ns', 'receita', 'bruta')} and {_not('ns', 'deducoes', 'deducao')} and {_not('nl', 'liquida', 'lucro bruto', 'resultado', 'prejuizo')} and y > 0"),
        ),
        _sql_sum("lt", "not regexp_matches(nl, 'total|acumulad|media') and (contains(nl, cast(y as varchar)) or regexp_matches(nl, '[/. -]' || (y % 100) || '($|[^0-9])')) and y > 0", "doc_unit"),
    ),
    "expense_interest": (
        _sql_first(_sql_pick("ld", f"{_has('nl', 'despesa', 'financeira')} and {_not('nl', 'receita')}"), _sql_pick("ld", f"{_has('nl', 'juros', 'encargos')} and {_not('nl', 'receita', 'pagos')}")),
        _sql_sum("lm", "(contains(nl, 'juros') or contains(nl, 'encargos')) and nl not like 'total%' and nl not like '%total %'", "doc_unit"),
    ),
}
_SQL = {
    "assets_claims": ("db", "db", 100, 0.005, False, False, "divergent"), "cash": ("db", "df", 100, 0.005, True, False, "divergent"),
    "revenue_billing": ("dd", "dt", 500, 0.05, True, False, "grey"), "expense_interest": ("dd", "dm", 500, 0.05, True, True, "grey"),
}
_WITH = ", ".join([
    _DATA, _sql_doc("db", _B, False), *(_sql_doc(n, f"'{x}'", True) for n, x in (("df", "FLUXO_CAIXA"), ("dd", "DRE"), ("dt", "FATURAMENTO_24M"), ("dm", "MAPA_DIVIDA"))),
    _sql_lines("lb", "db", True, True), _sql_lines("lf", "df", False, True), _sql_lines("ld", "dd", True, True), _sql_lines("lt", "dt", False, False), _sql_lines("lm", "dm", False, False),
])


def _sql_check(check: str) -> str:
    one, two, absolute, relative, scaled, magnitude, differs = _SQL[check]
    a, b = _SIDES[check]
    scale = lambda s: f"case {_sql_normal(f'{s}.unit')} when 'r$ mil' then 1000 when 'r$' then 1 end"
    base = lambda s: f"{s}.value * coalesce({scale(s)}, 1)" if scaled else f"{s}.value"
    value = lambda s: f"abs({base(s)})" if magnitude else base(s)
    bad = f"not (a.unit is null or b.unit is null or {_sql_normal('a.unit')} = {_sql_normal('b.unit')} or ({scale('a')} is not null and {scale('b')} is not null))" if scaled else "false"
    factor = f"coalesce({scale('a')}, 1)" if scaled else "1"
    done = f"verdict in ('ok', '{differs}')"
    timed = "and ty.y is not null" if check == "revenue_billing" else ""
    return f"""(select t.case_id, t.entity_id, t.ref, '{check}' as "check", verdict, case when {done} then checked else 0 end as checked, case when {done} then unchecked else 0 end as unchecked,
  case when {done} then worst_gap end as worst_gap, case when {done} then worst_share end as worst_share from t join (
  select k, case when not bool_and(there) then 'missing' when bool_or(state = 'incomparable') or count(*) filter (where state in ('ok', 'apart')) = 0 then 'unmet' when bool_or(state = 'apart') then '{differs}' else 'ok' end as verdict,
    count(*) filter (where state in ('ok', 'apart')) as checked, count(*) filter (where state = 'unmet') as unchecked, max(gap) filter (where state = 'apart') as worst_gap,
    (list(case when va <> 0 then gap / abs(va) end order by gap desc, y) filter (where state = 'apart'))[1] as worst_share from (
    select k, y, there, va, abs(va - vb) as gap, case when not timely then null when va is null or vb is null then 'unmet' when bad then 'incomparable' when abs(va - vb) > greatest(factor * {absolute}, abs(va) * {relative}) then 'apart' else 'ok' end as state from (
      select ty.k, coalesce(ty.y, 0) as y, true {timed} as timely, p.k is not null and q.k is not null as there, cast({value('a')} as double) as va, cast({value('b')} as double) as vb, {bad} as bad, {factor} as factor
      from ty left join {one} p on p.k = ty.k left join {two} q on q.k = ty.k left join {a} a on a.k = ty.k and a.y = coalesce(ty.y, 0) left join {b} b on b.k = ty.k and b.y = coalesce(ty.y, 0))) group by k) v on v.k = t.k)"""


def _register_check(check: reconcile.Check) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = _documents(spark, sf_dir)
        return reconcile.reconciled(_lines(spark, sf_dir), documents, _targets(documents), [check]).select(*_KEYS, "check", *_VERDICT)

    run.__name__ = f"recon_{check.name}"
    query(f"with {_WITH} select * from {_sql_check(check.name)}")(run)


for _check in _CHECKS:
    _register_check(_check)

#: The checks that a type of document takes part in.
_TAKES = [(c.name, x) for c in _CHECKS for x in dict.fromkeys(c.a.types + c.b.types)]


@query(f"""with {_WITH}, res as materialized ({' union all '.join(f'select * from {_sql_check(c)}' for c in _SQL)}),
takes("check", doc_type) as (values {", ".join(f"('{c}', '{x}')" for c, x in _TAKES)}),
tries as (select d.doc_id, d.case_id, d.entity_id, d.doc_type, takes."check", p.ref, row_number() over (partition by d.doc_id, takes."check" order by p.ref <> d.ref, p.ref) as place
  from docs d join takes using (doc_type) join (select distinct case_id, ref from docs) p on p.case_id = d.case_id join refs a on a.ref = d.ref join refs b on b.ref = p.ref where p.ref = d.ref or len(a.years) = 0 or len(b.years) = 0 or list_has_any(a.years, b.years)),
got as (select tries.*, r.verdict, r.checked, r.unchecked, r.worst_gap, r.worst_share, row_number() over (partition by doc_id, tries."check" order by r.verdict = 'unmet', case when r.verdict = 'unmet' then -place else place end) as n
  from tries join res r on r.case_id = tries.case_id and r.entity_id is not distinct from tries.entity_id and r.ref = tries.ref and r."check" = tries."check")
select case_id, doc_id, doc_type, entity_id, "check", ref, verdict, checked, unchecked, worst_gap, worst_share from got where n = 1""")
def recon_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that each document's type takes part in, on the first period of its case that can be checked."""
    documents = _documents(spark, sf_dir)
    takes = spark.createDataFrame(_TAKES, "check string, doc_type string")
    tried = reconcile.by_document(documents, documents.select("case_id", "ref"), takes)
    targets = tried.select(*_KEYS).distinct().withColumn("entity_name", _name(F.col("entity_id")))
    results = reconcile.reconciled(_lines(spark, sf_dir), documents, targets, _CHECKS)
    return reconcile.first_met(tried, results).select("case_id", "doc_id", "doc_type", "entity_id", "check", "ref", *_VERDICT)


# --- pairs of labels --------------------------------------------------------------------

_ACCOUNTS = [
    "Capital social", "Capital social subscrito", "Prejuízos acumulados", "Resultados acumulados", "Reservas de lucros", "Empréstimos e financiamentos", "Financiamentos FINAME",
    "Obrigações tributárias", "Parcelamentos tributários", "Partes relacionadas", "Mútuos a pagar", "Total do passivo", "Veículos", "Veículos e empilhadeiras",
]
_CANONICAL = ["passivo_circulante", "patrimonio_liquido", "NAO_CLASSIFICAVEL", "", "patrimonio_liquido"]
_SUBS = ["Patrimônio líquido", "", "Empréstimos e financiamentos", "Partes relacionadas", "Imobilizado", "Obrigações tributárias"]
_SCOPE = "cast(floor(l_suppkey / 2) as bigint)"
#: A line's value follows its column and one of four amounts by label, so that labels agree; one line in 97 is off by one.
_DUP = f"""l as (select {_SCOPE} as scope, nullif({_sql_choose(_CANONICAL, 'l_suppkey')}, '') as section, {_sql_choose(_ACCOUNTS, 'l_partkey')} as label, case when l_returnflag = 'A' and l_linenumber = 1 then null else l_returnflag end as ec, 2020 + l_linenumber % 3 as pc,
  {_sql_choose(_SUBS, 'l_partkey')} as sub, (l_partkey % 14 // 2 % 4) * 500 * (1 + l_linenumber % 3) + case when l_orderkey % 97 = 0 then 1 else 0 end as v from lineitem),
one as materialized (select scope, section, {_sql_normal('label')} as key, ec, pc, min(label) as shown, max(v) as v, list(distinct {_sql_normal('sub')}) as subs from l
  where v <> 0 and section is not null and section <> 'NAO_CLASSIFICAVEL' and label not like 'Total%' and ec is not null group by scope, section, key, ec, pc having count(distinct v) = 1),
pr as (select a.scope, a.section, a.key as ka, b.key as kb, min(a.shown) as label_a, min(b.shown) as label_b, count(*) as n_columns, max(abs(a.v)) as value, bool_or(list_contains(b.subs, a.key) or list_contains(a.subs, b.key)) as subtotal_of,
  bool_or(list_has_any(a.subs, b.subs)) as same_sub, bool_or(len(list_filter(list_concat(a.subs, b.subs), lambda s: s <> '')) > 0) as has_sub from one a join one b on a.scope = b.scope and a.section = b.section and a.ec = b.ec and a.pc = b.pc and a.v = b.v and a.key < b.key group by all),
dc as (select distinct a.scope, a.section, a.key as ka, b.key as kb from one a join one b on a.scope = b.scope and a.section = b.section and a.ec = b.ec and a.pc = b.pc and a.v <> b.v and a.key < b.key),
rd as (select *, list_has_all({_sql_tokens('label_b')}, {_sql_tokens('label_a')}) or list_has_all({_sql_tokens('label_a')}, {_sql_tokens('label_b')}) as common_radical from pr),
pairs as materialized (select scope, section, label_a, label_b, n_columns, value, common_radical from rd where same_sub and not subtotal_of and (n_columns >= 2 or has_sub and common_radical)
  and not exists (select 1 from dc where dc.scope = rd.scope and dc.section = rd.section and dc.ka = rd.ka and dc.kb = rd.kb))"""


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda c: F.col(c)
    amount = F.floor(k("l_partkey") % 14 / 2) % 4 * 500 * (1 + k("l_linenumber") % 3) + F.when(k("l_orderkey") % 97 == 0, 1).otherwise(0)
    rows = read(spark, sf_dir, "lineitem").select(
        F.floor(k("l_suppkey") / 2).alias("scope"), F.nullif(_choose(_CANONICAL, "l_suppkey"), F.lit("")).alias("section"), _choose(_ACCOUNTS, "l_partkey").alias("label"),
        F.when((k("l_returnflag") != "A") | (k("l_linenumber") != 1), k("l_returnflag")).alias("ec"), (2020 + k("l_linenumber") % 3).alias("pc"), _choose(_SUBS, "l_partkey").alias("sub"), amount.alias("v"),
    )
    # every label's role is found once: of an aggregate, else Spark would find it for each line before it drops copies
    labels = rows.groupBy("label").agg(F.max("label").alias("_one")).where(roles.line_role(F.col("_one")) == "conta").select("label")
    return rows.join(labels, "label", "left_semi")


@query(f"with {_DUP} select * from pairs")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.pairs(_accounts(spark, sf_dir), ["scope"], "section", "label", ["ec", "pc"], "v", "sub")


@query(f"""with {_DUP}, sums as (select scope, count(*) as n, sum(value) as doubled from pairs group by 1)
select t.scope, case when n is null then 'ok' else 'divergent' end as verdict, coalesce(n, 0) as n_pairs, cast(coalesce(doubled, 0) as bigint) as doubled from (select distinct {_SCOPE} as scope from lineitem) t left join sums using (scope)""")
def recon_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scope whether labels were found twice, and the sum that is counted twice."""
    lines = _accounts(spark, sf_dir)
    scopes = read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_suppkey") / 2).alias("scope"))
    return duplicates.reconciled(duplicates.pairs(lines, ["scope"], "section", "label", ["ec", "pc"], "v", "sub"), scopes, ["scope"])
