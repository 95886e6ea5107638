"""Queries of the balance-sheet classifier, over labels and sections chosen for every part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import balance, statements
from .labels import _choose, _sql_choose, _sql_words
from .registry import query, read

_LABELS = [
    "TOTAL DO ATIVO", "Circulante", "Não Circulante", "Realizável a Longo Prazo", "Imobilizado", "Patrimônio Líquido", "Total do Passivo e do Patrimônio Líquido", "Caixa e bancos",
    "Duplicatas a receber", "Estoques de mercadorias", "Máquinas e equipamentos", "Marcas e patentes", "Participação em coligadas", "Depósitos judiciais", "Fornecedores nacionais", "Salários a pagar",
    "Empréstimos bancários", "Financiamentos de longo prazo", "Mútuo a receber de coligada", "Adiantamentos de clientes", "Receita diferida", "ICMS a recolher", "Impostos a recuperar", "Capital social",
    "Lucros acumulados", "ICMS a recuperar", "PECLD", "Cheques a compensar", "Produtos em andamento", "INSS", "Adiantamento para futuro aumento de capital", "Receita de vendas de mercadorias", "Custo das mercadorias vendidas", "Despesas antecipadas", "Provisão para contingências", "Outras contas", "Terrenos", "Saldo em 31/12/2024", "Lucro líquido",
]
_SECTIONS = ["", "Ativo Circulante", "Ativo Não Circulante", "Passivo Circulante", "Passivo - longo prazo", "Patrimônio Líquido", "Passivo e Patrimônio Líquido", "Imobilizado", "Contas a receber"]


def _sql_tokens(c: str) -> str:
    """The statement tokens of a label in SQL: words in the singular, without connectives."""
    cases = " ".join(f"when w like '%{end}' and length(w) >= {least} then left(w, length(w) - {cut}) || '{put}'" for end, cut, put, least in statements.PLURALS)
    words = f"list_transform({_sql_words(c)}, lambda w: case {cases} else w end)"
    return f"list_distinct(list_filter({words}, lambda w: w not in ({', '.join(repr(x) for x in statements.CONNECTIVES)})))"


def _has(t: str, phrase: str) -> str:
    return f"list_has_all({t}, [{', '.join(repr(w) for w in balance.phrase_tokens(phrase))}])"


def _any(t: str, phrases) -> str:
    return "(" + " or ".join(_has(t, p) for p in phrases) + ")"


_SECTIONS_BY_WORDS = (("patrimonio_liquido", balance.EQUITY), ("ativo_circulante", balance.CURRENT_ASSETS), ("ativo_nao_circulante", balance.NON_CURRENT_ASSETS), ("passivo_circulante", balance.CURRENT_CLAIMS), ("passivo_nao_circulante", balance.NON_CURRENT_CLAIMS))
_NON_CURRENT = f"case when {_any('o', balance.INTANGIBLE)} then 'intangivel' when {_any('o', balance.FIXED)} then 'imobilizado' when {_any('o', balance.INVESTMENTS)} then 'investimentos' when {_any('o', balance.LONG_TERM)} then 'realizavel_lp' else 'ativo_nao_circulante' end"
_ROWS = f"""l0 as (select p_partkey, {_sql_choose(_LABELS, 'p_partkey')} as label, {_sql_choose(_SECTIONS, '(p_partkey // 39)')} as section from part),
d as (select distinct label, section, {_sql_tokens('label')} as o, {_sql_tokens('section')} as s from l0),
a as (select *, list_contains(o, 'passivo') or list_contains(s, 'passivo') as claims, list_contains(o, 'ativo') or list_contains(s, 'ativo') as assets,
  {_any('o', ('nao circulante', 'longo prazo', 'permanente'))} as late, {_any('s', ('nao circulante', 'longo prazo', 'permanente'))} as s_late, {_has('o', 'patrimonio liquido')} as equity from d),
b as (select *, list_contains(o, 'circulante') and not late as now,
  list_has_any(o, ['total', 'soma']) or (len(o) > 0 and list_has_all([{', '.join(repr(x) for x in balance.STRUCTURE)}], o)) as total from a),
c as (select *, case when not total then null when list_contains(o, 'passivo') and equity then 'PASSIVO_PL' when list_contains(o, 'realizavel') then 'realizavel_lp'
  when list_contains(o, 'investimento') and not claims then 'investimentos' when list_contains(o, 'imobilizado') and not claims then 'imobilizado' when list_contains(o, 'intangivel') and not claims then 'intangivel'
  when equity or (list_contains(s, 'patrimonio') and not list_has_any(o, ['ativo', 'passivo'])) then 'patrimonio_liquido' when claims and now then 'passivo_circulante' when claims and late then 'passivo_nao_circulante'
  when (assets or not claims) and now then 'ativo_circulante' when (assets or not claims) and late then 'ativo_nao_circulante_grp' when assets then 'ATIVO' when claims then 'PASSIVO_PL' end as anchor from b),
e as (select *, case when list_contains(s, 'circulante') then null {' '.join(f"when {_has('s', p)} then '{k}'" for p, k in balance.SUBSECTIONS)} end as sub,
  case when list_contains(s, 'ativo') and s_late then {_NON_CURRENT} when list_contains(s, 'ativo') and list_contains(s, 'circulante') then 'ativo_circulante' when list_contains(s, 'passivo') and s_late then 'passivo_nao_circulante'
    when list_contains(s, 'passivo') and list_contains(s, 'circulante') then 'passivo_circulante' when not list_contains(s, 'passivo') and {_has('s', 'patrimonio liquido')} then 'patrimonio_liquido' end as declared,
  case when {_any('o', balance.RESULT)} and not {_any('o', balance.NOT_RESULT)} then null when list_contains(o, 'adiantamento') and list_contains(o, 'cliente') then 'passivo_circulante' when {_any('o', balance.DEFERRED)} then 'passivo_circulante'
    when {_any('o', balance.TAXES)} and {_any('o', balance.OWED)} then 'passivo_circulante'
    when {_any('o', balance.LOANS)} and list_has_any(o, ['receber', 'concedido']) then case when {_any('o', ('longo prazo', 'nao circulante'))} then 'realizavel_lp' else 'ativo_circulante' end
    when {_any('o', balance.LOANS)} then case when {_any('o', ('longo prazo', 'nao circulante'))} then 'passivo_nao_circulante' else 'passivo_circulante' end
    {' '.join(f"when {_any('o', p)} then {_NON_CURRENT if k == 'ativo_nao_circulante' else repr(k)}" for k, p in _SECTIONS_BY_WORDS)} end as worded from c),
r as (select label, section, anchor, case when anchor is null then coalesce(sub, declared, worded) end as found from e)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").withColumn("_k", F.floor(F.col("p_partkey") / 39)).select("p_partkey", _choose(_LABELS, "p_partkey").alias("label"), _choose(_SECTIONS, "_k").alias("section"))


def _known(lines: DataFrame, *columns) -> DataFrame:
    """Every distinct pair of section and label is classified once."""
    return lines.join(lines.select("label", "section").distinct().select("label", "section", *columns), ["label", "section"])


@query(f"with {_ROWS} select p_partkey, l0.label, found, anchor from l0 join r using (label, section)")
def balance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = balance.classify(F.col("section"), F.col("label")).alias("c")
    return _known(_lines(spark, sf_dir), c).select("p_partkey", "label", F.col("c.section").alias("found"), "c.anchor")


@query(f"""with {_ROWS} select p_partkey, case when anchor is null and found is null then case when p_partkey % 3 = 0 then 'custos' end else found end as account,
  {_any(_sql_tokens('l0.label'), [*(p for p, _ in balance.SUBSECTIONS), *balance.GROUPINGS])} as grouping from l0 join r using (label, section)""")
def account_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first; a hint only where they find nothing and it is a known key."""
    hint = F.when(F.col("p_partkey") % 3 == 0, "custos").when(F.col("p_partkey") % 3 == 1, "unheard of")
    lines = _known(_lines(spark, sf_dir), balance.classify(F.col("section"), F.col("label")).alias("c"), balance.is_grouping(F.col("label")).alias("grouping"))
    return lines.select("p_partkey", balance.account(F.col("c"), hint, ["custos", "receita_bruta"]).alias("account"), "grouping")


_FAMILIES = {"ativo_circulante": "balanco", "passivo_circulante": "balanco", "custos": "dre", "receita_bruta": "dre", "atividades_operacionais": "fluxo_caixa"}


@query(f"""with {_ROWS}, x as (select p_partkey, label, section, anchor, found, case p_partkey % 5 when 0 then 'custos' when 1 then 'elsewhere' end as canonical from l0 join r using (label, section))
select p_partkey, case when canonical = 'custos' then 'dre' when label = 'Saldo em 31/12/2024' then 'dmpl' when label = 'Receita de vendas de mercadorias' and section like '%Ativo%' then 'fluxo_caixa' when label in ('Receita de vendas de mercadorias', 'Custo das mercadorias vendidas', 'Lucro líquido') then 'dre'
  when found is not null or anchor is not null then 'balanco' end as family from x where label in ('Receita de vendas de mercadorias', 'Custo das mercadorias vendidas', 'Lucro líquido', 'Saldo em 31/12/2024', 'Caixa e bancos', 'Terrenos', 'Outras contas', 'Capital social', 'Fornecedores nacionais') and section not like '%Passivo%'""")
def statement_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement of a line: told by a canonical section, else found by its words.

    Sales under a section of assets have the words of a sale of assets, which is cash flow.
    """
    some = ("Receita de vendas de mercadorias", "Custo das mercadorias vendidas", "Lucro líquido", "Saldo em 31/12/2024", "Caixa e bancos", "Terrenos", "Outras contas", "Capital social", "Fornecedores nacionais")
    lines = _lines(spark, sf_dir).where(F.col("label").isin(*some) & ~F.col("section").contains("Passivo"))
    canonical = F.when(F.col("p_partkey") % 5 == 0, "custos").when(F.col("p_partkey") % 5 == 1, "elsewhere")
    known = _known(lines, balance.family(F.col("section"), F.col("label")).alias("own"))
    told = F.create_map(*(F.lit(x) for kv in _FAMILIES.items() for x in kv))
    return known.select("p_partkey", F.coalesce(F.try_element_at(told, canonical), "own").alias("family"))
