"""Queries of the label, period and unit functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files, period, roles, statements, text, units
from ..operators.pick import first_per_key
from ..sources import readers
from .registry import query, read

_FOLD = f"'{text.FOLD_FROM}', '{text.FOLD_TO}'"
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def _sql_normal(c: str) -> str:
    return f"trim(regexp_replace(translate(lower(coalesce({c}, '')), {_FOLD}), '\\s+', ' ', 'g'))"


def _sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace({_sql_normal(c)}, '[^a-z0-9]+', ' ', 'g'), '\\s+'), lambda w: w <> '')"


def _sql_radicals(c: str) -> str:
    return f"list_sort(list_distinct(list_transform({_sql_words(c)}, lambda w: left(w, 5))))"


def _sql_tokens(c: str) -> str:
    return f"list_sort(list_distinct(list_filter({_sql_words(c)}, lambda w: w not in ({_STOP}))))"


def _choose(values: list[str], key: str) -> Column:
    """One of some values by a number, the same as the SQL below."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _sql_choose(values: list[str], key: str) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[{key} % {len(values)} + 1]"


@query(f"select doc_id, sha256({_sql_normal('text')}) as normal_sha256, cast(length({_sql_normal('text')}) as bigint) as n from documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.normalize(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("normal_sha256"), F.length(t).cast("long").alias("n"))


@query(f"select p_partkey, array_to_string({_sql_tokens('p_name')}, '|') as tokens, array_to_string({_sql_radicals('p_name')}, '|') as radicals from part")
def structural_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.structural_tokens(name), "|").alias("tokens"), F.array_join(text.radicals(name), "|").alias("radicals"))


@query(f"""
with n as (select distinct p_name, {_sql_radicals('p_name')} as r from part),
s as (select distinct split_part(p_name, ' ', 1) as short from part), t as (select short, {_sql_radicals('short')} as r from s)
select short, p_name as long from t join n on list_has_all(n.r, t.r) where length(short) >= 4""")
def contained_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels within other labels: candidates share a radical, so no label meets all others."""
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("long")).distinct()
    short = names.select(F.split("long", " ")[0].alias("short")).distinct()
    a = short.withColumn("r", F.explode(text.radicals(F.col("short"))))
    b = names.withColumn("r", F.explode(text.radicals(F.col("long"))))
    return a.join(b, "r").select("short", "long").distinct().where(text.contained(F.col("short"), F.col("long")))


_LABELS = [
    "Total do Ativo", "ATIVO CIRCULANTE", "Passivo Não Circulante", "Margem bruta", "Janeiro/2024", "Caixa líquido gerado nas operações",
    "Receita Líquida", "Fornecedores", "Índice de liquidez", "Dez - faturamento", "Realizável a longo prazo", "Duplicatas a receber",
]
_TYPES = ["BALANCO", "FATURAMENTO_24M", "DRE", "FATURAMENTO_24M", "FATURAMENTO_24M"]


@query(f"""
with l as (select p_partkey, {_sql_choose(_LABELS, 'p_partkey')} as label, {_sql_choose(_TYPES, 'p_partkey')} as kind from part),
n as (select *, {_sql_normal('label')} as t, array_to_string({_sql_tokens('label')}, '|') as toks,
  (select min(m) from (values {", ".join(f"('{k}', {v})" for k, v in period.MONTHS.items())}) d(w, m) where list_contains({_sql_words('label')}, d.w)) as month from l),
r as (select *, case when regexp_matches(t, '{"|".join(roles.DERIVED)}') then 'derivado'
  when kind = 'FATURAMENTO_24M' and month is not null then 'serie_mensal'
  when regexp_matches(t, '{roles.SUBTOTAL_WORDS}') or toks in ({", ".join("'" + "|".join(x) + "'" for x in roles.SUBTOTAL_TOKENS)})
    or t in ({", ".join(f"'{x}'" for x in roles.SUBTOTAL_LABELS)}) or regexp_matches(t, '{roles.SUBTOTAL_FLOWS}') then 'subtotal' else 'conta' end as role from n)
select p_partkey, label, cast(month as integer) as month, role, cast(case role when 'subtotal' then 0 when 'serie_mensal' then 1 when 'derivado' then 2 else 3 end as integer) as priority from r""")
def label_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", _choose(_LABELS, "p_partkey").alias("label"), _choose(_TYPES, "p_partkey").alias("kind"))
    role = roles.line_role(F.col("label"), F.col("kind"))
    return rows.select("p_partkey", "label", period.month_of_label(F.col("label")).alias("month"), role.alias("role")).withColumn("priority", roles.role_priority(F.col("role")))


@query("""
with r as (select o_orderkey, case o_orderkey % 8 when 0 then strftime(o_orderdate, '%d/%m/%Y') when 1 then '12M' || strftime(o_orderdate, '%y')
  when 2 then strftime(o_orderdate, '%Y-%m-%d') when 3 then '3m' || strftime(o_orderdate, '%Y') when 4 then cast(quarter(o_orderdate) as varchar) || 'T' || strftime(o_orderdate, '%y')
  when 5 then strftime(o_orderdate, '%y') || ', 24' when 6 then 'L24M' else strftime(o_orderdate, '%y') end as ref, o_orderdate as d, year(o_orderdate) as y from orders)
select o_orderkey, case o_orderkey % 8 when 0 then strftime(d, '%Y-%m-%d') when 1 then cast(y as varchar) when 2 then ref when 3 then ref
  when 4 then cast(quarter(d) as varchar) || 't' || y when 5 then array_to_string(list_sort([cast(y as varchar), '2024']), ',') when 6 then 'l24m' else cast(y as varchar) end as canonical,
  case when o_orderkey % 8 = 5 then y || '|2024' when o_orderkey % 8 = 6 then '' else cast(y as varchar) end as years from r""")
def canonical_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in eight notations; the years of each."""
    d = F.col("o_orderdate")
    y2, y4 = F.date_format(d, "yy"), F.date_format(d, "yyyy")
    forms = [F.date_format(d, "dd/MM/yyyy"), F.concat(F.lit("12M"), y2), F.date_format(d, "yyyy-MM-dd"), F.concat(F.lit("3m"), y4), F.concat(F.quarter(d).cast("string"), F.lit("T"), y2), F.concat(y2, F.lit(", 24")), F.lit("L24M"), y2]
    ref = F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", ref.alias("ref"))
    return rows.select("o_orderkey", period.canonical(F.col("ref")).alias("canonical"), F.array_join(period.years(F.col("ref")), "|").alias("years"))


@query("""
with r as (select o_orderkey, case o_orderkey % 4 when 0 then 'dez/' || strftime(o_orderdate, '%y') when 1 then strftime(o_orderdate, '%Y') || ' vs 2000' when 2 then 'sem data' else null end as t, year(o_orderdate) as y from orders)
select o_orderkey, case o_orderkey % 4 when 0 then '20' || right(cast(y as varchar), 2) when 1 then array_to_string(list_sort(list_distinct([y, 2000])), '|') else '' end as years,
  o_orderkey % 4 in (2, 3) or (o_orderkey % 4 = 1) as fits_2000 from r""")
def years_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.concat(F.lit("dez/"), F.date_format(d, "yy"))).when(k == 1, F.concat(F.date_format(d, "yyyy"), F.lit(" vs 2000"))).when(k == 2, "sem data")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))
    fits = F.when(k == 0, False).otherwise(period.compatible(F.when(k == 1, F.concat(F.substring("t", 1, 4), F.lit(",2000"))).otherwise(F.col("t")), F.lit("2000")))
    return rows.select("o_orderkey", F.array_join(period.years_of_text(F.col("t")), "|").alias("years"), fits.alias("fits_2000"))


_UNITS = ["R$ mil", "Unidade", "milhões", "caixas", "Milhar"]
_FREE = ["em R$ mil", "R$", "valores em milhões de reais", "caixas", "Unidade", "1", "1.000", "US$", "euro", "GBP"]


@query(f"""
with u as (select l_orderkey, l_linenumber, l_partkey, cast(l_extendedprice as decimal(18,2)) as v, case when l_linenumber = 7 then null else {_sql_choose(_UNITS, 'l_linenumber')} end as unit from lineitem),
f as (select *, case {_sql_normal('unit')} when 'r$ mil' then 1000 when 'unidade' then 1 when 'milhoes' then 1000000 when 'milhar' then 1000 end as factor from u)
select unit, cast(factor as integer) as factor, count(*) as n, cast(sum(v * coalesce(factor, 1)) as double) as total, case when unit is null or factor is not null then null else unit || ' <> milhar' end as reason from f group by unit, factor""")
def scale_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("l_linenumber") != 7, _choose(_UNITS, "l_linenumber"))
    rows = read(spark, sf_dir, "lineitem").select(unit.alias("unit"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    rows = rows.select("unit", units.scale_factor(F.col("unit")).alias("factor"), units.in_base(F.col("v"), F.col("unit")).alias("b"))
    out = rows.groupBy("unit", "factor").agg(F.count("*").alias("n"), F.sum("b").cast("double").alias("total"))
    return out.withColumn("reason", units.incomparable(F.col("unit"), F.lit("milhar")))


@query(f"""
with u as (select p_partkey, {_sql_choose(_FREE, 'p_partkey')} as free, p_partkey % 10 as k from part)
select p_partkey, free, ([ 'milhar', 'unidade', 'milhao', null, 'unidade', 'unidade', 'milhar', null, null, null ])[k + 1] as unit,
  ([ 'BRL', 'BRL', 'BRL', null, null, null, null, 'USD', 'EUR', 'GBP' ])[k + 1] as currency, k = 5 as non_monetary from u""")
def free_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", _choose(_FREE, "p_partkey").alias("free"))
    label = F.when(F.col("free") == "1", "Lucro por ação").otherwise("Caixa")
    return rows.select("p_partkey", "free", units.normal_unit(F.col("free")).alias("unit"), units.normal_currency(F.col("free")).alias("currency"), units.non_monetary(label, F.col("free")).alias("non_monetary"))


@query("""
with n as (select p_partkey, p_name, upper(p_name) || ' Ltda.' as full_name, left(split_part(p_name, ' ', 1), 4) || ' ' || split_part(p_name, ' ', 2) as short,
  split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) as turned from part)
select p_partkey, lower(p_name) as canonical, greatest(length(regexp_extract(short, '^[^ ]*')), length(split_part(short, ' ', 2))) >= 4 or short = lower(p_name) as same_short, lower(turned) = lower(p_name) as same_turned from n""")
def fuzzy_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortened name is the same entity, one with its words turned round is not."""
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    full = F.concat(F.upper("p_name"), F.lit(" Ltda."))
    short = F.concat(F.left(first, F.lit(4)), F.lit(" "), second)
    turned = F.concat(second, F.lit(" "), first)
    return read(spark, sf_dir, "part").select("p_partkey", text.canonical_entity(full).alias("canonical"), text.same_entity(full, short).alias("same_short"), text.same_entity(full, turned).alias("same_turned"))


@query(f"""
with c as (select p_brand, p_name, p_partkey, p_retailprice, row_number() over (partition by p_brand order by p_retailprice desc, length(p_name), p_name, p_partkey) as r
  from part where contains({_sql_normal('p_name')}, 'ring') and not contains({_sql_normal('p_name')}, 'small'))
select p_brand, p_name, p_partkey, p_retailprice from c where r = 1""")
def concept_pick_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").where(text.has_terms(F.col("p_name"), ["ring"], ["small"])).select("p_brand", "p_name", "p_partkey", "p_retailprice")
    return first_per_key(rows, ["p_brand"], [-F.col("p_retailprice"), F.length("p_name"), F.col("p_name"), F.col("p_partkey")])


_NUMBERS = ["1.234,56", "1234.5", " 7 ", "0,67", "x1", ""]


@query(f"select p_partkey, ([1234.56, 1234.5, 7.0, 0.67, null, null])[p_partkey % 6 + 1]::double as value, 'balanco patrimonial 2024' as label, p_partkey % 2 = 0 as spreadsheet from part")
def locale_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", _choose(_NUMBERS, "p_partkey").alias("t"))
    mime = F.when(F.col("p_partkey") % 2 == 0, "application/vnd.ms-excel").otherwise("application/pdf")
    return rows.select("p_partkey", text.locale_number(F.col("t")).alias("value"), text.file_label(F.lit("Balanço_Patrimonial-2024.PDF")).alias("label"), readers.is_spreadsheet(mime).alias("spreadsheet"))


@query("""select page_id, cast(len(regexp_extract_all(html, '<a\\s[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) as integer) as n_links,
  sha256(array_to_string(regexp_extract_all(html, '<a\\s[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1), ' ')) as links_sha256 from pages""")
def html_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = readers.attributes(F.coalesce("html", F.lit("")), "a", "href")
    return read(spark, sf_dir, "pages").select("page_id", F.size(links).alias("n_links"), F.sha2(F.array_join(links, " "), 256).alias("links_sha256"))


@query("select event_type, count(*) as n, sum(cast(json_extract(props, '$.k') as bigint)) as total, cast(max(cast(json_extract(props, '$.k') as bigint)) as bigint) as top from events group by event_type")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = readers.json_field(F.col("props"), "k", "long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


@query("""
with c as (select user_id, event_type, count(*) as n from events group by all)
select user_id, '{' || string_agg('"' || event_type || '":' || n, ',' order by event_type) || '}' as counts from c group by user_id""")
def json_object_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))
    return c.groupBy("user_id").agg(F.to_json(pairs).alias("counts"))


@query("""select r_name, count(*) as n, 'n_nationkey | n_name' || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) order by n_nationkey) as text
  from nation join region on n_regionkey = r_regionkey group by r_name""")
def rows_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey", "n_name")
    return readers.rows_as_text(rows, ["r_name"], "n_nationkey").join(rows.groupBy("r_name").agg(F.count("*").alias("n")), "r_name")


@query("""
with d as (select doc_id, sha256(coalesce(text, '')) as digest from documents)
select doc_id, digest, min(doc_id) over (partition by digest) as first_id, doc_id <> min(doc_id) over (partition by digest) as seen_before from d""")
def seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts by digest; the first id is combined before it moves, so hot copies cost little."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    return d.join(first, "digest").select("doc_id", "digest", "first_id", (F.col("doc_id") != F.col("first_id")).alias("seen_before"))


_LINES = [
    ("Receita Líquida", None, None, "receita_liquida"), ("Vendas de mercadorias", None, "receita_bruta", None), ("Aluguéis", "Despesas operacionais", "despesas_operacionais", None),
    ("Lucro bruto", None, None, "lucro_bruto"), ("Juros sobre empréstimos", None, "resultado_financeiro", None), ("Parafusos", None, None, None), ("CSLL corrente", None, "impostos_lucro", None),
]


@query(
    "select p_partkey, label, section, anchor from part join (values "
    + ", ".join(f"({k}, '{l}', {repr(s) if s else 'null'}, {repr(a) if a else 'null'})" for k, (l, _, s, a) in enumerate(_LINES))
    + f") v(k, label, section, anchor) on v.k = p_partkey % {len(_LINES)}"
)
def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an income statement by total or section; the labels are classified once each."""
    lines = spark.createDataFrame([(k, label, declared) for k, (label, declared, _, _) in enumerate(_LINES)], "k int, label string, declared string")
    known = lines.select("k", "label", statements.classify(F.col("declared"), F.col("label"), statements.INCOME).alias("c")).select("k", "label", "c.section", "c.anchor")
    parts = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(_LINES)).cast("int").alias("k"))
    return parts.join(F.broadcast(known), "k").select("p_partkey", "label", "section", "anchor")


_FILES = [("13_Balancete_Analítico", "BALANCETE"), ("DRE", "DRE"), ("Faturamento", "FATURAMENTO_24M"), ("Balanço Patrimonial", "BALANCO"), ("qualquer coisa", "")]


@query(f"""
with n as (select o_orderkey, {_sql_choose([k for _, k in _FILES], 'o_orderkey')} as kind, year(o_orderdate) + 30 as y, right(cast(year(o_orderdate) + 30 as varchar), 2) as yy, (o_orderkey // 5) % 10 as k, quarter(o_orderdate) as q, (o_orderkey // 50) % 2 = 0 as signed from orders),
p as (select *, case k when 0 then '12M' || yy when 1 then 'L24M' when 2 then q || 'T' || yy when 3 then cast(y as varchar) when 4 then yy || ',' || right(cast(y + 1 as varchar), 2) || ',' || right(cast(y + 2 as varchar), 2)
  when 5 then 'L36M' when 7 then yy || ',' || right(cast(y + 1 as varchar), 2) || ',' || right(cast(y + 2 as varchar), 2) when 8 then 'L36M' when 9 then yy || ',' || right(cast(y + 1 as varchar), 2) end as ref from n)
select o_orderkey, nullif(kind, '') as type, ref as period, case when signed then true end as signed,
  round((case when kind <> '' then 0.6 else 0 end) + (case when ref is null then 0 when k = 3 then 0.05 else 0.3 end) + (case when signed then 0.1 else 0 end), 2) as confidence,
  kind = '' or round(0.6 + (case when ref is null then 0 when k = 3 then 0.05 else 0.3 end) + (case when signed then 0.1 else 0 end), 2) < 0.7 as ask from p""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names in ten notations say of a file."""
    d, k = F.col("o_orderdate"), F.floor(F.col("o_orderkey") / 5) % 10
    y = F.year(d) + 30
    y2 = F.right(y.cast("string"), F.lit(2))
    notations = [F.concat(F.lit("12M"), y2), F.lit("L24M"), F.concat(F.quarter(d).cast("string"), F.lit("T"), y2), y.cast("string"), F.concat(y.cast("string"), F.lit(" a "), (y + 2).cast("string")), F.lit("36 meses"), F.lit(""),
        F.concat(y2, F.lit(", "), F.right((y + 1).cast("string"), F.lit(2)), F.lit(" e "), F.right((y + 2).cast("string"), F.lit(2))), F.lit("36meses"), F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string"))]
    rows = read(spark, sf_dir, "orders").withColumn("word", _choose([w for w, _ in _FILES], "o_orderkey"))
    signed = F.when(F.floor(F.col("o_orderkey") / 50) % 2 == 0, F.lit("_assinado")).otherwise("")
    name = F.concat(F.col("word"), F.lit("_"), F.element_at(F.array(*notations), (k + 1).cast("int")), signed, F.lit(".pdf"))
    c = files.classify_name(name).alias("c")
    return rows.select("o_orderkey", c).select("o_orderkey", "c.type", F.col("c.period.ref").alias("period"), "c.signed", "c.confidence", "c.ask")


@query("""
with s as (select o_orderkey, case when o_orderkey % 3 > 0 then 'A' || o_orderkey % 4 end as a, case when o_orderkey % 4 > 0 then 'B' || o_orderkey % 5 end as b, (o_orderkey % 7) / 10.0 as ca, (o_orderkey % 5) / 10.0 as cb, case when o_orderkey % 2 = 0 then 'x' end as pa, case when o_orderkey % 5 = 0 then 'y' end as pb from orders)
select o_orderkey, case when a is not null and (b is null or cb < ca) then a else b end as type, coalesce(pb, pa) as period, greatest(ca, cb) as confidence, case when a is not null and (b is null or cb < ca) then 'name' else 'content' end as origin from s""")
def classifications_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    some = lambda when, letter, n: F.when(when, F.concat(F.lit(letter), (k % n).cast("string")))
    side = lambda kind, period, sure: F.struct(kind.alias("type"), period.alias("period"), F.lit(None).cast("boolean").alias("signed"), F.lit(None).cast("string").alias("entity"), sure.alias("confidence"))
    name = side(some(k % 3 > 0, "A", 4), F.when(k % 2 == 0, "x"), k % 7 / 10.0)
    content = side(some(k % 4 > 0, "B", 5), F.when(k % 5 == 0, "y"), k % 5 / 10.0)
    m = files.merge_classifications(name, content).alias("m")
    return read(spark, sf_dir, "orders").select("o_orderkey", m).select("o_orderkey", "m.type", "m.period", "m.confidence", "m.origin")
