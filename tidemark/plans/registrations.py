"""Queries of registration: an order is a version of a document of its case, its lines are the payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registration as reg
from ..operators.match import _cut
from .registry import query, read

_TOTALS = ("Total do Ativo", "Passivo e Patrimônio Líquido")
_LIMIT = "0.9"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of four documents a case; every 23rd order is an unknown version."""
    case_id, k = F.floor(F.col("o_custkey") / 10), F.col("o_orderkey")
    return read(spark, sf_dir, "orders").where("o_orderkey % 23 <> 0").select(k.alias("version"), (case_id * 4 + k % 4).alias("document"), case_id.alias("case_id"))


def _payloads(spark: SparkSession, sf_dir: str, earlier: bool = False) -> DataFrame:
    """JSON as an extraction gives it: some numbers unreadable, labels missing, values repeated, calls failed.

    Earlier, every seventh order was less sure. A line's source names its supplier, by whom it is
    sure: lines that exchange their confidences are not the same lines.
    """
    part, supp, k, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")
    text = lambda c: c.cast("string")
    label = F.when(part % 13 == 0, _TOTALS[0]).when(part % 13 == 1, _TOTALS[1]).when(part % 13 > 2, F.concat(F.lit("conta "), text(part % 40)))
    units = text(F.col("l_quantity").cast("long"))
    value = F.when((k % 5 == 0) & (n < 6), "1000").when(part % 11 == 0, "12,5").when(part % 11 == 1, F.concat(F.lit("-"), units)).otherwise(F.concat(units, F.lit("00.5")))
    sure = F.when(part % 17 == 0, "alta").otherwise(F.concat(F.lit("0."), text(F.when((k % 4 == 0) | (F.lit(earlier) & (k % 7 == 0)), supp % 70 + 30).otherwise(supp % 20 + 80))))
    page = F.concat(text(n), F.when(part % 3 == 0, "a").otherwise(""))
    item = F.struct(label.alias("chave"), value.alias("valor_num"), sure.alias("confianca"), page.alias("origem_pagina"), F.when(F.col("l_returnflag") == "R", "A").alias("entidade_coluna"), text(supp).alias("origem_linha"))
    items = read(spark, sf_dir, "lineitem").groupBy(k.alias("version")).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("payload"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version"), F.when(F.col("o_orderkey") % 19 == 0, "timeout").alias("failure"))
    return orders.join(items, "version", "left")


def _registered(spark: SparkSession, sf_dir: str, earlier: bool = False) -> DataFrame:
    return reg.registered(_payloads(spark, sf_dir, earlier), _versions(spark, sf_dir), F.lit("N2"), F.lit(_LIMIT).cast("decimal(4,2)"))


_SQL = f"""
with v as (select o_orderkey as version, floor(o_custkey / 10)::bigint as case_id, floor(o_custkey / 10)::bigint * 4 + o_orderkey % 4 as document, o_orderkey % 23 <> 0 as known, o_orderkey % 19 = 0 as failed from orders),
f as (select l_orderkey as version, case when l_partkey % 13 = 0 then '{_TOTALS[0]}' when l_partkey % 13 = 1 then '{_TOTALS[1]}' when l_partkey % 13 = 2 then '(sem rótulo)' else 'conta ' || (l_partkey % 40) end as label, l_partkey % 13 > 1 as plain,
  case when l_orderkey % 5 = 0 and l_linenumber < 6 then 1000 when l_partkey % 11 = 0 then null when l_partkey % 11 = 1 then -floor(l_quantity) else floor(l_quantity) * 100 + 0.5 end as value,
  case when l_partkey % 17 > 0 then case when l_orderkey % 4 = 0 then l_suppkey % 70 + 30 else l_suppkey % 20 + 80 end end as percent,
  case when l_partkey % 3 > 0 then l_linenumber end as page, l_returnflag = 'R' as a from lineitem join v on version = l_orderkey),
top as (select version, greatest(max(abs(value)) / 100, 1) as floor_ from f group by all),
rep as (select version, a, value, count(distinct label) as n from f join top using (version) where plain and value <> 0 and abs(value) >= floor_ group by all),
best as (select version, n, value from rep qualify row_number() over (partition by version order by n desc, abs(value) desc, value desc) = 1),
labels as (select version, array_to_string(list_sort(list(distinct f.label)), '|') as labels from f join best using (version) where f.value = best.value and n >= 4 group by all),
g as (select version, case_id, document, known, failed, count(f.label) as n_fields, count(*) filter (where percent < 70) as n_low, count(*) filter (where percent >= 90) as n_sure from v left join f using (version) group by all),
r as (select g.*, coalesce(best.n, 0) as n_repeating, best.value as repeated_value, coalesce(labels, '') as repeating_labels, coalesce(best.n, 0) >= 4 as suspicious, n_low >= 3 and n_low * 10 >= n_fields * 3 as too_low from g left join best using (version) left join labels using (version)),
o as (select *, case when not known then 'orphan' when n_sure = 0 then 'pending' when suspicious or too_low or failed then 'withheld' else 'accepted' end as outcome from r)
"""


@query(_SQL + "select version, n_fields, n_low, n_repeating, repeated_value, repeating_labels, suspicious, too_low, n_sure, outcome from o")
def extraction_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guards say of every version, and whether its sure lines were accepted."""
    g = F.col("guards")
    fields = [g[c].alias(c) for c in ("n_fields", "n_low", "n_repeating", "suspicious", "too_low")]
    return _registered(spark, sf_dir).select("version", *fields, g["repeated_value"].cast("double").alias("repeated_value"), F.array_join(g["repeating_labels"], "|").alias("repeating_labels"), "n_sure", "outcome")


@query(_SQL + "select version, label, value, percent / 100 as confidence, page, case when outcome = 'accepted' and percent >= 90 then 'accepted' else 'pending' end as status, case when outcome = 'accepted' and percent >= 90 then 'system' end as accepted_by from f join o using (version) where known")
def fields_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every known version with their state."""
    # outer: Spark would work the lines out a second time to drop versions without any
    rows = _registered(spark, sf_dir).select("version", F.explode_outer("lines").alias("x")).where("x is not null")
    return rows.select("version", "x.label", F.col("x.value").cast("double").alias("value"), F.col("x.confidence").cast("double").alias("confidence"), "x.page", "x.status", "x.accepted_by")


_KINDS = [reg.SUSPICIOUS, reg.UNSURE, reg.FAILED]


@query(_SQL + f""",
said as (select case_id, document, version, unnest(['{reg.SUSPICIOUS}', '{reg.UNSURE}', '{reg.FAILED}']) as kind, unnest([case when n_fields > 0 then suspicious end, case when n_fields > 0 then too_low end, failed or n_fields = 0]) as fires from o where known),
last as (select case_id, document, kind, arg_max(fires, version) as fires from said where fires is not null group by all),
had as (select distinct case_id, document, (['{reg.SUSPICIOUS}', '{reg.UNSURE}', '{reg.FAILED}'])[document % 3 + 1] as kind, true as open_ from v)
select * from (select coalesce(l.case_id, h.case_id) as case_id, coalesce(l.document, h.document) as document, coalesce(l.kind, h.kind) as kind,
  case when open_ is null and fires then 'opened' when open_ and coalesce(fires, true) then 'kept' when open_ then 'resolved' end as action
  from last l full join had h on l.case_id = h.case_id and l.document = h.document and l.kind = h.kind) where action is not null""")
def extraction_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document had one open issue; what the versions of the batch open, keep and resolve."""
    rows, case_id = read(spark, sf_dir, "orders"), F.floor(F.col("o_custkey") / 10)
    had = rows.select(case_id.alias("case_id"), (case_id * 4 + F.col("o_orderkey") % 4).alias("document"))
    had = had.withColumn("kind", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("document") % 3 + 1).cast("int")))
    return reg.issues(reg.said_at_registration(_registered(spark, sf_dir)), had)


@query(_SQL + """,
d as (select distinct l_orderkey as version from lineitem where l_orderkey % 7 = 0 and l_orderkey % 4 > 0 and l_partkey % 17 > 0 and l_suppkey % 70 + 30 <> l_suppkey % 20 + 80)
select version, suspicious, too_low, n_low, version in (select version from d) as checked from o where known""")
def guards_rechecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh order has become surer since its verdict; only those are checked again."""
    had = _cut(_registered(spark, sf_dir, earlier=True).select("version", "stamp", "guards"))
    now = _cut(_registered(spark, sf_dir).where("document is not null").select("version", "document", "case_id", "lines", "stamp"))
    g = F.col("guards")
    return reg.rechecked(now, had).select("version", g["suspicious"].alias("suspicious"), g["too_low"].alias("too_low"), g["n_low"].alias("n_low"), "checked")


@query(_SQL + """,
a as (select version, 'ana' as author, 1 as "at" from v where version % 3 = 0 union all select version, 'rui', 2 from v where version % 6 = 0),
p as (select *, n_fields - case when outcome = 'accepted' then n_sure else 0 end as pending, "at" = min("at") over (partition by version) as first_ from a join o using (version))
select version, author, "at", case when known and first_ then pending else 0 end as n_accepted,
  case when not known then 'unknown' when n_fields = 0 then 'empty' when first_ and pending > 0 then 'accepted' else 'nothing_new' end as outcome from p""")
def extractions_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to accept versions after registration; of two for a version the second finds nothing new."""
    k = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version"))
    asked = k.where("version % 3 = 0").withColumns({"author": F.lit("ana"), "at": F.lit(1)}).unionByName(k.where("version % 6 = 0").withColumns({"author": F.lit("rui"), "at": F.lit(2)}))
    return reg.acceptances(_registered(spark, sf_dir).where("document is not null").select("version", "lines"), asked)
