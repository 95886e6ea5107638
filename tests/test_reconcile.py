"""Outcomes of the reconciliations one by one, and pairs of labels against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import duplicates, reconcile
from tidemark.operators.standard_checks import ASSETS_CLAIMS, CASH, CHECKS, EXPENSE_INTEREST, REVENUE_BILLING

LINE = "doc_id string, section string, label string, entity_col string, period_col string, value double, unit string, confidence double"
DOC = "case_id int, doc_id string, doc_type string, entity_id int, ref string, created timestamp"
DOCS = [(1, "bp", "BALANCO", 1, "12M24", 3), (1, "dfc", "FLUXO_CAIXA", 1, "2024", 1), (1, "dre", "DRE", 1, "2024", 1), (1, "fat", "FATURAMENTO_24M", None, "L24M", 1), (1, "map", "MAPA_DIVIDA", None, None, 1)]


def run(spark, check, lines, docs=DOCS, name="Alfa", ref="2024", entity=1):
    import datetime as dt

    facts = spark.createDataFrame([(d, s, label, e, p, float(v) if v is not None else None, u, c) for d, s, label, e, p, v, u, c in lines], LINE)
    documents = spark.createDataFrame([(*d[:5], dt.datetime(2025, 1, d[5])) for d in docs], DOC)
    targets = spark.createDataFrame([(1, entity, name, ref)], "case_id int, entity_id int, entity_name string, ref string")
    return reconcile.reconciled(facts, documents, targets, [check]).first()


def line(doc, label, value, section=None, entity=None, period=None, unit=None, confidence=1.0):
    return doc, section, label, entity, period, value, unit, confidence


def verdict(r):
    return r.verdict, r.worst_gap


def test_assets_and_claims_cascade(spark):
    total = [line("bp", "Total do Ativo", 1000), line("bp", "Total do Ativo Circulante", 5), line("bp", "Passivo e Patrimônio Líquido", 1000)]
    assert verdict(run(spark, ASSETS_CLAIMS, total)) == ("ok", None)
    assert verdict(run(spark, ASSETS_CLAIMS, [line("bp", "ATIVO", 1200), *total[1:]])) == ("divergent", 200)
    two = [line("bp", "ATIVO", 1000), line("bp", "Total do Passivo", 600), line("bp", "Patrimônio Líquido", 400)]
    assert verdict(run(spark, ASSETS_CLAIMS, two)) == ("ok", None)
    assert run(spark, ASSETS_CLAIMS, two[:2]).verdict == "unmet"
    # sums of sections leave out what prints their totals
    sums = [line("bp", "Caixa", 900, "Ativo Circulante"), line("bp", "Fornecedores", 300, "Passivo Circulante"), line("bp", "Capital", 600, "Patrimônio Líquido")]
    printed = [line("bp", "Passivo e Patrimônio Líquido - conferência", 900, "Passivo"), line("bp", "Subtotal", 300, "Passivo Circulante"), line("bp", "Passivo circulante", 300, "Passivo Circulante")]
    r = run(spark, ASSETS_CLAIMS, sums + printed)
    assert r.verdict == "ok" and r.years[0].origin_b == "sum of liabilities + sum of equity"


def test_the_entity_column_counts(spark):
    lines = [line("bp", "ATIVO", v, entity=e) for v, e in ((10_000, "Combinado"), (2_000, "Alfa Ltda"), (8_000, "Beta"))] + [line("bp", "Passivo e Patrimônio Líquido", v, entity=e) for v, e in ((9_000, "Combinado"), (2_000, "Alfa Ltda"), (7_000, "Beta"))]
    assert run(spark, ASSETS_CLAIMS, lines, name="Alfa").verdict == "ok"
    assert verdict(run(spark, ASSETS_CLAIMS, lines, name="Beta Participações")) == ("divergent", 1000)
    # the document's owner without a column of its own has the totals, anyone else nothing
    assert verdict(run(spark, ASSETS_CLAIMS, lines, name="Gama")) == ("divergent", 1000)
    assert run(spark, ASSETS_CLAIMS, [x for x in lines if x[3] != "Combinado"], name="Gama").verdict == "unmet"
    assert run(spark, ASSETS_CLAIMS, lines, name=None, entity=None).verdict == "unmet"


def test_the_year_picks_the_period_column(spark):
    lines = [line("bp", "ATIVO", v, period=p) for v, p in ((100_000, "2023"), (5_000, "31/12/2024"))] + [line("bp", "Passivo e Patrimônio Líquido", v, period=p) for v, p in ((90_000, "2023"), (5_000, "31/12/2024"))]
    assert run(spark, ASSETS_CLAIMS, lines).verdict == "ok"
    r = run(spark, ASSETS_CLAIMS, lines, ref="23,24")
    assert (r.verdict, r.checked, r.unchecked, r.worst_gap) == ("divergent", 2, 0, 10_000)
    assert run(spark, ASSETS_CLAIMS, lines, ref="22,24").unchecked == 1


def test_documents_by_priority_then_newest(spark):
    docs = [(1, "old", "BALANCO", 1, "2024", 1), (1, "new", "BALANCO", 1, "2024", 9), (1, "comb", "COMBINADO", 1, "2024", 20), (1, "other", "BALANCO", 2, "2024", 25), (1, "year", "BALANCO", 1, "2021", 28)]
    lines = [line(d, label, v) for d, v in (("old", 1), ("new", 2), ("comb", 3), ("other", 4), ("year", 5)) for label in ("ATIVO", "Passivo e Patrimônio Líquido")]
    assert run(spark, ASSETS_CLAIMS, lines, docs).years[0].value_a == 2
    assert run(spark, ASSETS_CLAIMS, lines, docs[2:]).years[0].value_a == 3
    assert run(spark, ASSETS_CLAIMS, lines, docs[3:]).verdict == "missing"


@pytest.mark.parametrize("label, section", [("Caixa e equivalentes", None), ("Disponibilidades", None), ("Numerário disponível", None), ("Caixa e bancos", None), ("Caixa", None), ("Bancos conta movimento", "Disponível"), ("Fundo fixo", "Caixa")])
def test_every_step_of_the_cash_cascade(spark, label, section):
    lines = [line("bp", label, 2, section, unit="R$ mil"), line("dfc", "Saldo final do período", 2000, unit="R$", entity="any")]
    assert run(spark, CASH, lines).verdict == "ok"
    assert run(spark, CASH, [lines[0], line("dfc", "Saldo final do período", 999_000, unit="R$")]).verdict == "divergent"
    assert run(spark, CASH, [lines[0], line("dfc", "Saldo final do período", 2000, unit="caixas")]).verdict == "unmet"


def test_interest_is_summed_over_contracts(spark):
    debt = [line("map", "Juros do contrato A", 600_000), line("map", "Encargos contrato B", 400_000), line("map", "Total de juros", 1_000_000), line("map", "Juros total geral", 1_000_000), line("map", "Principal", 9)]
    expense = line("dre", "Despesa financeira", -1_000_000)
    assert run(spark, EXPENSE_INTEREST, [expense, *debt]).verdict == "ok"
    assert verdict(run(spark, EXPENSE_INTEREST, [expense, *debt[1:]])) == ("grey", 600_000)
    assert run(spark, EXPENSE_INTEREST, [line("dre", "Receita e despesa financeira", -1_000_000), *debt]).verdict == "unmet"
    assert run(spark, EXPENSE_INTEREST, [line("dre", "Juros e encargos", -1_000_000), *debt]).verdict == "ok"
    assert run(spark, EXPENSE_INTEREST, [line("dre", "Juros e encargos pagos", -1_000_000), *debt]).verdict == "unmet"


def test_revenue_against_the_months_of_its_year(spark):
    months = [line("fat", f"{m}/24", 100_000) for m in ("Jan", "Fev", "Mar")] + [line("fat", "Abr/2024", 100_000), line("fat", "Jan/23", 7), line("fat", "Total 2024", 400_000), line("fat", "Média 2024", 1)]
    assert run(spark, REVENUE_BILLING, [line("dre", "Receita Bruta", 400_000), *months]).verdict == "ok"
    assert verdict(run(spark, REVENUE_BILLING, [line("dre", "Receita Bruta", 900_000), *months])) == ("grey", 500_000)
    sums = [line("dre", "Vendas", 300_000, "Receita Operacional Bruta"), line("dre", "Serviços", 100_000, "Receita Operacional Bruta"), line("dre", "Receita líquida", 5, "Receita Operacional Bruta")]
    assert run(spark, REVENUE_BILLING, sums + months).verdict == "ok"
    assert run(spark, REVENUE_BILLING, [line("dre", "Receita Bruta", 400_000), *months], ref="L24M").verdict == "unmet"
    assert run(spark, REVENUE_BILLING, months, docs=[d for d in DOCS if d[1] != "dre"]).verdict == "missing"


def test_lines_are_scanned_once_for_all_checks(spark, tmp_path):
    spark.createDataFrame([line("bp", "ATIVO", 1.0)], LINE).write.parquet(f"{tmp_path}/l")
    facts = spark.read.parquet(f"{tmp_path}/l")
    documents = spark.createDataFrame([], DOC)
    out = reconcile.reconciled(facts, documents, documents.select("case_id", "entity_id", F.lit("x").alias("entity_name"), "ref"), CHECKS)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 1 and out.collect() == []


def test_first_met_period(spark):
    tried = spark.createDataFrame([(1, "d", "t", None, "c", r, (later, r)) for r, later in (("24", False), ("21", True), ("22", True))], "case_id int, doc_id string, doc_type string, entity_id int, check string, ref string, place struct<later: boolean, name: string>")
    results = lambda **v: spark.createDataFrame([(1, None, r, "c", x) for r, x in v.items()], "case_id int, entity_id int, ref string, check string, verdict string")
    named = lambda v: results(**{}) if not v else spark.createDataFrame([(1, None, r, "c", x) for r, x in v.items()], "case_id int, entity_id int, ref string, check string, verdict string")
    got = lambda v: tuple(reconcile.first_met(tried, named(v)).select("ref", "verdict").first())
    assert got({"24": "ok", "21": "divergent", "22": "ok"}) == ("24", "ok")
    assert got({"24": "unmet", "21": "missing", "22": "ok"}) == ("21", "missing")
    assert got({"24": "unmet", "21": "unmet", "22": "unmet"}) == ("22", "unmet")


# --- pairs of labels --------------------------------------------------------------------

PAIR = "scope int, section string, label string, ec string, pc int, v long, sub string"


def brute(rows):
    def norm(s):
        return re.sub(r"\s+", " ", (s or "").lower().translate(str.maketrans(text.FOLD_FROM, text.FOLD_TO))).strip()

    def tokens(s):
        return {w for w in re.split("[^a-z0-9]+", norm(s)) if w and w not in text.STOPWORDS}

    cells = {}
    for scope, section, label, ec, pc, v, sub in rows:
        if v and section and section != duplicates.UNCLASSIFIED and ec is not None and pc is not None:
            c = cells.setdefault((scope, section, norm(label)), {}).setdefault((ec, pc), (set(), set(), set()))
            c[0].add(v), c[1].add(label), c[2].add(norm(sub))
    cells = {k: {c: (min(x[0]), min(x[1]), x[2]) for c, x in v.items() if len(x[0]) == 1} for k, v in cells.items()}
    out = []
    for (s1, k1, a), x in cells.items():
        for (s2, k2, b), y in cells.items():
            both = x.keys() & y.keys()
            if (s1, k1) != (s2, k2) or a >= b or not both or any(x[c][0] != y[c][0] for c in both):
                continue
            if any(a in y[c][2] or b in x[c][2] for c in both) or not any(x[c][2] & y[c][2] for c in both):
                continue
            shown = min(x[c][1] for c in both), min(y[c][1] for c in both)
            t, u = map(tokens, shown)
            radical = t <= u or u <= t
            if len(both) >= 2 or radical and any(x[c][2] | y[c][2] != {""} for c in both):
                out.append((s1, k1, *shown, len(both), max(abs(x[c][0]) for c in both), radical))
    return sorted(out)


def test_pairs_against_brute_force(spark):
    rng = random.Random(2)
    names = ["Capital social", "Capital Social subscrito", "capital  social", "Prejuízos", "Resultados", "Reservas", "Mútuos", "Partes relacionadas", "Partes relacionadas a pagar"]
    rows = []
    for scope in range(80):
        for name in names:
            for ec in ("A", "B"):
                for pc in (1, 2, 3):
                    if rng.random() < 0.5:
                        rows.append((scope, rng.choice(["x", "x", "y"]) if scope % 2 else "x", name, ec, pc, pc * rng.choice([5, 5, 5, -5, 0]), rng.choice(["Grupo", "Grupo", None, "Partes relacionadas"]) if scope % 3 else "Grupo"))
    rows += [(99, None, "a", "A", 1, 5, "g"), (99, duplicates.UNCLASSIFIED, "b", "A", 1, 5, "g"), (99, "x", None, "A", 1, 5, "g"), (99, "x", "c", None, 1, 5, "g"), (99, "x", "d", "A", 1, None, "g")]
    want = brute(rows)
    found = duplicates.pairs(spark.createDataFrame(rows, PAIR).repartition(3), ["scope"], "section", "label", ["ec", "pc"], "v", "sub")
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    assert {r[6] for r in want} == {True, False} and {r[4] for r in want} >= {1, 2, 3}
    verdicts = duplicates.reconciled(found, spark.createDataFrame(rows, PAIR), ["scope"]).collect()
    assert {r.scope: r.n_pairs for r in verdicts} == {s: sum(w[0] == s for w in want) for s in {r[0] for r in rows}}
    assert duplicates.pairs(spark.createDataFrame([], PAIR), ["scope"], "section", "label", ["ec", "pc"], "v", "sub").count() == 0


def test_a_line_is_in_one_cell_whatever_the_number_of_checks(spark):
    lines = [line("bp", "Caixa e equivalentes de caixa", 5, "Ativo"), line("bp", "Total do Ativo", 7, "Ativo"), line("bp", "Total do Passivo e Patrimônio Líquido", 7, "Passivo"), line("bp", "Jan/24 juros", 9, "Disponível"), line("bp", "nada", 1)]
    facts = spark.createDataFrame([(d, s, x, e, p, float(v), u, c) for d, s, x, e, p, v, u, c in lines], LINE)
    cells = reconcile.aggregated(facts, CHECKS).first().cells
    assert sum(c.n for c in cells) == 4 == len(cells)


def test_more_strategies_than_bits_of_a_long(spark, monkeypatch):
    lines = [line("bp", "ATIVO", 1000), line("bp", "Total do Passivo", 600), line("bp", "Patrimônio Líquido", 200), line("bp", "Caixa e bancos", 2, unit="R$ mil"), line("dfc", "Saldo final do período", 2000, unit="R$"), line("dre", "Receita bruta", 900_000), line("fat", "Jan/24", 1), line("dre", "Despesa financeira", -9), line("map", "Juros", 9)]
    facts = spark.createDataFrame([(d, s, x, e, p, float(v), u, c) for d, s, x, e, p, v, u, c in lines], LINE)
    import datetime as dt

    documents = spark.createDataFrame([(*d[:5], dt.datetime(2025, 1, d[5])) for d in DOCS], DOC)
    targets = spark.createDataFrame([(1, 1, "Alfa", "2024")], "case_id int, entity_id int, entity_name string, ref string")
    monkeypatch.setattr(reconcile, "WORD", 5)
    got = {r.check: (r.verdict, r.worst_gap) for r in reconcile.reconciled(facts, documents, targets, CHECKS).collect()}
    assert got == {"assets_claims": ("divergent", 200), "cash": ("ok", None), "revenue_billing": ("grey", 899_999), "expense_interest": ("ok", None)}


def test_structural_labels_as_words(spark):
    labels = ["ATIVO", "Total do Ativo", "a", "Ativo a", "inativo", "ativo ativo", "Ativo circulante", "Átivo", "  ativo. ", "", None, "passivo / patrimônio líquido", "patrimonio-passivo", "passivopatrimonio", "total do ativo", "Ativo " * 5000]
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    for tokens in (("ativo",), ("passivo", "patrimonio"), ("a",), ("tivo",), ()):
        wanted = F.array(*map(F.lit, sorted(tokens))) if tokens else F.array().cast("array<string>")
        assert rows.where(text.is_structural(F.col("label"), tokens) != (text.structural_tokens(F.col("label")) == wanted)).count() == 0
