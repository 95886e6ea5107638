"""Payloads, groups of entities, schedules and blocks: negative cases, nulls, empty tables, ties."""

from pyspark.sql import functions as F

from tidemark.functions import accounts, files, text
from tidemark.operators import consolidate, schedule
from tidemark.sources import macro


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_expectations(spark):
    good = '{"value":[{"Data":"2026-02-01","DataReferencia":"2027","Mediana":4.5,"baseCalculo":1},{"Data":"2026-02-01","DataReferencia":2027,"Mediana":"4,1","numeroRespondentes":9},' \
        '{"Data":"2026-02-01","DataReferencia":"2027","Mediana":9.9,"baseCalculo":0},{"Data":"2026-02-01","DataReferencia":"2026.5","Mediana":1},{"Data":"2026-01-01","DataReferencia":"2026","Mediana":3}]}'
    df = spark.createDataFrame([(1, good, "x"), (2, None, "x"), (3, "no json", "x"), (4, '{"value":[]}', "x"), (5, "[]", "x")], "k int, p string, year string")
    assert rows(macro.expectations(df, "p").select("k", "year", "median", "mean", "respondents", "collected"), "k") == [(1, 2027, 4.1, None, 9, "2026-02-01")]
    assert macro.expectations(df.limit(0), "p").count() == 0


def test_monthly_index(spark):
    df = spark.createDataFrame([(1, '[{"D3C":"202501","V":"1"},{"D3C":"202502","V":"0,5"},{"D3C":"202513","V":"1"},{"D3C":null,"V":"1"},{"D3C":"202503","V":"..."}]'), (2, None), (3, "[]"), (4, "x")], "k int, p string")
    assert [(r.k, str(r.date_ref), r.value) for r in macro.monthly_index(df, "p").collect()] == [(1, "2025-02-01", 0.5)]


def test_covered(spark):
    wanted = spark.createDataFrame([("a", 2026), ("a", 2030), ("b", 2026), (None, 2026)], "s string, y int")
    known = spark.createDataFrame([("a", 2026, 4.0), ("a", 2026, 5.0), ("a", 2027, 3.0), ("b", 2026, None)], "s string, y int, m double")
    got = {(r.s, r.y): (r.fraction, r.reason, r.first_year, r.last_year) for r in macro.covered(wanted, known, "s", "y", "m").collect()}
    assert got == {("a", 2026): (0.04, None, 2026, 2027), ("a", 2030): (None, "not_covered", 2026, 2027), ("b", 2026): (None, "no_series", None, None), (None, 2026): (None, "no_series", None, None)}


def test_file_entity(spark):
    names = {
        "12_Mutuos_Intragrupo_Grupo_Vertentes.pdf": "Grupo Vertentes", "DRE_VT_Logistica_2025x2024.pdf": "VT Logistica", "06_BP_COMBINADO_Grupo_Vertentes.pdf": "Grupo Vertentes",
        "Balanço 12M25 assinado.pdf": None, "Balancete Padaria São João Ltda 1830.xlsx": "Padaria Sao Joao LTDA 1830", "BP_XY.pdf": None, None: None, "": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(files.file_entity(text.file_label(F.col("n")))).collect()] == list(names.values())


def test_blocks(spark):
    data = [("receita_bruta", "ICMS sobre vendas", None), ("receita_bruta", "ICMS a recuperar", []), ("custos", "x", ["MAPA_DIVIDA"]), ("custos", None, ["DRE"]), (None, None, None)]
    df = spark.createDataFrame(data, "s string, l string, d array<string>")
    assert [r[0] for r in df.select(accounts.block_of_line(F.col("s"), F.col("l"), F.col("d"))).collect()] == ["deducao", "receita", "divida", "custo", "fora"]
    labels = spark.createDataFrame([("Aplicações Financeiras",), ("Aplicações em coligadas",), ("Encaixados",)], "l string")
    assert [r[0] for r in labels.select(accounts.is_cash(F.col("l"))).collect()] == [True, False, False]


def test_consolidation(spark):
    lines = spark.createDataFrame([(1, "AC", 100), (1, "PC", 30), (1, "PNC", 30), (1, "PL", 10), (2, "AC", 5), (None, "PC", 8), (3, None, 4)], "k int, s string, v long")
    out = {r.k: (r.assets, r.liabilities, r.equity, r.plug, r.plug_kind) for r in consolidate.closed(consolidate.section_sums(lines, ["k"], "s", "v")).collect()}
    assert out == {1: (100, 60, 40, 30, "accumulated_profit"), 2: (5, 0, 5, 5, "accumulated_profit"), None: (0, 8, -8, -8, "accumulated_loss"), 3: (0, 0, 0, 0, "accumulated_profit")}
    scaled = consolidate.scaled_to_equity(lines, ["k"], "s", "v", F.lit(-20))
    assert sorted((r.k or 0, r.s or "", r.v) for r in scaled.collect()) == [(0, "PC", 20.0), (1, "AC", 100.0), (1, "PC", 60.0), (1, "PL", 10.0), (1, "PNC", 60.0), (2, "AC", 5.0), (3, "", 4.0)]
    assert consolidate.closed(consolidate.section_sums(lines.limit(0), ["k"], "s", "v")).count() == 0


def test_a_combined_statement_closes(spark):
    # the holding has 70 % of a firm with equity 100 and all of one with equity -20, a loan of 15 to the first, and 5 of its own
    data = [("h", None, 90.0, 20.0, 0.0), ("a", 0.7, 150.0, 50.0, 15.0), ("b", 1.0, 10.0, 30.0, 0.0)]
    e = spark.createDataFrame(data, "n string, share double, assets double, liabilities double, intra double").withColumn("equity", F.col("assets") - F.col("liabilities")).withColumn("g", F.lit(1))
    got = consolidate.combined(e, ["g"], F.col("n") == "h", F.col("share"), F.col("intra")).first()
    assert (got.investments, got.provisions, got.minority, got.assets, got.liabilities, got.equity, got.gap) == (70.0, 20.0, 30.0, 165.0, 65.0, 100.0, 0.0)


def test_totals_sections_and_names(spark):
    df = spark.createDataFrame([(None, "total", None, 9.0), (None, "a", "total", 4.0), (None, "b", "total", 5.0), (1, "total", None, 2.0)], "k int, l string, s string, v double")
    assert sorted((r.k or 0, r.own_sum, r.total, r.difference) for r in consolidate.informed_totals(df, ["k"], "l", "s", "v", F.when(F.col("l") == "total", F.col("v") + 1)).collect()) == [(0, 9.0, 10.0, 1.0), (1, 2.0, 3.0, 1.0)]
    lines = spark.createDataFrame([(1, "x"), (1, None), (2, "x"), (2, "y"), (2, None), (None, "z"), (None, None), (3, None)], "k int, s string")
    assert sorted((r.k or 0, r.s or "", r.inherited) for r in consolidate.inherited_sections(lines, ["k"], "s").collect()) == [
        (0, "z", False), (0, "z", True), (1, "x", False), (1, "x", True), (2, "", False), (2, "x", False), (2, "y", False), (3, "", False)
    ]
    names = spark.createDataFrame([(1, "Alfa"), (1, "Alfa"), (1, "ALFA Metais S/A"), (1, "Beta"), (1, "Beta Um"), (1, "Beta Dois"), (1, "Alf"), (1, None), (2, "Alfa")], "k int, n string")
    assert rows(consolidate.whole_names(names, "k", "n"), "k", "entity") == [
        (1, "alf", "alf"), (1, "alfa", "alfa metais"), (1, "alfa metais", "alfa metais"), (1, "beta", "beta"), (1, "beta dois", "beta dois"), (1, "beta um", "beta um"), (2, "alfa", "alfa")
    ]


def test_instalments(spark):
    df = spark.createDataFrame([(100.0, 4.0), (100.0, 2.5), (100.0, 0.5), (100.0, 0.0), (None, 2.0)], "v double, t double")
    got = {}
    for r in schedule.instalments(df, "v", F.col("t"), 4).orderBy("period").collect():
        got.setdefault((r.v, r.t), []).append(r.paid)
    for (v, term), paid in got.items():
        left = v
        for i, p in enumerate(paid):
            due = None if v is None else 0.0 if term - i <= 0 else left * min(1.0, 1 / (term - i))
            assert (p is None and due is None) or abs(p - due) < 1e-9
            left = None if v is None else left - due


def test_signs_and_methods(spark):
    df = spark.createDataFrame([(None, "custo", -5.0, True), (None, "custo", 2.0, True), (None, "custo", 1.0, False), (None, "receita", -9.0, True), (1, None, -1.0, True)], "k int, b string, v double, h boolean")
    out = schedule.signs_normalised(df, ["k"], "b", "v", ["custo"], F.col("h"))
    assert sorted((r.b or "", r.v, r.turned) for r in out.collect()) == [("", -1.0, False), ("custo", -2.0, True), ("custo", -1.0, True), ("custo", 5.0, True), ("receita", -9.0, False)]
    lines = spark.createDataFrame([(1, 1, "no such", 1.0, 1.0, 1.0), (2, 1, "curva_mensal", 1.0, 0.0, 1.0)], "k int, y int, m string, b double, d double, o double")
    assert [r.projected for r in schedule.projected(lines, ["k"], "y", "m", "b", "d", "o").collect()] == [None, None]
