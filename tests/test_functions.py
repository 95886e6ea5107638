"""Labels, periods and units on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import period, roles, statements, text, units


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "label,doc_type,role",
    [
        ("Índice de liquidez", None, "derivado"),
        ("Margem bruta", None, "derivado"),
        ("Janeiro", "FATURAMENTO_24M", "serie_mensal"),
        ("Janeiro", "DRE", "conta"),
        ("Total do Ativo", None, "subtotal"),
        ("ATIVO NÃO CIRCULANTE", None, "subtotal"),
        ("Lucro líquido", None, "subtotal"),
        ("Caixa líquido gerado nas operações", None, "subtotal"),
        ("Fornecedores", None, "conta"),
        (None, None, "conta"),
    ],
)
def test_roles(spark, label, doc_type, role):
    assert values(spark, [(label, doc_type)], "l string, d string", roles.line_role(F.col("l"), F.col("d"))) == [(role,)]


@pytest.mark.parametrize(
    "ref,canonical,years",
    [
        ("31/12/2024", "2024-12-31", [2024]),
        ("31/12/79", "2079-12-31", [2079]),
        ("12M25", "2025", [2025]),
        ("3M25", "3m2025", [2025]),
        ("1T25", "1t2025", [2025]),
        ("L24M", "l24m", []),
        ("25, 23,24", "2023,2024,2025", [2023, 2024, 2025]),
        ("95", "1995", [1995]),
        ("", None, []),
        (None, None, []),
        ("livre", "livre", []),
    ],
)
def test_periods(spark, ref, canonical, years):
    assert values(spark, [(ref,)], "r string", period.canonical(F.col("r")), period.years(F.col("r"))) == [(canonical, years)]


@pytest.mark.parametrize("a,b,fits,same", [("24,25", "12M25", True, False), ("2024", "2025", False, False), ("L24M", "2025", True, True), (None, "2025", True, True), ("12M25", "2025", True, True)])
def test_period_pairs(spark, a, b, fits, same):
    assert values(spark, [(a, b)], "a string, b string", period.compatible(F.col("a"), F.col("b")), period.equivalent(F.col("a"), F.col("b"))) == [(fits, same)]


@pytest.mark.parametrize("t,found", [("dez/25", [2025]), ("2024 e 2023", [2023, 2024]), ("sem", []), (None, [])])
def test_years_of_text(spark, t, found):
    assert values(spark, [(t,)], "t string", period.years_of_text(F.col("t"))) == [(found,)]


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Metalúrgica", "VERTENTES METALÚRGICA LTDA.", True),
        ("Vert. Part.", "Vertentes Participações", True),
        ("Componentes", "Participações", False),
        ("Participações Vertentes", "Vertentes Participações S.A.", False),
        ("ab", "abcd efgh", False),
        (None, "x", False),
    ],
)
def test_entities(spark, a, b, same):
    assert values(spark, [(a, b)], "a string, b string", text.same_entity(F.col("a"), F.col("b"))) == [(same,)]


def test_containment(spark):
    rows = [("Empréstimos", "Empréstimos e financiamentos", True), ("de", "tudo de bom", False), ("Caixa", "Bancos", False)]
    got = values(spark, rows, "a string, b string, w boolean", text.contained(F.col("a"), F.col("b")), "w")
    assert all(x == w for x, w in got)


@pytest.mark.parametrize("unit,factor", [("R$ mil", 1000), ("MILHÕES", 1000000), ("unidade", 1), ("caixas", None), ("", None), (None, None)])
def test_scales(spark, unit, factor):
    assert values(spark, [(unit,)], "u string", units.scale_factor(F.col("u"))) == [(factor,)]


def test_numbers_and_months(spark):
    assert values(spark, [("1.234,56",), ("0.67",), ("x",), (None,)], "t string", text.locale_number(F.col("t"))) == [(1234.56,), (0.67,), (None,), (None,)]
    assert values(spark, [("Faturamento dez e março",), ("nada",)], "t string", period.month_of_label(F.col("t"))) == [(3,), (None,)]
    assert values(spark, [("Out/2024", "Jan/2025")], "a string, b string", period.chronological_key(F.col("a")) < period.chronological_key(F.col("b"))) == [(True,)]


@pytest.mark.parametrize(
    "section,label,kind,found",
    [
        (None, "Receita Operacional Líquida", "INCOME", (None, "receita_liquida")),
        (None, "Receitas de vendas de mercadorias", "INCOME", ("receita_bruta", None)),
        ("Despesas Operacionais", "Aluguéis", "INCOME", ("despesas_operacionais", None)),
        ("Custo dos produtos vendidos", "Despesas gerais", "INCOME", ("custos", None)),
        (None, "- Lucro líquido", "INCOME", (None, None)),
        (None, "Resultado antes do resultado financeiro", "INCOME", (None, None)),
        (None, "Provisão para IRPJ", "INCOME", ("impostos_lucro", None)),
        (None, "Caixa líquido gerado pelas atividades operacionais", "CASH_FLOW", (None, "caixa_operacional")),
        (None, "Saldo final de caixa", "CASH_FLOW", (None, "saldo_final_caixa")),
        ("Atividades de financiamento", "Juros", "CASH_FLOW", ("atividades_financiamento", None)),
        (None, "Pagamentos a fornecedores", "CASH_FLOW", ("atividades_operacionais", None)),
        (None, None, "CASH_FLOW", (None, None)),
    ],
)
def test_statements(spark, section, label, kind, found):
    got = spark.createDataFrame([(section, label)], "s string, l string").select(statements.classify(F.col("s"), F.col("l"), getattr(statements, kind)).alias("c")).first()["c"]
    assert tuple(got) == found


def test_statement_families(spark):
    rows = [("Saldo em 31/12/2024", "dmpl"), ("Saldo final de caixa em 31/12/2024", "fluxo_caixa"), ("Lucro bruto", "dre"), ("qualquer", None)]
    assert all(x == w for x, w in values(spark, rows, "l string, w string", statements.family(F.lit(None).cast("string"), F.col("l")), "w"))
    assert values(spark, [("Notas explicativas",), ("Nota 12",), ("Balanço",)], "s string", statements.is_note(F.col("s"))) == [(True,), (True,), (False,)]


def test_declared_sections_of_one_length(spark):
    rows = [("Deduções da receita e despesas comerciais", "Linha"), ("Despesas comerciais", "Linha")]
    got = spark.createDataFrame(rows, "s string, l string").select(statements.classify(F.col("s"), F.col("l"), statements.INCOME)["section"].alias("c")).collect()
    assert [r["c"] for r in got] == ["receita_bruta", "despesas_operacionais"]
