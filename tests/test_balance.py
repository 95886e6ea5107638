"""Every phrase of the balance sheet's vocabulary, by itself and beside others."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import accounts, balance

NON_CURRENT = "realizavel_lp", "investimentos", "imobilizado", "intangivel", "ativo_nao_circulante"


def found(spark, pairs):
    df = spark.createDataFrame(pairs, "s string, l string")
    return [tuple(r.c) for r in df.select(balance.classify(F.col("s"), F.col("l")).alias("c")).collect()]


@pytest.mark.parametrize("phrases, keys", [(balance.EQUITY, ("patrimonio_liquido",)), (balance.CURRENT_ASSETS, ("ativo_circulante",)), (balance.NON_CURRENT_ASSETS, NON_CURRENT), (balance.CURRENT_CLAIMS, ("passivo_circulante",)), (balance.NON_CURRENT_CLAIMS, ("passivo_nao_circulante",)), (balance.LOANS, ("passivo_circulante",))])
def test_every_phrase_has_a_section(spark, phrases, keys):
    for phrase, (section, anchor) in zip(phrases, found(spark, [(None, f"{p} conta 7") for p in phrases]), strict=True):
        # what an earlier list holds wins: an advance of clients names clients, deferred revenue is owed
        assert anchor is None and section in {*keys, "passivo_circulante", "ativo_circulante"} and section, phrase
    bare = found(spark, [(None, p) for p in phrases])
    assert all(section or anchor for section, anchor in bare)


def test_words_that_were_missing(spark):
    labels = {
        "INSS": "passivo_circulante", "Produtos em andamento": "ativo_circulante", "PECLD": "ativo_circulante", "PDD": "ativo_circulante", "Perdas estimadas em créditos": "ativo_circulante", "ICMS a recuperar": "ativo_circulante",
        "PIS a recuperar": "ativo_circulante", "COFINS a recuperar": "ativo_circulante", "IRPJ a recuperar": "ativo_circulante", "CSLL a recuperar": "ativo_circulante", "IR a recuperar": "ativo_circulante", "ICMS a compensar": "ativo_circulante",
        "Despesas pagas antecipadamente": "ativo_circulante", "Adiantamentos diversos": "ativo_circulante", "Cheques a compensar": "ativo_circulante", "Créditos com partes relacionadas": "realizavel_lp", "Adiantamento para futuro aumento de capital": "realizavel_lp",
    }
    assert [s for s, _ in found(spark, [(None, x) for x in labels])] == list(labels.values())


def test_totals_sections_and_words(spark):
    lines = [
        ((None, "TOTAL DO ATIVO"), (None, "ATIVO")), (("Passivo", "Circulante"), (None, "passivo_circulante")), (("Ativo", "Não circulante"), (None, "ativo_nao_circulante_grp")), ((None, "Circulante"), (None, "ativo_circulante")),
        ((None, "Total do passivo e patrimônio líquido"), (None, "PASSIVO_PL")), (("PASSIVO", "Patrimônio líquido"), (None, "patrimonio_liquido")), (("Passivo", "Exigível total"), (None, "PASSIVO_PL")), (("Patrimônio", "Soma"), (None, "patrimonio_liquido")),
        ((None, "Imobilizado"), (None, "imobilizado")), (("Realizável a longo prazo", "Títulos a receber - venda de imobilizado"), ("realizavel_lp", None)), (("Ativo não circulante", "Terrenos"), ("imobilizado", None)),
        (("Passivo e Patrimônio Líquido", "Fornecedores nacionais"), ("passivo_circulante", None)), (("Ativo e Passivo circulante", "Contas"), ("ativo_circulante", None)), ((None, "Receita de vendas de mercadorias"), (None, None)),
        ((None, "Empréstimos concedidos a longo prazo"), ("realizavel_lp", None)), ((None, "Mútuos a receber"), ("ativo_circulante", None)), ((None, "Financiamentos de longo prazo"), ("passivo_nao_circulante", None)), ((None, "Adiantamentos de clientes"), ("passivo_circulante", None)),
        ((None, "ICMS a recolher"), ("passivo_circulante", None)), ((None, None), (None, None)), (("", ""), (None, None)), ((None, "Outras contas"), (None, None)),
    ]
    assert found(spark, [k for k, _ in lines]) == [v for _, v in lines]


def test_accounts_by_real_words(spark):
    labels = ["Descontos concedidos", "Devoluções de vendas", "Vendas canceladas", "Impostos sobre vendas", "PIS e COFINS sobre faturamento", "Receita de vendas", None]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(accounts.names_any(F.col("l"), accounts.DEDUCTION)).collect()] == [True] * 5 + [False] * 2
    fixed = ["Edificações", "Móveis e utensílios", "Marcas e patentes", "Instalações industriais", "Ferramental", "Empilhadeiras", "Softwares", "Clientes", "Marca", None]
    df = spark.createDataFrame([(x,) for x in fixed], "l string")
    assert [r[0] for r in df.select(accounts.is_fixed_asset(F.col("l"))).collect()] == [True] * 7 + [False] * 3
    cash = ["Bancos conta movimento", "Aplicações financeiras", "Equivalentes de caixa", "Títulos e valores mobiliários", "Numerários", "Estoques", None]
    df = spark.createDataFrame([(x,) for x in cash], "l string")
    assert [r[0] for r in df.select(accounts.is_cash(F.col("l"))).collect()] == [True] * 5 + [False] * 2
