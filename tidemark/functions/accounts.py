"""Which block of a model an account belongs to, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .statements import has_any, tokens

# Blocks by canonical section, and the words that tell accounts apart, in the singular.
BLOCKS = {
    "receita_bruta": "receita",
    "custos": "custo",
    "despesas_operacionais": "sga",
    "resultado_financeiro": "resultado_financeiro",
    "impostos_lucro": "tributos",
    "ativo_circulante": "ativo_circulante",
    "ativo_nao_circulante": "ativo_nao_circulante",
    "passivo_circulante": "passivo_circulante",
    "passivo_nao_circulante": "passivo_nao_circulante",
    "patrimonio_liquido": "patrimonio_liquido",
}
DEDUCTION = (
    "devolucao", "abatimento", "desconto concedido", "icms sobre", "ipi sobre", "pis e cofins sobre", "iss sobre", "imposto sobre venda", "deducao", "tributo sobre venda", "cancelado", "cancelada", "cancelamento",
)
FIXED_ASSET = (
    "imobilizado", "edificacao", "terreno", "veiculo", "maquina", "maquinario", "equipamento", "instalacao", "movel", "moveis", "utensilio", "ferramenta", "ferramental", "ferramentaria",
    "frota", "empilhadeira", "intangivel", "software", "softwares", "marca e patente",
)
CASH = (
    "caixa", "disponibilidade", "disponivel", "banco", "conta movimento", "equivalente de caixa", "aplicacao financeira", "aplicacao de liquidez", "titulo e valor mobiliario", "numerario",
)
DEBT_MAP = "MAPA_DIVIDA"


def names_any(label: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a label holds all words of one of the phrases, in the singular, accents and case aside."""
    return F.transform(F.array(tokens(F.coalesce(label, F.lit("")))), lambda t: has_any(t, phrases))[0]


def is_fixed_asset(label: Column) -> Column:
    return names_any(label, FIXED_ASSET)


def is_cash(label: Column) -> Column:
    return names_any(label, CASH)


def block_of_line(section: Column, label: Column, documents: Column) -> Column:
    """The block of a line: the debt map first, then by section; deductions are told from revenue by label."""
    out = F.when(F.coalesce(F.array_contains(documents, DEBT_MAP), F.lit(False)), "divida")
    out = out.when((section == "receita_bruta") & names_any(label, DEDUCTION), "deducao")
    for name, block in BLOCKS.items():
        out = out.when(section == name, block)
    return out.otherwise("fora")
