"""The role of a statement line: account, subtotal, monthly series or derived figure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .period import month_of_label
from .text import normalize, structural_tokens

# Labels and token sets by role.
DERIVED = (
    "^(indice|indices) ", "^media (mensal|diaria|anual)", "^ticket medio", "^prazo medio", "^(margem|rentabilidade|retorno) ",
    "^capital circulante liquido", "^(giro|rotacao) (de|do|da) ", "indicador gerencial",
)
SUBTOTAL_WORDS = "^(total|totais|subtotal|soma) |^(total|totais|subtotal)$"
SUBTOTAL_TOKENS = (
    ("ativo",), ("passivo",), ("patrimonio",), ("passivo", "patrimonio"), ("ativo", "circulante"), ("ativo", "circulante", "nao"),
    ("circulante", "passivo"), ("circulante", "nao", "passivo"), ("longo", "prazo", "realizavel"),
)
SUBTOTAL_LABELS = (
    "receita operacional liquida", "receita liquida", "receita liquida de vendas", "lucro bruto", "prejuizo bruto",
    "resultado operacional antes do resultado financeiro", "resultado antes dos tributos sobre o lucro",
    "resultado antes dos tributos", "lucro liquido do exercicio", "prejuizo liquido do exercicio", "lucro liquido",
    "prejuizo liquido", "resultado do exercicio", "resultado financeiro liquido", "resultado financeiro",
)
SUBTOTAL_FLOWS = "^caixa liquido (gerado|aplicado|gerado pelas)|^(aumento|reducao|variacao) liquida? (de|do|da) caixa"
BILLING = "FATURAMENTO_24M"
PRIORITY = {"subtotal": 0, "serie_mensal": 1, "derivado": 2, "conta": 3}


def line_role(label: Column, doc_type: Column | None = None) -> Column:
    """derivado, serie_mensal, subtotal or conta, by the first rule that holds."""
    t = normalize(label)
    sets = F.array(*(F.lit("|".join(x)) for x in SUBTOTAL_TOKENS))
    total = t.rlike(SUBTOTAL_WORDS) | F.array_contains(sets, F.array_join(structural_tokens(label), "|")) | t.isin(*SUBTOTAL_LABELS) | t.rlike(SUBTOTAL_FLOWS)
    monthly = (doc_type == BILLING) & month_of_label(label).isNotNull() if doc_type is not None else F.lit(False)
    return F.when(t.rlike("|".join(DERIVED)), "derivado").when(monthly, "serie_mensal").when(total, "subtotal").otherwise("conta")


def role_priority(role: Column) -> Column:
    out = F.lit(3)
    for name, k in PRIORITY.items():
        out = F.when(role == name, F.lit(k)).otherwise(out)
    return out
