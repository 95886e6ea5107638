"""Statement lines as Columns: which total or section of a statement a label belongs to.

A statement is data: totals by caption, sections by what the document declares, sections by
phrases of section and label. `classify` turns it into one expression.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize, words

# Connectives, the wording around captions, and the two statements below.
CONNECTIVES = ("de", "da", "do", "das", "dos", "e", "a", "o", "as", "os", "para", "com", "em", "na", "no", "nas", "nos", "um", "uma")
CAPTION_WORDS = (
    "gerado", "gerada", "aplicado", "aplicada", "consumido", "consumida", "utilizado", "utilizada", "proveniente", "obtido", "obtida",
    "oriundo", "oriunda", "decorrente", "atividade", "operacao", "pela", "pelo", "na", "no", "exercicio", "periodo", "ano", "total", "geral", "valor",
)
# Beginnings of labels that are details, not totals.
DETAIL = r"(?i)^\s*[(\[]?\s*[-+]|^\s*outr[ao]s?\b|^\s*variac|^\s*\(-\)"
#: Endings of plurals: the ending, what is cut off, what is put on, and the least length of the word.
PLURALS = (("oes", 3, "ao", 4), ("aes", 3, "ao", 4), ("ais", 3, "al", 4), ("eis", 3, "el", 4), ("ois", 3, "ol", 4), ("res", 2, "", 6), ("s", 1, "", 4))


@dataclass(frozen=True)
class Statement:
    """anchors: (key, captions, extra words allowed); declared: (phrase, section); phrases: (section, phrases)."""

    anchors: tuple[tuple[str, tuple[str, ...], int], ...]
    declared: tuple[tuple[str, str], ...]
    phrases: tuple[tuple[str, tuple[str, ...]], ...]
    redundant: tuple[tuple[str, ...], ...] = field(default=())


INCOME = Statement(
    anchors=(
        ("receita_liquida", ("receita liquida",), 2),
        ("lucro_bruto", ("lucro bruto", "resultado bruto"), 2),
        ("resultado_operacional", ("resultado operacional", "ebit", "lucro operacional"), 4),
        ("resultado_antes_tributos", ("resultado antes dos tributos", "lucro antes dos impostos", "lair"), 3),
        ("lucro_liquido", ("lucro liquido", "prejuizo liquido", "resultado liquido do exercicio"), 2),
    ),
    declared=(
        ("receita operacional bruta", "receita_bruta"), ("receita bruta", "receita_bruta"), ("deducoes da receita", "receita_bruta"), ("deducao da receita", "receita_bruta"),
        ("custo dos produtos vendidos", "custos"), ("custo das mercadorias vendidas", "custos"), ("custo dos servicos prestados", "custos"), ("custo dos produtos", "custos"), ("custos operacionais", "custos"),
        ("despesas operacionais", "despesas_operacionais"), ("despesas administrativas", "despesas_operacionais"), ("despesas comerciais", "despesas_operacionais"), ("despesas com vendas", "despesas_operacionais"),
        ("resultado financeiro", "resultado_financeiro"), ("despesas financeiras", "resultado_financeiro"), ("receitas financeiras", "resultado_financeiro"),
        ("tributos sobre o lucro", "impostos_lucro"), ("impostos sobre o lucro", "impostos_lucro"), ("provisao para imposto de renda", "impostos_lucro"),
    ),
    phrases=(
        ("receita_bruta", ("receita bruta", "receita operacional bruta", "receita de venda", "receita com venda", "receita de servico", "receita de mercadoria", "venda de mercadoria", "venda de produto", "receita de produto", "deducao da receita", "deducao", "imposto sobre venda", "tributo sobre venda", "imposto sobre servico", "iss sobre servico")),
        ("custos", ("custo dos produtos", "custo das mercadorias", "custo dos servicos", "custo do servico prestado", "custo de venda", "custo operacional", "cpv", "cmv", "custo da venda")),
        ("despesas_operacionais", ("despesas com venda", "despesas comerciais", "despesas administrativas", "despesas gerais", "despesa com pessoal", "despesa tributaria", "despesa geral e administrativa", "outras despesas operacionais", "outras receitas operacionais", "outras despesas", "outras receitas", "depreciacao", "amortizacao", "provisao para devedores duvidosos", "perda estimada", "perda com credito")),
        ("resultado_financeiro", ("resultado financeiro", "despesas financeiras", "receitas financeiras", "juros")),
        ("impostos_lucro", ("imposto de renda", "contribuicao social", "irpj", "csll")),
    ),
    redundant=(("resultado financeiro", "antes"), ("resultado financeiro", "resultado liquido"), ("resultado antes", "financeiro")),
)

CASH_FLOW = Statement(
    anchors=(
        ("saldo_final_caixa", ("saldo final caixa", "caixa saldo final", "caixa final periodo", "caixa final exercicio", "equivalente caixa final"), 3),
        ("saldo_inicial_caixa", ("saldo inicial caixa", "caixa saldo inicial", "caixa inicio periodo", "caixa inicio exercicio", "equivalente caixa inicio"), 3),
        ("variacao_liquida_caixa", ("aumento caixa", "reducao caixa", "variacao liquida caixa", "diminuicao caixa", "acrescimo caixa", "decrescimo caixa", "acrescimo equivalente caixa", "decrescimo equivalente caixa"), 3),
        ("caixa_operacional", ("caixa liquido atividades operacional", "caixa gerado atividades operacional", "total atividades operacional"), 3),
        ("caixa_investimento", ("caixa liquido investimento", "total atividades investimento"), 3),
        ("caixa_financiamento", ("caixa liquido financiamento", "total atividades financiamento"), 3),
    ),
    declared=(
        ("atividades operacionais", "atividades_operacionais"), ("fluxo de caixa das atividades operacionais", "atividades_operacionais"),
        ("atividades de investimento", "atividades_investimento"), ("fluxo de caixa das atividades de investimento", "atividades_investimento"),
        ("atividades de financiamento", "atividades_financiamento"), ("fluxo de caixa das atividades de financiamento", "atividades_financiamento"),
    ),
    phrases=(
        ("atividades_investimento", ("atividades investimento", "aquisicao imobilizado", "aquisicao intangivel", "venda ativo", "alienacao ativo")),
        ("atividades_financiamento", ("atividades financiamento", "captacao emprestimo", "pagamento emprestimo", "aporte capital", "distribuicao dividendo", "dividendo pago")),
        ("atividades_operacionais", ("atividades operacional", "lucro liquido exercicio", "depreciacao", "amortizacao", "variacao contas receber", "variacao estoque", "variacao fornecedor", "capital giro", "recebimento de cliente", "recebimento de venda", "recebimento de duplicata", "pagamento a fornecedor", "pagamento de fornecedor", "pagamento a empregado", "pagamento de salario", "pagamento de imposto", "imposto de renda pago", "imposto pago", "juros pago", "juros recebido")),
    ),
)


def singular(w: Column) -> Column:
    """A word without its plural ending."""
    out = w
    for ending, cut, put, least in reversed(PLURALS):
        out = F.when(w.endswith(ending) & (F.length(w) >= least), F.concat(F.left(w, F.length(w) - cut), F.lit(put))).otherwise(out)
    return out


def tokens(c: Column) -> Column:
    """The distinct words in the singular, without connectives."""
    return F.array_except(F.transform(words(c), singular), F.array(*map(F.lit, CONNECTIVES)))


def phrase_tokens(phrase: str) -> list[str]:
    """The same tokens of a fixed phrase, when the plan is built."""
    plain = "".join(x for x in unicodedata.normalize("NFD", phrase.lower()) if not unicodedata.combining(x))
    out = []
    for w in re.findall("[a-z0-9]+", plain):
        for ending, cut, put, least in PLURALS:
            if w.endswith(ending) and len(w) >= least:
                w = w[:-cut] + put
                break
        if w not in CONNECTIVES and w not in out:
            out.append(w)
    return out


def has_phrase(t: Column, phrase: str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, phrase_tokens(phrase))), t)) == 0


def has_any(t: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | has_phrase(t, p)
    return out


def is_caption(label: Column, t: Column, phrase: str, extra: int) -> Column:
    """Whether a label is the caption of a total: the phrase and few words besides it."""
    spare = F.array_except(t, F.array(*map(F.lit, [*phrase_tokens(phrase), *CAPTION_WORDS])))
    return ~label.rlike(DETAIL) & has_phrase(t, phrase) & (F.size(spare) <= extra)


def classify(section: Column, label: Column, statement: Statement) -> Column:
    """Struct of section and anchor of a line; at most one of them is set.

    The tokens are made once and bound, so that the expression doesn't repeat them.
    """
    label = F.coalesce(label, F.lit(""))
    section = F.coalesce(section, F.lit(""))
    sets = F.struct(tokens(label).alias("own"), tokens(section).alias("theirs"), tokens(F.concat_ws(" ", section, label)).alias("both"))
    return F.transform(F.array(sets), lambda t: _classified(label, t["own"], t["theirs"], t["both"], statement))[0]


def _classified(label: Column, own: Column, theirs: Column, both: Column, statement: Statement) -> Column:
    anchor = F.lit(None).cast("string")
    for key, captions, extra in reversed(statement.anchors):
        hit = F.lit(False)
        for c in captions:
            hit = hit | is_caption(label, own, c, extra)
        anchor = F.when(hit, F.lit(key)).otherwise(anchor)
    found = F.lit(None).cast("string")
    for key, phrases in reversed(statement.phrases):
        found = F.when(has_any(both, phrases), F.lit(key)).otherwise(found)
    # longer declarations are tried before the shorter ones they contain, of equal ones the first
    for phrase, key in reversed(sorted(statement.declared, key=lambda d: -len(d[0]))):
        found = F.when(has_phrase(theirs, phrase), F.lit(key)).otherwise(found)
    redundant = F.lit(False)
    for phrases in statement.redundant:
        every = F.lit(True)
        for p in phrases:
            every = every & has_phrase(own, p)
        redundant = redundant | every
    return F.struct(F.when(anchor.isNull() & ~redundant, found).alias("section"), anchor.alias("anchor"))


def is_note(section: Column) -> Column:
    """Sections that are explanatory notes, not statements."""
    return normalize(section).rlike(r"^notas?\b\s*(explicativas?\b|(n[o°]?\.?\s*)?\d+\b)")


def is_equity_movement(label: Column) -> Column:
    """Balances at a date, as the statement of changes in equity has them."""
    t = normalize(label)
    return t.contains("saldo") & (t.rlike(r"\d{1,2}/\d{1,2}/\d{2,4}") | t.rlike(r"\d{1,2} de [a-z]+ de (19|20)\d{2}"))


def family(section: Column, label: Column) -> Column:
    """dmpl, fluxo_caixa or dre, by the first statement that knows the line; else null."""
    flow, income = classify(section, label, CASH_FLOW), classify(section, label, INCOME)
    known = lambda c: c["section"].isNotNull() | c["anchor"].isNotNull()
    return F.when(is_equity_movement(label) & flow["anchor"].isNull(), "dmpl").when(known(flow), "fluxo_caixa").when(known(income), "dre")
