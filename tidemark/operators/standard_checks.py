"""The four checks of statements, as data: what each side looks for, in which documents, in which order."""

from __future__ import annotations

from dataclasses import replace

from .checks import Strategy
from .reconcile import Check, Side


def _label(name: str, include: str, exclude: str = "") -> Strategy:
    return Strategy(name, "label", tuple(include.split()), tuple(exclude.split()))


# Types of documents and terms of labels and sections.
BALANCE = ("BALANCO", "COMBINADO", "BALANCETE")
_LIABILITY_TOTALS = ("total do passivo", "passivo e patrimonio")

_ASSETS = (
    ((_label("total", "ativo total", "circulante"),),),
    ((Strategy("group", "structure", ("ativo",)),),),
    ((Strategy("sum", "sum", ("ativo",), ("passivo", "patrimonio"), ("total do ativo",)),),),
)
_CLAIMS = (
    ((_label("both", "passivo patrimonio total", "circulante"),),),
    ((Strategy("group", "structure", ("passivo", "patrimonio")),),),
    (
        (_label("liabilities", "passivo total", "patrimonio circulante"), Strategy("liabilities", "structure", ("passivo",))),
        (_label("equity", "patrimonio liquido total", "circulante"), Strategy("equity", "structure", ("patrimonio",))),
    ),
    ((Strategy("sum of liabilities", "sum", ("passivo",), ("patrimonio",), _LIABILITY_TOTALS),), (Strategy("sum of equity", "sum", ("patrimonio",), (), _LIABILITY_TOTALS),)),
)
_CASH = (
    ((_label("equivalents", "caixa equivalentes", "circulante fluxo inicio inicial"),),),
    ((_label("at hand", "disponibilidades", "circulante"),),),
    ((_label("available", "disponivel", "circulante"),),),
    ((_label("banks", "caixa bancos", "circulante"),),),
    ((_label("cash", "caixa", "circulante fluxo inicio inicial equivalente"),),),
    ((Strategy("section available", "section", ("disponivel",), ("circulante",)),),),
    ((Strategy("section cash", "section", ("caixa",), ("circulante", "fluxo")),),),
)
_CLOSING = tuple(((_label(name, terms, "inicial inicio"),),) for name, terms in (("closing", "saldo final"), ("final", "caixa final"), ("end", "caixa fim")))
_REVENUE = (
    ((_label("gross", "receita bruta", "liquida deducoes deducao"),),),
    ((Strategy("sum of gross", "sum", ("receita", "bruta"), ("deducoes", "deducao"), ("liquida", "lucro bruto", "resultado", "prejuizo")),),),
)
_MONTHS = (((Strategy("months", "year", (), ("total", "acumulad", "media")),),),)
_EXPENSE = (((_label("expense", "despesa financeira", "receita"),),), ((_label("charges", "juros encargos", "receita pagos"),),))
_INTEREST = (((Strategy("contracts", "lines", ("juros", "encargos")),),),)

ASSETS_CLAIMS = Check("assets_claims", Side(_ASSETS, BALANCE, own=True), Side(_CLAIMS, BALANCE, own=True), 100, 0.005, scaled=False)
CASH = Check("cash", Side(_CASH, BALANCE, own=True), Side(_CLOSING, ("FLUXO_CAIXA",), by_entity=False), 100, 0.005)
REVENUE_BILLING = Check(
    "revenue_billing", Side(_REVENUE, ("DRE",)), Side(_MONTHS, ("FATURAMENTO_24M",), by_entity=False, by_period=False, doc_unit=True), 50_000, 0.05, differs="grey", needs_year=True
)
EXPENSE_INTEREST = Check(
    "expense_interest", Side(_EXPENSE, ("DRE",)), Side(_INTEREST, ("MAPA_DIVIDA",), by_entity=False, by_period=False, doc_unit=True), 50_000, 0.05, differs="grey", magnitude=True
)
CHECKS = (ASSETS_CLAIMS, CASH, REVENUE_BILLING, EXPENSE_INTEREST)


def with_tolerance(check: Check, absolute: float, relative: float | None = None) -> Check:
    return replace(check, absolute=absolute, relative=check.relative if relative is None else relative)
