"""Units, scales and currencies as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FOLD_FROM, FOLD_TO, normalize

# Spellings of the three scales.
SCALES = {
    1: ("unidade", "unidades", "reais", "real", "r$", "brl"),
    1000: ("milhar", "milhares", "mil", "r$ mil"),
    1000000: ("milhao", "milhoes", "milhao de reais"),
}


def scale_factor(unit: Column) -> Column:
    """What a value of the unit is multiplied by; null where the unit is missing or unknown."""
    t = normalize(unit)
    out = F.lit(None).cast("int")
    for factor, names in SCALES.items():
        out = F.when(t.isin(*names), F.lit(factor)).otherwise(out)
    return out


def in_base(value: Column, unit: Column) -> Column:
    return value * F.coalesce(scale_factor(unit), F.lit(1))


def incomparable(a: Column, b: Column) -> Column:
    """Why values of two units can't be compared; null where they can."""
    same = normalize(a) == normalize(b)
    known = scale_factor(a).isNotNull() & scale_factor(b).isNotNull()
    return F.when(a.isNull() | b.isNull() | same | known, F.lit(None).cast("string")).otherwise(F.format_string("%s <> %s", a, b))


# Spellings of units and currencies as whole words of free text.
UNIT_WORDS = {
    "milhao": ("milhao", "milhoes", "mm", "mi"),
    "milhar": ("milhar", "milhares", "mil", "m$"),
    "unidade": ("unidade", "unidades", "real", "reais", "inteiro", "inteiros"),
}
UNIT_NUMBERS = {"1": "unidade", "1.000": "milhar", "1000": "milhar"}
CURRENCY_WORDS = {
    "BRL": ("brl", "r$", "real", "reais"),
    "USD": ("usd", "us$", "dolar", "dolares", "dollar", "dollars"),
    "EUR": ("eur", "€", "euro", "euros"),
}
NOT_MONEY_WORDS, NOT_MONEY_PHRASES = ("percentual", "lpa", "quantidade"), ("por acao", "numero de acoes")


def _free_words(c: Column) -> Column:
    """Words of free text; a currency sign ends its word."""
    spaced = F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), r"([$€])", "$1 ")
    return F.filter(F.split(spaced, r"[^a-z0-9$€.%]+"), lambda w: w != "")


def _first_known(words: Column, known: dict[str, tuple[str, ...]]) -> Column:
    """The first key, in the order of the dictionary, of which the text has a word."""
    out = F.lit(None).cast("string")
    for key, spellings in reversed(known.items()):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, spellings))), F.lit(key)).otherwise(out)
    return out


def normal_unit(c: Column) -> Column:
    """Free text as milhao, milhar or unidade; null where it says none of them.

    A currency's sign at the end means units; a mere number is the one that units are divided by.
    """
    words = _free_words(c)
    numbers = F.create_map(*(F.lit(x) for kv in UNIT_NUMBERS.items() for x in kv))
    return F.coalesce(_first_known(words, UNIT_WORDS), F.when(F.try_element_at(words, F.lit(-1)) == "r$", "unidade"), F.when(F.size(words) == 1, F.try_element_at(numbers, words[0])))


def normal_currency(c: Column) -> Column:
    """Free text as a currency code; null where it names none. Three letters alone are a code."""
    words = _free_words(c)
    return F.coalesce(_first_known(words, CURRENCY_WORDS), F.when((F.size(words) == 1) & words[0].rlike("^[a-z]{3}$"), F.upper(words[0])))


def non_monetary(label: Column, shown: Column) -> Column:
    """Shares, ratios and quantities, which a document's scale doesn't hold for."""
    words = _free_words(F.coalesce(label, F.lit("")))
    text = F.concat(F.lit(" "), F.concat_ws(" ", words), F.lit(" "))
    out = F.arrays_overlap(words, F.array(*map(F.lit, NOT_MONEY_WORDS))) | F.coalesce(label, F.lit("")).contains("%") | F.coalesce(shown, F.lit("")).contains("%")
    for phrase in NOT_MONEY_PHRASES:
        out = out | text.contains(f" {phrase} ")
    return out
