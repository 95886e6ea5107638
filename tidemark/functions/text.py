"""Labels as Columns: normal form, tokens, radicals, containment, entity names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fold of accents, words without structural meaning, legal suffixes.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"
STOPWORDS = (
    "total", "totais", "geral", "gerais", "soma", "somatorio", "subtotal",
    "de", "do", "da", "dos", "das", "e", "o", "a", "os", "as", "em", "no", "na",
    "liquido", "liquida", "consolidado", "consolidada", "combinado", "combinada",
)
LEGAL_SUFFIX = r"\s+(ltda|limitada|s\s*a|sa|s\s*/\s*a|eireli|me|epp|mei|em recuperacao judicial|em rj)\.?\s*$"


def normalize(c: Column) -> Column:
    """Lower case, without accents, runs of white space as one; null as empty."""
    folded = F.translate(F.lower(F.coalesce(c, F.lit(""))), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def words(c: Column) -> Column:
    """The runs of letters and digits of the normal form, in order."""
    return F.filter(F.split(F.regexp_replace(normalize(c), "[^a-z0-9]+", " "), r"\s+"), lambda w: w != "")


def structural_tokens(c: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """The distinct words without the stopwords, sorted."""
    return F.array_sort(F.array_except(words(c), F.array(*map(F.lit, stopwords))))


def is_structural(c: Column, tokens: Sequence[str], stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Whether the structural tokens are exactly these."""
    return normal_is_structural(normalize(c), tokens, stopwords)


def normal_is_structural(plain: Column, tokens: Sequence[str], stopwords: Sequence[str] = STOPWORDS) -> Column:
    """The same of a normal form: it holds each token, and every word is a token or a stopword, found without cutting it into words."""
    if set(tokens) & set(stopwords) or not all(re.fullmatch("[a-z0-9]+", t) for t in tokens):
        return F.lit(False)
    known = "|".join(sorted({*tokens, *stopwords}))
    out = F.lit(True)
    for t in sorted(set(tokens)):
        out = out & plain.contains(t)
    out = out & plain.rlike(rf"^[^a-z0-9]*+(?:(?:{known})(?![a-z0-9])[^a-z0-9]*+)*+\z")
    # "a" occurs in "ativo", so a token that is in another word is looked for as a word
    for t in sorted(set(tokens)):
        if any(t in w and t != w for w in (*tokens, *stopwords)):
            out = out & plain.rlike(rf"(?<![a-z0-9]){t}(?![a-z0-9])")
    return out


def radicals(c: Column, length: int = 5) -> Column:
    """The distinct first letters of the words, sorted."""
    return F.array_sort(F.array_distinct(F.transform(words(c), lambda w: F.substring(w, 1, length))))


def has_long_word(c: Column, length: int = 4) -> Column:
    return F.exists(words(c), lambda w: F.length(w) >= length)


def contained(short: Column, long: Column) -> Column:
    """A label with a long word whose radicals all occur in the other label."""
    return has_long_word(short) & (F.size(F.array_except(radicals(short), radicals(long))) == 0)


def canonical_entity(c: Column) -> Column:
    """A name without one trailing legal suffix and without punctuation; empty as null."""
    plain = F.regexp_replace(normalize(c), LEGAL_SUFFIX, "")
    plain = F.regexp_replace(plain, r"""[.,;:/\\()'"-]""", " ")
    return F.nullif(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))


def same_entity(a: Column, b: Column) -> Column:
    """Equal canonical names, or the shorter's tokens begin successive tokens of the longer.

    The shorter name needs a token of four letters. Null names are never the same.
    """
    x, y = canonical_entity(a), canonical_entity(b)
    first = F.length(x) <= F.length(y)
    short, long = F.split(F.when(first, x).otherwise(y), " "), F.split(F.when(first, y).otherwise(x), " ")
    matched = F.aggregate(long, F.lit(0), lambda j, t: F.when((j < F.size(short)) & t.startswith(F.get(short, j)), j + 1).otherwise(j))
    loose = F.exists(short, lambda t: F.length(t) >= 4) & (matched == F.size(short))
    return F.coalesce((x == y) | loose, F.lit(False))


def has_terms(c: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Whether the normal form holds all of some terms and none of others."""
    text = normalize(c)
    out = F.lit(True)
    for term in include:
        out = out & text.contains(term)
    for term in exclude:
        out = out & ~text.contains(term)
    return out


def file_label(c: Column) -> Column:
    """A file name without accents and extension, separators as spaces."""
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), FOLD_FROM, FOLD_TO), r"\.[a-z0-9]{2,4}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[_.\-]+", " "), r"\s+", " "))


def locale_number(c: Column) -> Column:
    """A number with decimal comma or point; dots are thousands only beside a comma."""
    t = F.trim(c.cast("string"))
    plain = F.when(t.contains(","), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t)
    return plain.try_cast("double")
