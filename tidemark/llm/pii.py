"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Only SQL functions: a kind's matches come from regexp_extract_all, the text between
them from split on the same pattern. A match's context is taken from the matches and gaps
beside it, and folds over their lengths give the positions (code points, end exclusive),
in pieces of about the square root of the matches. The patterns are the linear-time forms of the plain ones: a
look-behind lets a match begin only where a run of its characters begins, and
quantifiers are possessive, so very long runs cost no backtracking.

Kinds: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15
digits) and iban (mod-97). A match that its validator rejects is dropped, not retried.

Defined results
---------------
* null and empty texts have no spans: counts 0, base_sha256 of the empty string.
* a match keeps its place in every kind that finds it; kinds may overlap one another.
* a span's score is the kind's own confidence, 0.15 higher when a context word of the
  kind stands within WINDOW characters before or after it, 0.1 lower when a word of
  the opposite kind (test, example, version...) does. Scores never drop a span.
* repeated rows are treated alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters looked at on each side of a span for context words, and the most of a word that reaches into them.
WINDOW, WORD = 40, 20
#: Matches beside another one that a context can reach: the shortest match of any kind has 4 characters.
AROUND = (WINDOW + WORD) // 4

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: Confidence of a confirmed span by kind, context words that raise it, words that lower it.
CONFIDENCE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.85}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "server|host|login|addr|client",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "tel|phone|call|mobile|fax|fon",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
AGAINST = "test|example|version|order no|sample"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")


def _digits(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", ""))


def luhn(x: Column) -> Column:
    digits = F.reverse(F.regexp_replace(x, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0)


def mod97(x: Column) -> Column:
    plain = F.replace(x, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")

    def step(r: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        return F.when(letter, r * 100 + F.ascii(c) - 55).when(F.ascii(c) >= 48, r * 10 + F.ascii(c) - 48).otherwise(r) % 97

    return F.length(plain).between(15, 34) & (F.aggregate(moved, F.lit(0), step) == 1)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255")),
    "card": luhn,
    "phone": lambda x: _digits(x).between(9, 15),
    "iban": mod97,
}
#: A cheap test that the text can hold a match at all.
_MAY = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
}


def _found(text: Column, kind: str) -> tuple[Column, Column]:
    """The matches of a kind and the text between them (one more)."""
    p = PATTERNS[kind]
    return F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.split(text, p, -1)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _pairs(text: Column, kind: str) -> Column:
    """Structs of the text before a match, the match and the text after it."""
    hits, gaps = _found(text, kind)
    return _bound(gaps, lambda g: F.arrays_zip(hits.alias("hit"), F.slice(g, F.lit(1), F.size(g) - 1).alias("before"), F.slice(g, F.lit(2), F.size(g) - 1).alias("after")))


def _sized(x: Column) -> Column:
    """A pair as its lengths, the match, and as much of it and its gaps as a context may hold."""
    most = F.lit(WINDOW + WORD)
    return F.struct(
        F.length(x["before"]).alias("gap"), F.length(x["hit"]).alias("size"), x["hit"].alias("hit"),
        F.right(x["before"], most).alias("before"), F.left(x["after"], most).alias("after"), F.right(x["hit"], most).alias("tail"), F.left(x["hit"], most).alias("head"),
    )


def _context(all_pairs: Column, x: Column, at: Column) -> Column:
    """What stands within WINDOW characters of a match, over the matches beside it if need be."""
    n = WINDOW + WORD
    first = F.greatest(F.lit(0), at - AROUND)
    behind = F.array_join(F.transform(F.slice(all_pairs, first + 1, at - first), lambda y: F.concat(y["before"], y["tail"])), "")
    past = F.right(F.concat(behind, x["before"]), F.lit(n))
    coming = F.array_join(F.transform(F.slice(all_pairs, at + 2, F.lit(AROUND)), lambda y: F.concat(y["head"], y["after"])), "")
    ahead = F.left(F.concat(x["after"], coming), F.lit(n))
    # words that the window's edge would cut are looked at whole
    sides = F.regexp_extract(past, rf"(?s)\S{{0,{WORD}}}.{{0,{WINDOW}}}$", 0), F.regexp_extract(ahead, rf"(?s)^.{{0,{WINDOW}}}\S{{0,{WORD}}}", 0)
    return F.lower(F.concat_ws(" ", *sides))


def _scored(kind: str, all_pairs: Column) -> Column:
    """Per pair: its lengths and the score of a confirmed match, null for any other."""

    def score(x: Column, at: Column) -> Column:
        rated = _bound(_context(all_pairs, x, at), lambda near: F.lit(CONFIDENCE[kind]) + F.when(near.rlike(CONTEXT[kind]), 0.15).otherwise(0.0) - F.when(near.rlike(AGAINST), 0.1).otherwise(0.0))
        return F.struct(x["gap"].cast("long").alias("gap"), x["size"].cast("long").alias("size"), F.when(VALID[kind](x["hit"]), rated).alias("score"))

    return F.transform(all_pairs, score)


def _placed(scored: Column) -> Column:
    """Structs of start, end and score, from the lengths.

    Appending to an array copies it, so positions are gathered in pieces of about the square
    root of their number, and the pieces are put together at the end.
    """
    spot = "struct<start: bigint, end: bigint, score: double>"

    def step(a: Column, x: Column) -> Column:
        start = a["pos"] + x["gap"]
        end = start + x["size"]
        return F.struct(end.alias("pos"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["score"].alias("score")))).alias("out"))

    def piece(a: Column, part: Column) -> Column:
        folded = F.aggregate(part, F.struct(a["pos"].alias("pos"), F.array().cast(f"array<{spot}>").alias("out")), step)
        return _bound(folded, lambda f: F.struct(f["pos"].alias("pos"), F.concat(a["out"], F.array(f["out"])).alias("out")))

    def whole(x: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(x) / size).cast("int") - 1)), lambda k: F.slice(x, k * size + 1, size))
        start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<array<{spot}>>").alias("out"))
        return F.flatten(F.aggregate(parts, start, piece)["out"])

    return _bound(scored, whole)


def spans(text: Column, kind: str) -> Column:
    """Struct of n, spans (kind:start:end joined by commas) and scored (with the score).

    The context of a match is what stands within WINDOW characters of it in the text; it may
    reach over other matches. The work grows with the matches times the square root of their number.
    """
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("spans"), F.lit("").alias("scored"))
    sized = F.transform(_pairs(text, kind), _sized)
    placed = _placed(_bound(sized, lambda b: _scored(kind, b)))
    name = lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda kept, f: F.array_join(F.transform(kept, f), ",")
    found = _bound(
        F.filter(placed, lambda x: x["score"].isNotNull()),
        lambda kept: F.struct(F.size(kept).cast("long").alias("n"), joined(kept, name).alias("spans"), joined(kept, lambda x: F.concat_ws(":", name(x), F.format_number(x["score"], 2))).alias("scored")),
    )
    return F.when(_MAY[kind](text), found).otherwise(empty)


def detect(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, a struct of n, spans and scored per kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(id_col, t.alias("text")).select(id_col, *(spans(F.col("text"), k).alias(k) for k in KINDS))


def mask(docs: DataFrame, text: str = "text", marks: dict[str, str] | None = None) -> DataFrame:
    """The rows with every confirmed span of the text replaced by its kind's mark.

    The kinds are masked one after another, in the order iban, card, email, ip, phone, so
    that a longer number goes before the shorter ones it contains. Null texts stay null.
    """
    for kind in ("iban", "card", "email", "ip", "phone"):
        docs = docs.withColumn(text, _masked(F.col(text), kind, (marks or {}).get(kind, f"<{kind.upper()}>")))
    return docs


def _masked(text: Column, kind: str, mark: str) -> Column:
    _, gaps = _found(text, kind)
    head = F.transform(_pairs(text, kind), lambda x: F.concat(x["before"], F.when(VALID[kind](x["hit"]), mark).otherwise(x["hit"])))
    return F.when(_MAY[kind](text), F.concat(F.array_join(head, ""), F.element_at(gaps, -1))).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans and all spans."""
    joined = lambda kinds, field: F.array_join(F.filter(F.array(*(F.col(k)[field] for k in kinds)), lambda x: x != ""), ",")
    return detect(docs).select(
        "doc_id",
        *(F.col(k)["n"].alias(f"n_{k}") for k in BASE),
        F.sha2(joined(BASE, "spans"), 256).alias("base_sha256"),
        joined(KINDS, "spans").alias("spans"),
        F.col("iban")["n"].alias("n_iban"),
        joined(KINDS, "scored").alias("scored_spans"),
    )
