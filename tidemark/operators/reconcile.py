"""Reconciliations of documents: every check of every target from one pass over the lines.

Lines (doc_id, section, label, entity_col, period_col, value, unit, confidence) are aggregated
once, by document, columns and unit, for all strategies of all checks together; a document's
few aggregates are then one row. A target (a case's entity and period) picks its documents, and
columns, cascades, comparison and verdict are expressions on that row: the lines are never
read or joined again, whatever the number of checks.

A check compares two sides, year by year. A side is found in a document of given types, in
the entity's and the year's columns, by an ordered list of steps. A step adds up its parts; a
part is the first of its strategies that finds a line. A step of sums counts if one part found
lines, any other if all parts did.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import period, text, units
from .checks import Strategy
from .pick import first_per_key

#: Kinds of strategies that add lines up; `lines` sums labels with any of the terms, `year` those that name the year.
SUMS = ("sum", "lines", "year")
#: Bits of a long that are used.
WORD = 60
_CELL = "entity", "period", "unit", "hits", "years"


@dataclass(frozen=True)
class Side:
    """types: document types, preferred ones first; own: documents of no entity don't count;
    by_entity, by_period: lines of the entity's and the year's column only; doc_unit: sums have the document's most frequent unit.
    """

    steps: tuple[tuple[tuple[Strategy, ...], ...], ...]
    types: tuple[str, ...]
    own: bool = False
    by_entity: bool = True
    by_period: bool = True
    doc_unit: bool = False

    def strategies(self) -> list[Strategy]:
        return [s for step in self.steps for part in step for s in part]


@dataclass(frozen=True)
class Check:
    """absolute counts in side a's unit where scaled; needs_year: a period without years is not checked."""

    name: str
    a: Side
    b: Side
    absolute: float
    relative: float
    differs: str = "divergent"
    scaled: bool = True
    magnitude: bool = False
    needs_year: bool = False


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _tests(s: Strategy) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]], list[tuple[str, ...]]]:
    """What a line that the strategy looks for has all of, none of and, if there is any, one of."""
    holds = lambda where, terms: [(where, t) for t in terms]
    valued, filed = ("valued",), ("filed",)
    totals = [("begins", "total"), ("begins", "subtotal")]
    if s.kind == "structure":
        return [valued, ("structure", *sorted(s.include))], [], []
    if s.kind == "label":
        return [valued, *holds("label", s.include)], holds("label", s.exclude), []
    if s.kind == "section":
        return [valued, filed, *holds("section", s.include)], holds("section", s.exclude) + holds("label", s.exclude), []
    if s.kind == "sum":
        return [valued, filed, *holds("section", s.include)], [*holds("section", s.exclude), *holds("label", s.spared), ("heading",), *totals], []
    if s.kind == "lines":
        return [valued], [totals[0], ("label", "total ")], holds("label", s.include) or [("never",)]
    return [valued, ("digits",)], holds("label", s.exclude), []


def _holds(test: tuple[str, ...]) -> Column:
    """Whether a line, with its normal forms beside it, passes a test; never null."""
    kind, *terms = test
    label, section = F.col("_label"), F.col("_section")
    if kind in ("label", "section"):
        return F.col(f"_{kind}").contains(terms[0])
    if kind == "begins":
        return label.startswith(terms[0])
    if kind == "structure":
        return text.normal_is_structural(label, terms)
    return {"valued": F.col("value").isNotNull(), "filed": F.col("section").isNotNull(), "heading": label == section, "digits": label.rlike("[0-9]{2}"), "never": F.lit(False)}[kind]


def _packed(tests: Sequence[Column]) -> list[Column]:
    """Tests as the bits of longs, `WORD` in each."""
    words = []
    for at in range(0, len(tests), WORD):
        out = F.lit(0).cast("long")
        for k, t in enumerate(tests[at : at + WORD]):
            out = out.bitwiseOR(F.when(t, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        words.append(out)
    return words


def _bit_of(words: Column, k: Column, n: int) -> Column:
    """Whether bit k of n is set."""
    if n <= WORD:
        return F.getbit(F.get(words, F.lit(0)), k) == 1
    return F.getbit(F.get(words, F.floor(k / WORD).cast("int")), (k % WORD).cast("int")) == 1


def _with_hits(rows: DataFrame, known: Sequence[Strategy]) -> DataFrame:
    """The rows with `hits`: a bit a strategy, in longs. Each term is looked for once a line, whatever the number of strategies."""
    wanted = [_tests(s) for s in known]
    tests = list(dict.fromkeys(t for every, none, some in wanted for t in (*every, *none, *some)))
    rows = rows.select("*", *(w.alias(f"_t{i}") for i, w in enumerate(_packed([_holds(t) for t in tests]))))

    def masks(of: Sequence[tuple[str, ...]]) -> list[tuple[Column, Column]]:
        places = [tests.index(t) for t in of]
        found = [(i, sum(1 << (k % WORD) for k in set(places) if k // WORD == i)) for i in range(-(-len(tests) // WORD))]
        return [(F.col(f"_t{i}").bitwiseAND(F.lit(m).cast("long")), F.lit(m).cast("long")) for i, m in found if m]

    def hit(every: Sequence, none: Sequence, some: Sequence) -> Column:
        out = F.lit(True)
        for got, mask in masks(every):
            out = out & (got == mask)
        for got, _ in masks(none):
            out = out & (got == 0)
        if some:
            one = F.lit(False)
            for got, _ in masks(some):
                one = one | (got != 0)
            out = out & one
        return out

    return rows.withColumn("hits", F.array(*_packed([hit(*w) for w in wanted])))


def _named_years(label: Column) -> Column:
    """Years in four digits, and two digits after a separator where no such year ends in them."""
    full = F.array_distinct(F.transform(F.regexp_extract_all(label, F.lit("((?:19|20)[0-9]{2})"), F.lit(1)), lambda y: y.cast("int")))
    short = F.array_distinct(F.transform(F.regexp_extract_all(label, F.lit("[/. -]([0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int")))
    return F.concat(full, F.filter(short, lambda y: ~F.exists(full, lambda z: z % 100 == y)))


def _strategies(checks: Sequence[Check]) -> list[Strategy]:
    return list(dict.fromkeys(s for c in checks for side in (c.a, c.b) for s in side.strategies()))


def aggregated(lines: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Per document: cells (lines of the same columns and unit that the same strategies look for), its entity and period columns, its unit.

    A cell has the number and sum of its lines, the years that they name (where a strategy asks) and
    the best of them: most confidence (none counts as 0), then the shortest label (`longest`: the
    longest, for `structure`), then label, value and unit. A line is in one cell, however many
    strategies look for it, so a document has at most as many cells as lines, and as many as its columns,
    units and kinds of lines.
    """
    known = _strategies(checks)
    rows = lines.select(
        "doc_id", "section", "label", "value", F.nullif(F.trim("unit"), F.lit("")).alias("unit"), "confidence", F.col("entity_col").alias("entity"), F.col("period_col").alias("period"),
        text.normalize(F.col("label")).alias("_label"), text.normalize(F.col("section")).alias("_section"),
    )
    rows = _with_hits(rows, known)

    def asked(*kinds: str) -> Column:
        out = F.lit(False)
        for i in range(-(-len(known) // WORD)):
            mask = sum(1 << (k % WORD) for k, s in enumerate(known) if s.kind in kinds and k // WORD == i)
            out = out | (F.get("hits", F.lit(i)).bitwiseAND(F.lit(mask).cast("long")) != 0) if mask else out
        return out

    rows = rows.select("doc_id", "entity", "period", "unit", "hits", F.when(asked("year"), _named_years(F.col("_label"))).alias("years"), "label", "value", "confidence")
    by = lambda length: F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), length.alias("l"), F.coalesce("label", F.lit("")).alias("label"), "value")
    best, longest = F.min(F.when(asked("label", "section"), by(F.length("label")))), F.min(F.when(asked("structure"), by(-F.length("label"))))
    cells = rows.groupBy("doc_id", *_CELL).agg(F.count("*").alias("n"), F.sum("value").alias("sum"), best.alias("best"), longest.alias("longest"))
    one = cells.groupBy("doc_id").agg(F.collect_list(F.struct(*_CELL, "n", "sum", "best", "longest")).alias("_every"))
    named = lambda field: F.array_distinct(F.transform(F.filter("_every", lambda c: c[field].isNotNull()), lambda c: c[field]))
    count = lambda field, x: F.aggregate("_every", F.lit(0).cast("long"), lambda a, c: F.when(c[field] == x, a + c["n"]).otherwise(a))
    periods = F.transform(named("period"), lambda p: F.struct((-count("period", p)).alias("n"), p.alias("period"), period.years_of_text(p).alias("years")))
    unit = F.array_min(F.transform(named("unit"), lambda u: F.struct((-count("unit", u)).alias("n"), u.alias("unit"))))["unit"]
    return one.select("doc_id", F.filter("_every", lambda c: F.exists(c["hits"], lambda h: h != 0)).alias("cells"), named("entity").alias("entities"), periods.alias("periods"), unit.alias("unit"))


def _roles(checks: Sequence[Check]) -> dict[tuple[tuple[str, ...], bool], str]:
    return {key: f"_doc{k}" for k, key in enumerate(dict.fromkeys((s.types, s.own) for c in checks for s in (c.a, c.b)))}


def picked_documents(targets: DataFrame, documents: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Per target and role of a document: the one of the preferred type, then the newest, then of the least id.

    targets: case_id, entity_id, ref. documents: case_id, doc_id, doc_type, entity_id, ref, created.
    A target without entity takes documents of any; others their own and, unless the side wants
    its own only, those of no entity. Periods have to share a year; one without years shares all.
    """
    roles = _roles(checks)
    every = list(dict.fromkeys(x for types, _ in roles for x in types))
    docs = documents.where(F.col("doc_type").isin(*every)).select("case_id", "doc_id", "doc_type", F.col("entity_id").alias("_entity"), F.col("ref").alias("_ref"), "created", period.years(F.col("ref")).alias("_of"))
    # a period is read once a row, before targets and documents meet
    both = targets.select("case_id", "entity_id", "ref").distinct().withColumn("_asked", period.years(F.col("ref"))).join(docs, "case_id")
    any_entity = F.col("entity_id").isNull() | (F.col("_entity") == F.col("entity_id"))
    fits = F.col("ref").isNull() | F.col("_ref").isNull() | period.share_a_year(F.col("_of"), F.col("_asked"))
    taken = [F.when(F.col("doc_type").isin(*types) & F.coalesce(any_entity if own else any_entity | F.col("_entity").isNull(), F.lit(False)), F.struct(F.lit(role).alias("role"), F.array_position(F.array(*map(F.lit, types)), F.col("doc_type")).alias("place"))) for (types, own), role in roles.items()]
    rows = both.where(fits).select("case_id", "entity_id", "ref", "doc_id", "created", F.coalesce(F.col("_entity") == F.col("entity_id"), F.lit(False)).alias("owner"), F.inline(F.array_compact(F.array(*taken))))
    return first_per_key(rows, ["case_id", "entity_id", "ref", "role"], [F.col("place"), -F.unix_timestamp("created"), F.col("doc_id")]).select("case_id", "entity_id", "ref", "role", "doc_id", "owner")


def _entity_column(doc: Column, name: Column) -> Column:
    """The names of the column of the entity, else, for the owner, of the totals; null for any, empty for none."""
    own = F.array_min(F.filter(doc["entities"], lambda e: text.same_entity(e, name)))
    whole = F.when(doc["owner"], F.array_min(F.filter(doc["entities"], lambda e: text.normalize(e).rlike("^(combinad|consolidad|total|soma)"))))
    return F.when(F.size(doc["entities"]) > 0, _bound(F.coalesce(own, whole), lambda x: _alike(doc["entities"], x)))


def _period_column(doc: Column, year: Column) -> Column:
    """The names of the year's most frequent column; null for any, empty for none."""
    best = F.array_min(F.filter(doc["periods"], lambda p: F.array_contains(p["years"], year)))["period"]
    return F.when(year.isNotNull() & (F.size(doc["periods"]) > 0), _bound(best, lambda x: _alike(F.transform(doc["periods"], lambda p: p["period"]), x)))


def _alike(names: Column, name: Column) -> Column:
    """The names with the normal form of one of them, which is among them; none for null."""
    return F.filter(names, lambda x: name.isNotNull() & ((x == name) | (text.normalize(x) == text.normalize(name))))


_SIDE = "struct<role: int, by_entity: boolean, by_period: boolean, doc_unit: boolean, steps: array<struct<parts: array<array<int>>, loose: boolean>>>"
_CHECK = f"struct<name: string, sides: array<{_SIDE}>, absolute: double, relative: double, differs: string, scaled: boolean, magnitude: boolean, needs_year: boolean>"


def _as_data(checks: Sequence[Check]) -> tuple[Column, Column, Column]:
    """The checks, with numbers for roles and strategies, and the strategies' names and kinds, as constants.

    One expression then stands for all checks, steps and strategies, however many they are.
    """
    known, roles = _strategies(checks), list(_roles(checks))

    def side(s: Side) -> dict:
        steps = [{"parts": [[known.index(x) for x in part] for part in step], "loose": all(x.kind in SUMS for part in step for x in part)} for step in s.steps]
        return {"role": roles.index((s.types, s.own)), "by_entity": s.by_entity, "by_period": s.by_period, "doc_unit": s.doc_unit, "steps": steps}

    every = [{"name": c.name, "sides": [side(c.a), side(c.b)], **{f: getattr(c, f) for f in ("absolute", "relative", "differs", "scaled", "magnitude", "needs_year")}} for c in checks]
    told = lambda data, kind: F.from_json(F.lit(json.dumps(data)), kind)
    return told(every, f"array<{_CHECK}>"), told([s.name for s in known], "array<string>"), told([s.kind for s in known], "array<string>")


def _first(found: Column) -> Column:
    return _bound(F.filter(found, lambda x: x.isNotNull()), lambda xs: F.get(xs, 0))


def _found(side: Column, fit: Column, year: Column, doc: Column, names: Column, kinds: Column, n_known: int) -> Column:
    """(value, unit, origin, n) of the first step of a side that finds something in the cells that fit."""
    n = lambda cells: F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["n"])

    def one(k: Column) -> Column:
        timely = lambda c: F.exists(c["years"], lambda y: (y == year) | (y == year % 100))
        mine = F.filter(fit, lambda c: _bit_of(c["hits"], k, n_known) & ((F.get(kinds, k) != "year") | timely(c)))

        def value(m: Column) -> Column:
            units_of = F.array_distinct(F.transform(F.filter(m, lambda c: c["unit"].isNotNull()), lambda c: c["unit"]))
            most = F.array_min(F.transform(units_of, lambda u: F.struct((-n(F.filter(m, lambda c: c["unit"] == u))).alias("n"), u.alias("unit"))))["unit"]
            total = F.aggregate(m, F.lit(0.0), lambda a, c: a + c["sum"].cast("double"))
            added = F.struct(total.alias("value"), F.when(side["doc_unit"], doc["unit"]).otherwise(most).alias("unit"), F.get(names, k).alias("origin"), n(m).alias("n"))
            picked = lambda b: F.struct(b["value"].cast("double").alias("value"), F.nullif(b["unit"], F.lit("")).alias("unit"), F.concat(F.get(names, k), F.lit(": "), b["label"]).alias("origin"), F.lit(1).cast("long").alias("n"))
            best = lambda c: F.when(F.get(kinds, k) == "structure", c["longest"]).otherwise(c["best"])
            lines = F.transform(m, lambda c: _bound(best(c), lambda b: F.struct(*(b[x].alias(x) for x in ("c", "l", "label", "value")), F.coalesce(c["unit"], F.lit("")).alias("unit"))))
            return F.when(F.size(m) > 0, F.when(F.get(kinds, k).isin(*SUMS), added).otherwise(_bound(F.array_min(lines), picked)))

        return _bound(mine, value)

    def step(st: Column) -> Column:
        def together(had: Column) -> Column:
            enough = (F.size(had) == F.size(st["parts"])) | (st["loose"] & (F.size(had) > 0))
            whole = F.struct(
                F.aggregate(had, F.lit(0.0), lambda a, x: a + x["value"]).alias("value"), F.get(F.array_compact(F.transform(had, lambda x: x["unit"])), 0).alias("unit"),
                F.array_join(F.transform(had, lambda x: x["origin"]), " + ").alias("origin"), F.aggregate(had, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"),
            )
            return F.when(enough, whole)

        return _bound(F.array_compact(F.transform(st["parts"], lambda part: _first(F.transform(part, one)))), together)

    return _first(F.transform(side["steps"], step))


def _valued(side: Column, doc: Column, name: Column, year: Column, names: Column, kinds: Column, n_known: int) -> Column:
    entity = F.when(side["by_entity"], _entity_column(doc, name))
    column = F.when(side["by_period"], _period_column(doc, year))

    def within(keys: Column) -> Column:
        fits = lambda c, field: keys[field].isNull() | (c[field].isNotNull() & F.array_contains(keys[field], c[field]))
        mine = F.filter(doc["cells"], lambda c: fits(c, "entity") & fits(c, "period"))
        return _bound(mine, lambda cells: _found(side, cells, year, doc, names, kinds, n_known))

    return _bound(F.struct(entity.alias("entity"), column.alias("period")), within)


def _compared(check: Column, x: Column) -> Column:
    """year, values, gap, share and state (ok, apart, unmet, incomparable) of one year's sides."""
    a, b = F.get(x["sides"], 0), F.get(x["sides"], 1)
    based = F.transform(x["sides"], lambda s: F.struct(F.when(check["scaled"], units.in_base(s["value"], s["unit"])).otherwise(s["value"]).alias("value")))
    values = F.transform(based, lambda s: F.when(check["magnitude"], F.abs(s["value"])).otherwise(s["value"]))

    def judged(v: Column) -> Column:
        va, vb = F.get(v, 0), F.get(v, 1)
        gap = F.abs(va - vb)
        factor = F.when(check["scaled"], F.coalesce(units.scale_factor(a["unit"]), F.lit(1))).otherwise(1)
        allowed = F.greatest(factor * check["absolute"], F.abs(va) * check["relative"])
        apart = check["scaled"] & units.incomparable(a["unit"], b["unit"]).isNotNull()
        state = F.when(va.isNull() | vb.isNull(), "unmet").when(apart, "incomparable").when(gap > allowed, "apart").otherwise("ok")
        share = F.when(va != 0, gap / F.abs(va))
        return F.struct(x["year"].alias("year"), va.alias("value_a"), vb.alias("value_b"), gap.alias("gap"), share.alias("share"), state.alias("state"), a["origin"].alias("origin_a"), b["origin"].alias("origin_b"))

    return _bound(values, judged)


def _verdict(check: Column, there: Column, years: Column) -> Column:
    """The check's row: missing (a document), unmet, differing or ok; the worst year's gap, of equal ones the first's."""
    states = F.transform(years, lambda y: y["state"])
    count = lambda *names: F.size(F.filter(states, lambda s: s.isin(*names)))
    counts = F.struct(count("ok", "apart").alias("checked"), count("unmet").alias("unmet"), count("incomparable").alias("bad"), count("apart").alias("apart"))
    worst = F.array_min(F.transform(F.filter(years, lambda y: y["state"] == "apart"), lambda y: F.struct((-y["gap"]).alias("g"), F.coalesce(y["year"], F.lit(0)).alias("year"), y["gap"].alias("gap"), y["share"].alias("share"))))

    def row(n: Column) -> Column:
        verdict = F.when(~there, "missing").when((n["bad"] > 0) | (n["checked"] == 0), "unmet").when(n["apart"] > 0, check["differs"]).otherwise("ok")
        done = there & (n["bad"] == 0) & (n["checked"] > 0)
        return F.struct(
            check["name"].alias("check"), verdict.alias("verdict"), F.when(done, n["checked"]).otherwise(0).cast("long").alias("checked"), F.when(done, n["unmet"]).otherwise(0).cast("long").alias("unchecked"),
            F.when(done, worst["gap"]).alias("worst_gap"), F.when(done, worst["share"]).alias("worst_share"), F.when(done, years).alias("years"),
        )

    return _bound(counts, row)


def reconciled(lines: DataFrame, documents: DataFrame, targets: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """A row per target and check: verdict, years checked and unchecked, worst gap and share, and the years.

    targets: case_id, entity_id, entity_name, ref; entity and ref may be null. Verdicts: missing
    (one of the documents is), unmet (no year has both sides in comparable units), ok, or the
    check's own. Repeated targets are one; lines of unknown documents count for nothing.
    """
    roles = _roles(checks)
    every, names, kinds = _as_data(checks)
    picks = picked_documents(targets, documents, checks).join(aggregated(lines, checks), "doc_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(dict(picks.dtypes)[c])).alias(c)
    whole = F.struct("doc_id", "owner", empty("cells"), empty("entities"), empty("periods"), "unit")
    keys = ["case_id", "entity_id", "ref"]
    wide = picks.groupBy(*keys).agg(*(F.first(F.when(F.col("role") == r, whole), ignorenulls=True).alias(r) for r in roles.values()))
    one = targets.groupBy(*keys).agg(F.min("entity_name").alias("entity_name"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"w.{k}"))
    rows = one.alias("t").join(wide.alias("w"), same, "left").select(*(F.col(f"t.{k}").alias(k) for k in keys), "entity_name", F.array(*roles.values()).alias("_docs"), period.target_years(F.col("t.ref")).alias("_years"))
    doc_of = lambda side: F.get("_docs", side["role"])

    def result(check: Column) -> Column:
        years = F.filter("_years", lambda y: y.isNotNull() | ~check["needs_year"])
        valued = lambda y: F.transform(check["sides"], lambda side: _bound(doc_of(side), lambda doc: _valued(side, doc, F.col("entity_name"), y, names, kinds, len(_strategies(checks)))))
        compared = F.transform(F.transform(years, lambda y: F.struct(y.alias("year"), valued(y).alias("sides"))), lambda x: _compared(check, x))
        there = F.forall(check["sides"], lambda side: doc_of(side).isNotNull())
        return _bound(compared, lambda ys: _verdict(check, there, ys))

    # outer: Spark would work the rows out a second time to drop targets without any
    return rows.select(*keys, F.inline_outer(F.transform(every, result)))


def by_document(documents: DataFrame, periods: DataFrame, takes: DataFrame) -> DataFrame:
    """Per document the checks of its type and, in order, the periods of the case that they may be tried on.

    takes: check, doc_type. Its own period comes first, then those that share a year, by name.
    """
    mine = documents.select("case_id", "doc_id", "doc_type", "entity_id", F.col("ref").alias("own_ref"), period.years(F.col("ref")).alias("_own")).join(F.broadcast(takes), "doc_type")
    both = mine.join(periods.select("case_id", "ref").distinct().withColumn("_years", period.years(F.col("ref"))), "case_id")
    own = F.col("ref").eqNullSafe(F.col("own_ref"))
    return both.where(own | F.coalesce(period.share_a_year(F.col("_years"), F.col("_own")), F.lit(True))).drop("_own", "_years").withColumn("place", F.struct((~own).alias("later"), F.col("ref").alias("name")))


def first_met(tried: DataFrame, results: DataFrame) -> DataFrame:
    """Of a document's periods the first whose verdict is not unmet, else the last: doc_id, check, ref and the verdict's columns."""
    keys = ["case_id", "entity_id", "ref", "check"]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}"))
    shown = [c for c in results.columns if c not in keys]
    both = tried.alias("t").join(results.alias("r"), same).select("t.case_id", "t.doc_id", "t.doc_type", "t.entity_id", "t.check", "t.place", "t.ref", *(f"r.{c}" for c in shown))
    row = F.struct("ref", *shown)
    met = F.min(F.when(F.col("verdict") != "unmet", F.struct("place", row.alias("row"))))
    last = F.max(F.struct("place", row.alias("row")))
    one = both.groupBy("case_id", "doc_id", "doc_type", "entity_id", "check").agg(F.coalesce(met, last)["row"].alias("_row"))
    return one.select("case_id", "doc_id", "doc_type", "entity_id", "check", "_row.*")
