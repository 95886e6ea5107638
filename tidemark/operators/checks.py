"""Pickers, column resolvers and sums of extracted lines; `reconcile` puts them together.

A facts table has a row a line: the keys of its document, section, label, entity_col,
period_col, value, unit, confidence; lines without a value count for nothing. All strategies of
a document are evaluated in one pass: lines are first combined by unit, then by document, so
that a hot document costs a row a task and nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .pick import first_per_key


@dataclass(frozen=True)
class Strategy:
    """How a value is found: `label`, `section`, `structure` pick a line, `sum` adds up the leaves of sections.

    include: terms that the label (the section, for `section` and `sum`) has to hold, or the
    exact structural tokens; exclude: terms that it must not hold (for `section` neither section
    nor label); spared: terms of labels that a sum leaves out.
    """

    name: str
    kind: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    spared: tuple[str, ...] = ()

    def matches(self) -> Column:
        label, section = F.col("label"), F.col("section")
        if self.kind == "structure":
            return text.is_structural(label, self.include)
        if self.kind == "label":
            return text.has_terms(label, self.include, self.exclude)
        found = section.isNotNull() & text.has_terms(section, self.include, self.exclude)
        if self.kind == "section":
            return found & text.has_terms(label, (), self.exclude)
        plain = text.normalize(label)
        leaf = (plain != text.normalize(section)) & ~plain.startswith("total") & ~plain.startswith("subtotal")
        return found & leaf & text.has_terms(label, (), self.spared)


def picked(facts: DataFrame, keys: Sequence[str], strategies: Sequence[Strategy]) -> DataFrame:
    """A struct (value, unit, origin, n) per strategy, named as it is; null where it finds nothing.

    The picked line is the one of most confidence (none counts as 0), then of the shortest
    label (the longest, for `structure`), then by label, value and unit. A sum has the most
    frequent unit of its lines, of equally frequent ones the first.
    """
    first, second, out = [], [], []
    rows = facts.where(F.col("value").isNotNull())
    for k, s in enumerate(strategies):
        hit = F.col(f"_m{k}")
        rows = rows.withColumn(f"_m{k}", s.matches())
        if s.kind == "sum":
            first += [F.sum(F.when(hit, F.col("value"))).alias(f"_s{k}"), F.count_if(hit).alias(f"_n{k}")]
            unit = F.min(F.when((F.col(f"_n{k}") > 0) & F.col("unit").isNotNull(), F.struct(-F.col(f"_n{k}"), "unit")))["unit"]
            second += [F.sum(f"_s{k}").alias(f"_s{k}"), F.sum(f"_n{k}").alias(f"_n{k}"), unit.alias(f"_u{k}")]
            found = F.struct(F.col(f"_s{k}").alias("value"), F.col(f"_u{k}").alias("unit"), F.lit(s.name).alias("origin"), F.col(f"_n{k}").cast("long").alias("n"))
            out.append(F.when(F.col(f"_n{k}") > 0, found).alias(s.name))
        else:
            length = F.length("label") * (-1 if s.kind == "structure" else 1)
            line = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), length.alias("l"), "label", "value", F.coalesce("unit", F.lit("")).alias("unit"))
            first.append(F.min(F.when(hit, line)).alias(f"_b{k}"))
            second.append(F.min(f"_b{k}").alias(f"_b{k}"))
            best = F.col(f"_b{k}")
            found = F.struct(best["value"].alias("value"), F.nullif(best["unit"], F.lit("")).alias("unit"), F.concat(F.lit(f"{s.name}: "), best["label"]).alias("origin"), F.lit(1).cast("long").alias("n"))
            out.append(F.when(best.isNotNull(), found).alias(s.name))
    return rows.groupBy(*keys, "unit").agg(*first).groupBy(*keys).agg(*second).select(*keys, *out)


def columns_of_years(facts: DataFrame, keys: Sequence[str], years: Sequence[int], years_of: Column) -> DataFrame:
    """Per document and year the most frequent period column that names the year, then the first by name.

    A document that has period columns but none for a year has no row for it; one without
    any period column has a row with a null column, which stands for every line.
    """
    named = facts.where(F.col("period_col").isNotNull())
    counted = named.withColumn("year", F.explode(years_of)).where(F.col("year").isin(*years)).groupBy(*keys, "year", "period_col").agg(F.count("*").alias("n"))
    best = first_per_key(counted, [*keys, "year"], [-F.col("n"), F.col("period_col")]).select(*keys, "year", F.col("period_col").alias("column"))
    bare = facts.groupBy(*keys).agg(F.count("period_col").alias("n")).where("n = 0").select(*keys, F.explode(F.array(*map(F.lit, years))).alias("year"), F.lit(None).cast("string").alias("column"))
    return best.unionByName(bare)


def in_years(facts: DataFrame, keys: Sequence[str], columns: DataFrame) -> DataFrame:
    """The facts of each year, by the column that the year has in the document."""
    same = F.col("column").isNull() | (text.normalize(F.col("period_col")) == text.normalize(F.col("column")))
    return facts.join(columns, list(keys)).where(same).drop("column")


def entity_column(facts: DataFrame, keys: Sequence[str], name: Column, owner: Column) -> DataFrame:
    """The entity column of a document that stands for a name, and whether the document has none for it.

    A column that names the same entity, the first by name; else, for the document's owner, one
    of combined totals; a document without entity columns has null, and is not blocked.
    """
    seen = facts.groupBy(*keys, "entity_col").agg(F.min(name).alias("_name"), F.bool_or(owner).alias("_owner"))
    total = text.normalize(F.col("entity_col")).rlike("^(combinad|consolidad|total|soma)")
    own = F.min(F.when(text.same_entity(F.col("entity_col"), F.col("_name")), F.col("entity_col")))
    whole = F.min(F.when(F.col("_owner") & total, F.col("entity_col")))
    out = seen.groupBy(*keys).agg(F.coalesce(own, whole).alias("column"), F.count("entity_col").alias("_n"))
    return out.select(*keys, "column", ((F.col("_n") > 0) & F.col("column").isNull()).alias("blocked"))


def sum_of_year(facts: DataFrame, keys: Sequence[str], years: Sequence[int]) -> DataFrame:
    """Per document and year the sum and number of lines whose label names the year, totals and means left out.

    A label names a year in four digits, or in two after a separator and before none.
    """
    plain = text.normalize(F.col("label"))
    rows = facts.where(F.col("value").isNotNull() & ~plain.rlike("total|acumulad|media"))
    named = F.array_compact(F.array(*(F.when(plain.contains(str(y)) | plain.rlike(rf"[/. -]{y % 100:02d}($|[^0-9])"), F.lit(y)) for y in years)))
    return rows.withColumn("year", F.explode(named)).groupBy(*keys, "year").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
