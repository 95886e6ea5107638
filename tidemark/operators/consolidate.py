"""Groups of entities: sections summed, balances closed by a plug, liabilities scaled, combined statements, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_entity

# Sections of a balance sheet (current and other assets, current and other liabilities, equity).
ASSETS, LIABILITIES, EQUITY = ("AC", "ANC"), ("PC", "PNC"), "PL"


def section_sums(df: DataFrame, keys: Sequence[str], section: str, value: str) -> DataFrame:
    """Per key one column a section with the sum of its lines, 0 where it has none."""
    part = lambda s: F.coalesce(F.sum(F.when(F.col(section) == s, F.col(value))), F.lit(0)).alias(s)
    return df.groupBy(*keys).agg(*(part(s) for s in (*ASSETS, *LIABILITIES, EQUITY)))


def closed(sums: DataFrame) -> DataFrame:
    """Section sums with assets, liabilities, equity = assets - liabilities and the plug that equity lacks."""
    out = sums.withColumn("assets", F.col("AC") + F.col("ANC")).withColumn("liabilities", F.col("PC") + F.col("PNC"))
    out = out.withColumn("equity", F.col("assets") - F.col("liabilities")).withColumn("plug", F.col("equity") - F.col(EQUITY))
    return out.withColumn("plug_kind", F.when(F.col("plug") < 0, "accumulated_loss").otherwise("accumulated_profit"))


def scaled_to_equity(df: DataFrame, keys: Sequence[str], section: str, value: str, target: Column) -> DataFrame:
    """The lines with those of liabilities scaled so that equity comes to the target, composition kept.

    Scaled values are rounded to whole numbers, half to even. Where liabilities are not
    positive, now or as they would have to be, nothing changes. target is a function of the keys.
    """
    sums = closed(section_sums(df, keys, section, value))
    wanted = F.col("assets") - target
    factor = F.when((F.col("liabilities") > 0) & (wanted > 0), wanted.cast("double") / F.col("liabilities"))
    sums = sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), factor.alias("_factor"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    scaled = F.when(F.col(section).isin(*LIABILITIES) & F.col("_factor").isNotNull(), F.bround(F.col(value) * F.col("_factor"), 0)).otherwise(F.col(value).cast("double"))
    return df.join(sums, same, "left").withColumn(value, scaled).drop("_factor", *(f"_k_{k}" for k in keys))


def combined(entities: DataFrame, keys: Sequence[str], holding: Column, share: Column, intragroup: Column) -> DataFrame:
    """One row a group from closed entities: sums, eliminations, equity with the minority's part, and the gap.

    share is the part of an entity that the holding owns (null for the holding and for entities
    that it does not own). Its investments (positive parts of equity) and provisions (negative
    ones) leave the sums, as do the intragroup balances, once on each side; the minority has
    what the holding does not own of equities. gap is 0 where the statement closes.
    """
    owned = F.bround(share * F.col("equity"), 0)
    minority = F.bround(F.when(share < 1, (1 - share) * F.col("equity")), 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    g = entities.groupBy(*keys).agg(
        total(F.col("assets")).alias("sum_assets"), total(F.col("liabilities")).alias("sum_liabilities"),
        total(F.greatest(F.lit(0.0), owned)).alias("investments"), total(-F.least(F.lit(0.0), owned)).alias("provisions"),
        total(intragroup).alias("intragroup"), total(F.when(holding, F.col("equity"))).alias("holding_equity"), total(minority).alias("minority"),
    )
    g = g.withColumn("assets", F.col("sum_assets") - F.col("investments") - F.col("intragroup"))
    g = g.withColumn("liabilities", F.col("sum_liabilities") - F.col("provisions") - F.col("intragroup"))
    return g.withColumn("equity", F.col("holding_equity") + F.col("minority")).withColumn("gap", F.col("assets") - F.col("liabilities") - F.col("equity"))


def informed_totals(df: DataFrame, keys: Sequence[str], label: str, subsection: str, value: str, informed: Column) -> DataFrame:
    """Per key its leaves' sum, the total that the document informs, the one shown and their difference.

    A line whose label names a subsection of the same key is a subtotal, no leaf. informed
    holds the total on any line of the key (the greatest counts); it is shown where there is one.
    """
    names = df.where(F.col(subsection).isNotNull()).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(subsection).alias("_sub")).distinct()
    same = F.col(label) == F.col("_sub")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    marked = df.withColumn("_informed", informed).join(names, same, "left")
    out = marked.groupBy(*keys).agg(F.sum(F.when(F.col("_sub").isNull(), F.col(value))).alias("own_sum"), F.max("_informed").alias("informed"))
    return out.withColumn("total", F.coalesce("informed", "own_sum")).withColumn("difference", F.col("informed") - F.col("own_sum"))


def inherited_sections(df: DataFrame, keys: Sequence[str], section: str) -> DataFrame:
    """Lines without a section take that of their siblings (the other lines of the keys) where all agree.

    `inherited` tells them apart. Siblings that disagree, or of which none has a section, give none.
    """
    agreed = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.when(F.min(section) == F.max(section), F.min(section)).alias("_agreed"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = df.join(agreed, same, "left").withColumn("inherited", F.col(section).isNull() & F.col("_agreed").isNotNull())
    return out.withColumn(section, F.coalesce(section, "_agreed")).drop("_agreed", *(f"_k{i}" for i in range(len(keys))))


def whole_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """The distinct names of a case with the whole name that each stands for.

    A canonical name that is the beginning, by whole words, of exactly one other name of the
    case stands for that one; where several begin with it, or none, it stands for itself.
    Names join on what they begin with, so no two names are compared. Null names fall away.
    """
    names = df.select(F.col(key), canonical_entity(F.col(name)).alias("entity")).where("entity is not null").distinct()
    tokens = F.split("entity", " ")
    begins = names.where(F.size(tokens) > 1).select(F.col(key), F.col("entity").alias("_whole"), F.explode(F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda n: F.array_join(F.slice(tokens, F.lit(1), n), " "))).alias("entity"))
    only = begins.groupBy(key, "entity").agg(F.when(F.count("*") == 1, F.min("_whole")).alias("_whole"))
    return names.join(only, [key, "entity"], "left").select(key, "entity", F.coalesce("_whole", "entity").alias("stands_for"))
