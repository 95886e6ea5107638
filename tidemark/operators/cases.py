"""Operators of cases: completeness, roles of labels, registration, assumptions and their links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def completeness(cases: DataFrame, wanted: DataFrame, documents: DataFrame, lines: DataFrame, key: str, kind: str, doc: str) -> DataFrame:
    """Per case: the wanted kinds that are missing, those received but without a line, and the status.

    A kind counts as received with content when any of its documents has a line. Status is
    complete, empty (all received, some without content) or missing.
    """
    full = documents.join(lines.select(doc).distinct(), doc, "left_semi").select(key, kind).distinct().withColumn("_full", F.lit(True))
    had = documents.select(key, kind).distinct().withColumn("_had", F.lit(True))
    asked = cases.select(key).distinct().join(F.broadcast(wanted.select(kind)))
    state = asked.join(had, [key, kind], "left").join(full, [key, kind], "left")
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(kind))))  # noqa: E731  as many as kinds are wanted
    out = state.groupBy(key).agg(listed(F.col("_had").isNull()).alias("missing"), listed(F.col("_had") & F.col("_full").isNull()).alias("empty"))
    return out.withColumn("status", F.when(F.size("missing") > 0, "missing").when(F.size("empty") > 0, "empty").otherwise("complete"))


def set_completeness(wanted: Column, received: Column) -> tuple[Column, Column, Column]:
    """(missing, present, complete) of two arrays of kinds."""
    missing = F.array_sort(F.array_except(wanted, received))
    return missing, F.array_sort(F.array_intersect(wanted, received)), F.size(missing) == 0


def role_of_labels(df: DataFrame, key: str, section: str, label: str, role: Column, priority: Column) -> DataFrame:
    """Per case, section and label the role of least priority; in no section, that across sections.

    A null section takes the role that the label has in any section of the case.
    """
    one = df.select(key, section, label, F.struct(priority.alias("p"), role.alias("r")).alias("_r"))
    across = one.groupBy(key, label).agg(F.min("_r").alias("_any"))
    within = one.groupBy(key, section, label).agg(F.min("_r").alias("_own"))
    same = F.col(f"w.{key}").eqNullSafe(F.col(f"a.{key}")) & F.col(f"w.{label}").eqNullSafe(F.col(f"a.{label}"))
    both = within.alias("w").join(across.alias("a"), same)
    return both.select(f"w.{key}", f"w.{section}", f"w.{label}", F.when(F.col(f"w.{section}").isNull(), F.col("_any.r")).otherwise(F.col("_own.r")).alias("role"))


def registered(documents: DataFrame, key: str, digest: str, at: Sequence[Column], doc: str, human: Column, replaced: Sequence[str] = (), filled: Sequence[str] = ()) -> DataFrame:
    """Every sending of a case with its document, its version of it, and the document's fields after it.

    Sendings with the same digest are versions of one document, in order; null and blank digests
    match nothing, so each is a document of its own. A new version sets the fields `replaced`, and
    `filled` where it has a value, until a sending by a human: nothing later changes what that set.
    """
    content = F.coalesce(F.concat(F.lit("="), F.nullif(F.trim(digest), F.lit(""))), F.concat(F.lit("#"), F.col(doc).cast("string")))
    rows = documents.withColumn("_content", content).withColumn("_human", F.coalesce(human, F.lit(False)))
    group = Window.partitionBy(key, "_content").orderBy(*at, doc)
    upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = F.struct(*replaced, *(F.last(c, ignorenulls=True).over(upto).alias(c) for c in filled))
    rows = rows.withColumn("version", F.row_number().over(group)).withColumn("document", F.first(doc).over(upto)).withColumn("_told", told)
    rows = rows.withColumn("_set", F.first(F.when(F.col("_human"), F.col("_told")), ignorenulls=True).over(upto))
    fields = [F.when(F.col("_set").isNotNull(), F.col(f"_set.{c}")).otherwise(F.col(f"_told.{c}")).alias(c) for c in (*replaced, *filled)]
    return rows.select(key, digest, doc, "document", "version", (F.col("version") > 1).alias("repeated"), *fields)


def accepted(df: DataFrame, dial: Column, confidence: Column, limit: Column, flagged: Column, by_human: Column) -> DataFrame:
    """Whether a field is accepted by itself: the dial allows it, it is sure enough, nothing flags it, no human has set it."""
    return df.withColumn("auto_accepted", F.coalesce(dial.isin("N2", "N3") & (confidence >= limit) & ~flagged & ~by_human, F.lit(False)))


def agreement(df: DataFrame, keys: Sequence[str], eligible: Column, value: Column, truth: Column, within: float = 1.0) -> DataFrame:
    """Per key the share of eligible fields that agree with the key's truth, and that can't be checked."""
    checkable = eligible & truth.isNotNull()
    agree = checkable & (F.abs(value - truth) <= within)
    share = lambda a, b: F.when(F.count_if(b) > 0, F.count_if(a) / F.count_if(b))
    return df.groupBy(*keys).agg(F.count_if(eligible).alias("eligible"), share(agree, checkable).alias("agreement"), share(eligible & truth.isNull(), eligible).alias("uncheckable"))


def suggested(catalog: DataFrame, cases: DataFrame, key: str, sector: str, sectors: str, active: str) -> DataFrame:
    """The active catalogue entries of each case's sector; entries without sectors are for all."""
    fits = (F.size(sectors) == 0) | F.array_contains(F.col(sectors), F.col(sector))
    return cases.select(key, sector).join(F.broadcast(catalog.where(F.col(active))), fits)


def deactivated(links: DataFrame, gone: DataFrame, key: str, parent: str) -> DataFrame:
    """Links with `active`: those of deactivated parents are off with them."""
    off = gone.select(F.col(key).alias(parent)).distinct().withColumn("_off", F.lit(True))
    return links.join(off, parent, "left").withColumn("active", F.col("_off").isNull()).drop("_off")


def linked(lines: DataFrame, assumptions: DataFrame, keys: Sequence[str], role: str, allowed: Sequence[str]) -> DataFrame:
    """Lines of allowed roles with their section's assumption; one without is an orphan."""
    usable = lines.where(F.col(role).isin(*allowed))
    return usable.join(assumptions, list(keys), "left")
