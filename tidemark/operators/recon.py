"""Tolerances, guards, gates, completeness; pairs of labels are in `duplicates`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(a: Column, b: Column, absolute: float, relative: float, differs: str = "divergent", unmet: str = "unmet") -> Column:
    """ok, `differs`, or `unmet` where a side is missing; the tolerance follows side a."""
    gap = F.abs(a - b).cast("double")
    return F.when(a.isNull() | b.isNull(), unmet).when(gap > F.greatest(F.lit(float(absolute)), F.abs(a).cast("double") * relative), differs).otherwise("ok")


def repeated_values(df: DataFrame, keys: Sequence[str], value: str, label: str, least: int = 4, part: float = 0.01, floor: float = 1.0) -> DataFrame:
    """Per key the material value that most different labels repeat.

    Material is at least `floor` and `part` of the key's largest absolute value; suspicious
    from `least` labels on. Ties go to the larger absolute, then the larger value.
    """
    top = df.groupBy(*keys).agg(F.max(F.abs(value)).alias("_top"))
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_distinct(label).alias("n_labels")).join(top, list(keys))
    material = counted.where(F.abs(value) >= F.greatest(F.col("_top") * part, F.lit(floor)))
    best = material.groupBy(*keys).agg(F.max(F.struct("n_labels", F.abs(value).alias("_a"), F.col(value).alias("_v"))).alias("_m"))
    return best.select(*keys, F.col("_m._v").alias(value), F.col("_m.n_labels").alias("n_labels"), (F.col("_m.n_labels") >= least).alias("suspicious"))


def low_confidence(df: DataFrame, keys: Sequence[str], score: str, below: float = 0.7, least: int = 3, part: float = 0.3) -> DataFrame:
    """Per key the rows of low confidence, and whether they are too many."""
    n_low = F.count_if(F.col(score) < below)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), n_low.alias("n_low")).withColumn("too_low", (F.col("n_low") >= least) & (F.col("n_low") / F.col("n") >= part))


def missing(wanted: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """The wanted keys that are not present."""
    return wanted.join(present.select(*on), list(on), "left_anti")


def gate(limits: Sequence[tuple[str, Column, Column]]) -> tuple[Column, Column]:
    """(passes, reasons): a condition that each counted figure is within its limit."""
    reasons = F.array_compact(F.array(*(F.when(figure > limit, F.lit(name)) for name, figure, limit in limits)))
    return F.size(reasons) == 0, reasons
