"""Keyed merges that know what they inserted, updated and left alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The merged rows with `action`: insert, update (a value changed), noop or kept.

    Keys are compared null-safely. A key that the batch holds more than once takes the
    greatest values.
    """
    batch = new.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_new"))
    had = old.select(*keys, F.struct(*values).alias("_old"))
    left, right = had.alias("o"), batch.alias("n")
    on = None
    for k in keys:
        same = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = same if on is None else on & same
    both = left.join(right, on, "full_outer")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "kept").when(F.col("_old").eqNullSafe(F.col("_new")), "noop").otherwise("update")
    return both.select(
        *(F.when(F.col("_old").isNull(), F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in keys),
        *(F.coalesce(F.col("_new"), F.col("_old"))[v].alias(v) for v in values),
        action.alias("action"),
    )


def counts(merged: DataFrame) -> DataFrame:
    """Rows by action."""
    return merged.groupBy("action").agg(F.count("*").alias("n"))


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The old rows and those new ones whose key they don't have."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def settle(issues: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Open issues against those found now: opened, refreshed or resolved."""
    a, b = issues.select(*keys).distinct().withColumn("_had", F.lit(True)), found.select(*keys).distinct().withColumn("_has", F.lit(True))
    state = F.when(F.col("_had").isNull(), "opened").when(F.col("_has").isNull(), "resolved").otherwise("refreshed")
    return a.join(b, list(keys), "full_outer").select(*keys, state.alias("state"))
