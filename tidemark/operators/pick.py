"""Rows picked out of groups: current version, preferred source, mode, as-of value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in the given order, which should be total.

    The row is the least of an ordered struct, so Spark combines before it shuffles and a
    hot key costs a row a task. The order may be ascending only (negate numbers to turn it);
    nulls come last in each of its columns.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [c for k, o in enumerate(order) for c in (o.isNull().alias(f"_n{k}"), o.alias(f"_o{k}"))]
    best = F.min(F.struct(*ordered, F.struct(*rest).alias("_row"))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_best._row.{c}").alias(c) for c in rest))


def latest_version(df: DataFrame, keys: Sequence[str], version: str, value: str) -> DataFrame:
    """The value of the greatest version of each key; of equal versions the greatest value."""
    return df.groupBy(*keys).agg(F.max(F.struct(version, value)).alias("_m")).select(*keys, F.col(f"_m.{version}").alias(version), F.col(f"_m.{value}").alias(value))


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key that isn't blank; ties go to the first by order."""
    counted = df.where(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != "")).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return first_per_key(counted, keys, [-F.col("n"), F.col(value)])


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, time: str, value: str) -> DataFrame:
    """Left rows with the last right value strictly before their time (null where none).

    One union and one window over the key: no inequality join. A key's rows are sorted in
    one task, as the running value needs.
    """
    both = left.withColumn("_t", F.col(at)).withColumn("_left", F.lit(1)).unionByName(
        right.select(*keys, F.col(time).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_left")), allowMissingColumns=True
    )
    # at equal times the left row comes first, so that "before" is strict
    seen = Window.partitionBy(*keys).orderBy("_t", F.desc("_left")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(seen)).where("_left = 1").select(*left.columns, value)


def cascade(df: DataFrame, strategies: Sequence[tuple[str, Column]], value: str = "value", origin: str = "origin") -> DataFrame:
    """The first strategy that has a value, and its name."""
    out, name = F.lit(None), F.lit(None).cast("string")
    for label, c in reversed(strategies):
        out, name = F.coalesce(c, out), F.when(c.isNotNull(), F.lit(label)).otherwise(name)
    return df.withColumn(value, out).withColumn(origin, name)
