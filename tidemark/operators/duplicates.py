"""Accounts that were transcribed twice under two labels: pairs of labels with the same values.

The values of a label by column are its vector. Labels with equal vectors are one group, found
by the vector's hash, so they never meet as rows of single values; groups whose vectors differ
but share columns meet once for each pair of groups, not of labels, and stay a pair only
if every shared column agrees. Only then are pairs of labels formed, and only among labels
that some column of the documents puts into the same sub-section, as a pair has to be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Fixed value: the section of lines that could not be classified.
UNCLASSIFIED = "NAO_CLASSIFICAVEL"


def vectors(lines: DataFrame, scope: Sequence[str], section: str, label: str, columns: Sequence[str], value: str, subsection: str) -> DataFrame:
    """Per scope, section and normal label: cells (columns, value, shown label, sub-sections), by column.

    Zero and null values, null columns and sections, and columns in which a label has several
    values don't count. A label has as many cells as its scope has columns.
    """
    rows = lines.where(F.col(value).isNotNull() & (F.col(value) != 0) & F.col(section).isNotNull() & (F.col(section) != UNCLASSIFIED))
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    # lines that say the same are one row before any label is read: numbers alone are combined by hash
    at = {f"c{k}": F.col(c) for k, c in enumerate(columns)}
    same = rows.groupBy(*scope, F.col(section).alias("section"), F.col(label).alias("_label"), F.col(subsection).alias("_sub"), *(c.alias(n) for n, c in at.items())).agg(F.min(value).alias("_least"), F.max(value).alias("_most"))
    key = text.normalize(F.col("_label")).alias("key")
    sub = F.collect_set(text.normalize(F.col("_sub")))
    cells = same.groupBy(*scope, "section", key, *at).agg(F.min("_least").alias("v"), F.max("_most").alias("_most"), F.min("_label").alias("shown"), F.array_sort(sub).alias("subs")).where("v = _most")
    place = F.struct(*(f"c{k}" for k in range(len(columns)))).alias("at")
    out = cells.groupBy(*scope, "section", "key").agg(F.array_sort(F.collect_list(F.struct(place, "v", "shown", "subs"))).alias("cells"))
    vector = F.transform("cells", lambda c: F.struct(c["at"].alias("at"), c["v"].alias("v")))
    return out.withColumn("vector", vector).withColumn("sig", F.xxhash64("vector"))


def _groups_that_agree(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, section, one, two): pairs of different vectors that share columns and agree in all of them."""
    keys = [*scope, "section"]
    groups = rows.groupBy(*keys, "sig", "vector").agg(F.lit(1).alias("_")).drop("_")
    met = groups.select(*keys, "sig", "vector", F.explode("vector").alias("cell"))
    side = lambda x: met.select(*keys, "cell", F.col("sig").alias(f"sig_{x}"), F.col("vector").alias(f"vector_{x}"))
    both = side("a").join(side("b"), [*keys, "cell"]).where((F.col("sig_a") < F.col("sig_b")) | ((F.col("sig_a") == F.col("sig_b")) & (F.col("vector_a") < F.col("vector_b"))))
    shared = F.array_intersect("vector_a", "vector_b")
    at = lambda v: F.transform(v, lambda c: c["at"])
    agree = F.size(shared) == F.size(F.array_intersect(at(F.col("vector_a")), at(F.col("vector_b"))))
    # they meet in every column that they share: the first one stands for all
    return both.where((F.array_min(shared) == F.col("cell")) & agree).select(*keys, "sig_a", "vector_a", "sig_b", "vector_b")


def pairs(lines: DataFrame, scope: Sequence[str], section: str, label: str, columns: Sequence[str], value: str, subsection: str, least_columns: int = 2) -> DataFrame:
    """scope, section, label_a, label_b, n_columns, value, common_radical of the suspected pairs.

    Two labels of a section are a pair if their values are equal in every column that they share,
    some shared column has them in the same sub-section, none names one as the sub-section of
    the other (a subtotal of one line), and they share `least_columns` columns, or one, where the
    documents tell sub-sections and the structural tokens of one label are within the other's.
    The lines should be accounts of current versions. The label shown is the first by name.
    """
    rows = vectors(lines, scope, section, label, columns, value, subsection)
    keys = [*scope, "section"]
    member = rows.select(*keys, "sig", "vector", "key", "cells", F.explode(F.array_distinct(F.flatten(F.transform("cells", lambda c: c["subs"])))).alias("sub"))
    side = lambda x: member.select(*keys, "sub", F.col("sig").alias(f"sig_{x}"), F.col("vector").alias(f"vector_{x}"), F.col("key").alias(f"key_{x}"), F.col("cells").alias(f"cells_{x}"))
    a, b = side("a"), side("b")
    same = a.join(b.withColumnsRenamed({"sig_b": "sig_a", "vector_b": "vector_a"}), [*keys, "sub", "sig_a", "vector_a"]).where("key_a < key_b").select(*keys, "sub", "key_a", "cells_a", "key_b", "cells_b")
    apart = _groups_that_agree(rows, scope).join(a, [*keys, "sig_a", "vector_a"]).join(b, [*keys, "sub", "sig_b", "vector_b"]).where("key_a <> key_b")
    turned = lambda x, y: [F.when(F.col("key_a") < F.col("key_b"), F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for c in ("key", "cells")]
    met = same.unionByName(apart.select(*keys, "sub", *turned("a", "b"), *turned("b", "a")))
    found = met.withColumns(_evidence()).where("same_sub and not subtotal_of").where((F.col("n_columns") >= least_columns) | (F.col("has_sub") & F.col("common_radical")))
    # labels meet in every sub-section that both have: the first one stands for all
    names = lambda x: F.flatten(F.transform(x, lambda c: c["subs"]))
    found = found.where(F.array_min(F.array_intersect(names(F.col("cells_a")), names(F.col("cells_b")))) == F.col("sub"))
    return found.select(*keys, "label_a", "label_b", "n_columns", "value", "common_radical")


def _evidence() -> dict[str, Column]:
    a, b = F.col("cells_a"), F.col("cells_b")
    other = lambda x, cells: F.filter(cells, lambda y: y["at"] == x["at"])
    # cells of both labels in a column that they share
    both = F.filter(F.transform(a, lambda x: F.struct(x.alias("x"), F.get(other(x, b), 0).alias("y"))), lambda p: p["y"].isNotNull())
    shown = lambda side: F.array_min(F.transform(both, lambda p: p[side]["shown"]))
    told = lambda subs: F.exists(subs, lambda s: s != "")
    tokens_a, tokens_b = (text.structural_tokens(shown(s)) for s in ("x", "y"))
    within = lambda p, q: F.size(F.array_except(p, q)) == 0
    return {
        "label_a": shown("x"), "label_b": shown("y"), "n_columns": F.size(both).cast("long"), "value": F.array_max(F.transform(both, lambda p: F.abs(p["x"]["v"]))),
        "same_sub": F.exists(both, lambda p: F.arrays_overlap(p["x"]["subs"], p["y"]["subs"])),
        "subtotal_of": F.exists(both, lambda p: F.array_contains(p["y"]["subs"], F.col("key_a")) | F.array_contains(p["x"]["subs"], F.col("key_b"))),
        "has_sub": F.exists(both, lambda p: told(p["x"]["subs"]) | told(p["y"]["subs"])), "common_radical": within(tokens_a, tokens_b) | within(tokens_b, tokens_a),
    }


def reconciled(found: DataFrame, targets: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Per target scope: verdict (ok, or divergent where pairs were found), their number and the sum that is counted twice."""
    sums = found.groupBy(*scope).agg(F.count("*").alias("n_pairs"), F.sum("value").alias("doubled"))
    out = targets.select(*scope).distinct().join(sums, list(scope), "left")
    return out.select(*scope, F.when(F.col("n_pairs").isNull(), "ok").otherwise("divergent").alias("verdict"), F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"), F.coalesce("doubled", F.lit(0)).alias("doubled"))
