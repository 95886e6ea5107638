"""Connected components of a link table, in Spark, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches, itself included.

    links has columns a and b. Alternates a large-star and a small-star step (Kiveris et
    al., 2014) until the links stay the same; a round moves at most as many rows as there
    are links, and a hub's links are grouped by aggregation, never gathered in a list.
    Nodes without a link are not returned.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    edges = scratch.save(edges, f"{name}_0")
    state, turn = None, 0
    while True:
        # large star: every larger neighbour of a node is linked with its smallest neighbour
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # small star: every smaller neighbour of a node, and itself, with the smallest
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = small.union(low.select("hi", F.col("m").alias("lo"))).distinct()
        turn += 1
        new = scratch.save(after, f"{name}_{turn}")
        row = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("h"), F.sum("lo").alias("s")).first()
        scratch.drop(f"{name}_{turn - 1}")
        edges = new
        if state == row:
            break
        state = row
    # the fixed point is a set of stars around the smallest nodes
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
