"""Joins by likeness: names of the same entity, periods that share a year; match or create.

Neither compares all with all. Of two names that are the same entity every word of the shorter
begins a word of the longer, so a name is looked up by its rarest word among the beginnings of the
words of all names. Periods meet in the lists of their years; those without a year meet every one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import period, text
from .pick import first_per_key

#: Letters that one word of a shorter name has at least (see text.same_entity).
LONG_WORD = 4


def _names(df: DataFrame, scope: Sequence[str], name: str) -> DataFrame:
    return df.select(*scope, F.col(name).alias("name"), text.canonical_entity(F.col(name)).alias("plain")).where("plain is not null").distinct()


def _looked_up(names: DataFrame, among: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, name, other): pairs of which the first name, the shorter one, is the same entity as the other."""
    words = F.filter(F.split("plain", " "), lambda w: F.length(w) >= LONG_WORD)
    begins = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(LONG_WORD), F.length(w)), lambda n: F.left(w, n))))
    index = among.select(*scope, F.col("name").alias("other"), F.col("plain").alias("other_plain"), F.explode(F.array_distinct(begins)).alias("word"))
    known = index.groupBy(*scope, "word").agg(F.count("*").alias("n"))
    # a word that no other name begins with rules the name out
    asked = names.select(*scope, "name", "plain", F.explode(F.array_distinct(words)).alias("word")).join(known, [*scope, "word"], "left")
    rarest = first_per_key(asked.withColumn("n", F.coalesce("n", F.lit(0))), [*scope, "name", "plain"], [F.col("n"), F.col("word")])
    met = rarest.where("n > 0").join(index, [*scope, "word"]).where((F.length("plain") < F.length("other_plain")) & text.same_entity(F.col("name"), F.col("other")))
    return met.select(*scope, "name", "other")


def same_entities(left: DataFrame, right: DataFrame, scope: Sequence[str], left_name: str, right_name: str) -> DataFrame:
    """scope, left_name, right_name: the distinct pairs of names of a scope that are the same entity.

    Null names and names without letters or digits are nobody's; scopes are compared as joins do.
    """
    a, b = _names(left, scope, left_name), _names(right, scope, right_name)
    equal = a.join(b.withColumnsRenamed({"name": "other"}), [*scope, "plain"]).select(*scope, "name", "other")
    longer = _looked_up(b, a, scope).select(*scope, F.col("other").alias("name"), F.col("name").alias("other"))
    pairs = equal.unionByName(_looked_up(a, b, scope)).unionByName(longer)
    return pairs.select(*scope, F.col("name").alias(left_name), F.col("other").alias(right_name))


def _cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage where the session has a folder for checkpoints, else kept."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def upserted(entities: DataFrame, batch: DataFrame, scope: Sequence[str], name: str, order: Sequence[Column], entity_id: str = "entity_id") -> DataFrame:
    """Per distinct name of the batch: the entity's id and name, and whether it was created.

    entities: scope, entity_id (string), name. As if names came one after another in the given order,
    a name takes the entity that is the same, of several the first by name, and makes one where
    there is none; later names find that too. Ids of new entities follow from scope and name,
    so that a rerun makes the same ones. Null and empty names have no entity.
    """
    keys = [*scope, name]
    first = batch.where(text.canonical_entity(F.col(name)).isNotNull()).groupBy(*keys).agg(F.min(F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), F.col(name).alias("name"))).alias("at"))
    first = _cut(first)
    had = entities.select(*scope, entity_id, F.col(name).alias("_had"))
    known = same_entities(first, had, scope, name, "_had").join(had, [*scope, "_had"])
    found = first_per_key(known.select(*keys, "_had", entity_id), keys, [F.col("_had"), F.col(entity_id)])
    open_names = _cut(first.join(found.select(*keys), keys, "left_anti"))
    # among new names: each with the earlier ones that it is the same as
    other = open_names.select(*scope, F.col(name).alias("_other"), F.col("at").alias("_at"))
    links = same_entities(open_names, other, scope, name, "_other").join(open_names, keys).join(other, [*scope, "_other"])
    links = _cut(links.where("_at < at").select(*keys, "_other"))
    made, waiting = None, open_names.select(*keys)
    while True:
        # a name makes an entity once every earlier one that it is the same as has found another
        ahead = links.join(waiting.withColumnRenamed(name, "_other"), [*scope, "_other"], "left_semi")
        new = waiting.join(ahead.select(*keys).distinct(), keys, "left_anti")
        made = _cut(new if made is None else made.unionByName(new))
        taken = links.join(made.withColumnRenamed(name, "_other"), [*scope, "_other"], "left_semi").select(*keys).distinct()
        waiting = _cut(waiting.join(made, keys, "left_anti").join(taken, keys, "left_anti"))
        if waiting.isEmpty():
            break
    new_id = lambda n: F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(s).cast("string"), F.lit("")) for s in scope), n), 256)
    follows = links.join(made.withColumnRenamed(name, "_other"), [*scope, "_other"], "left_semi")
    joined = first_per_key(follows, keys, [F.col("_other")])
    out = made.select(*keys, new_id(F.col(name)).alias(entity_id), F.col(name).alias("entity_name"), F.lit(True).alias("created"))
    out = out.unionByName(joined.join(made, keys, "left_anti").select(*keys, new_id(F.col("_other")).alias(entity_id), F.col("_other").alias("entity_name"), F.lit(False).alias("created")))
    return out.unionByName(found.select(*keys, entity_id, F.col("_had").alias("entity_name"), F.lit(False).alias("created")))


def overlapping(left: DataFrame, right: DataFrame, scope: Sequence[str], left_ref: str, right_ref: str) -> DataFrame:
    """The rows of both sides whose periods are compatible: they share a year, or one names none.

    The sides' other columns should have different names. A pair that shares several years is
    taken in the first of them, so rows need not be made distinct.
    """
    a = left.withColumn("_ya", period.years(F.col(left_ref)))
    b = right.withColumn("_yb", period.years(F.col(right_ref)))
    dated, undated = (lambda df, y: df.where(F.size(y) > 0)), (lambda df, y: df.where(F.size(y) == 0))
    met = dated(a, "_ya").withColumn("_year", F.explode("_ya")).join(dated(b, "_yb").withColumn("_year", F.explode("_yb")), [*scope, "_year"])
    met = met.where(F.col("_year") == F.array_min(F.array_intersect("_ya", "_yb"))).drop("_year")
    every = undated(a, "_ya").join(b, list(scope)).unionByName(dated(a, "_ya").join(undated(b, "_yb"), list(scope)))
    return met.unionByName(every).drop("_ya", "_yb")
