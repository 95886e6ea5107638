"""Changes by people with their history: reviews of documents, and levels of autonomy under a ceiling.

A history has a row a request, with the values before and after it, as if requests came one after
another; the present state is the last row's. The requests of one document, or of one stage, are
sorted in one task: they are what people did by hand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pick import first_per_key

#: Issues about what a document is, which a review of it closes.
ABOUT_DOCUMENTS = ("unclassified", "wrong_kind", "wrong_entity", "wrong_period")


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _ids(asked: DataFrame, known: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """The distinct keys asked for with an id: the least known one, else one that follows from the keys."""
    had = known.groupBy(*keys).agg(F.min(out).alias(out))
    made = F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)), 256)
    return asked.select(*keys).distinct().join(had, list(keys), "left").select(*keys, F.coalesce(out, made).alias(out), F.col(out).isNull().alias(f"{out}_created"))


def reviewed(documents: DataFrame, reviews: DataFrame, entities: DataFrame, periods: DataFrame) -> DataFrame:
    """The history of reviews: a row a review of a document that is known, others fall away.

    documents: document, case_id, kind, entity_id, period_id, reason; reviews: document, at, author
    (unique together), kind, entity_name, period_kind, period_ref, reason; entities: case_id,
    entity_id, name; periods: case_id, period_id, period_kind, period_ref (ids are strings). What a
    review leaves null stays, and so do a blank entity name and period. An entity is found in its
    case by its name in any case of letters, a period by kind (none: other) and reference; those
    that aren't there get ids that follow from them. decision: correction if the kind changed, else
    approval.
    """
    docs = documents.select("document", "case_id", *(F.col(c).alias(f"_{c}") for c in ("kind", "entity_id", "period_id", "reason")))
    rows = reviews.join(docs, "document").withColumn("_name", F.lower(_given(F.col("entity_name"))))
    rows = rows.withColumn("period_ref", F.when(_given(F.col("period_ref")).isNotNull(), F.col("period_ref"))).withColumn("period_kind", F.coalesce("period_kind", F.lit("other")))
    named = entities.select("case_id", F.lower(_given(F.col("name"))).alias("_name"), "entity_id").where("_name is not null")
    rows = rows.join(_ids(rows.where("_name is not null"), named, ["case_id", "_name"], "entity_id"), ["case_id", "_name"], "left")
    rows = rows.join(_ids(rows.where("period_ref is not null"), periods, ["case_id", "period_kind", "period_ref"], "period_id"), ["case_id", "period_kind", "period_ref"], "left")
    turn = Window.partitionBy("document").orderBy("at", "author")
    before, upto = turn.rowsBetween(Window.unboundedPreceding, -1), turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = lambda c, w: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_{c}"))
    fields = ("kind", "entity_id", "period_id", "reason")
    rows = rows.select("document", "case_id", "at", "author", *(value(c, before).alias(f"{c}_before") for c in fields), *(value(c, upto).alias(f"{c}_after") for c in fields))
    return rows.withColumn("decision", F.when(F.col("kind_before").eqNullSafe(F.col("kind_after")), "approval").otherwise("correction"))


def after_reviews(documents: DataFrame, history: DataFrame) -> DataFrame:
    """The documents as their last reviews left them: certain, and set by a human.

    documents as for `reviewed`, with confidence (double) and source, which nothing but a review makes human.
    """
    fields = ("kind", "entity_id", "period_id", "reason")
    last = history.groupBy("document").agg(F.max_by(F.struct(*(F.col(f"{c}_after").alias(c) for c in fields)), F.struct("at", "author")).alias("_last"))
    was = F.col("_last").isNotNull()
    told = {c: F.when(was, F.col(f"_last.{c}")).otherwise(F.col(c)) for c in fields}
    told |= {"confidence": F.when(was, 1.0).otherwise(F.col("confidence")), "source": F.when(was, "human").otherwise(F.col("source"))}
    return documents.join(last, "document", "left").withColumns(told).select(*documents.columns)


def after_machine(documents: DataFrame, found: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The documents with what a machine found in place of theirs, where it found something and no human has set them."""
    got = found.select("document", *(F.col(c).alias(f"_{c}") for c in fields))
    free = ~F.col("source").eqNullSafe("human")
    told = {c: F.when(free, F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)) for c in fields}
    return documents.join(got, "document", "left").withColumns(told).select(*documents.columns)


def issues_closed(issues: DataFrame, history: DataFrame, kinds: Sequence[str] = ABOUT_DOCUMENTS) -> DataFrame:
    """The issues with state and resolved_by: open ones about a document are resolved by its first review.

    issues: document, kind, state, resolved_by. Resolved ones and those of other kinds stay as they are.
    """
    first = history.groupBy("document").agg(F.min_by("author", F.struct("at", "author")).alias("_by"))
    closes = F.col("_by").isNotNull() & (F.col("state") != "resolved") & F.col("kind").isin(*kinds)
    told = {"resolved_by": F.when(closes, F.col("_by")).otherwise(F.col("resolved_by")), "state": F.when(closes, "resolved").otherwise(F.col("state"))}
    return issues.join(first, "document", "left").withColumns(told).select(*issues.columns)


def dials_moved(dials: DataFrame, requests: DataFrame) -> DataFrame:
    """The history of requests to move a stage's level: before, after and outcome.

    dials: stage, level, ceiling, threshold; requests: stage, at, author (unique together), level,
    threshold. Levels are ordered as texts. outcome: unknown for a stage that isn't there; refused
    above its ceiling or without a level; else moved, where a threshold that is null stays.
    """
    rows = requests.join(dials.select("stage", F.col("level").alias("_level"), "ceiling", F.col("threshold").alias("_threshold")), "stage", "left")
    outcome = F.when(F.col("ceiling").isNull(), "unknown").when(F.coalesce(F.col("level") <= F.col("ceiling"), F.lit(False)), "moved").otherwise("refused")
    rows = rows.withColumn("outcome", outcome)
    turn = Window.partitionBy("stage").orderBy("at", "author")
    before, upto = turn.rowsBetween(Window.unboundedPreceding, -1), turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = lambda c, w: F.coalesce(F.last(F.when(F.col("outcome") == "moved", F.col(c)), ignorenulls=True).over(w), F.col(f"_{c}"))
    return rows.select("stage", "at", "author", F.col("level").alias("asked"), "outcome", *(value(c, w).alias(f"{c}_{when}") for when, w in (("before", before), ("after", upto)) for c in ("level", "threshold")))


def after_moves(dials: DataFrame, history: DataFrame) -> DataFrame:
    """The dials as the last request left them."""
    last = history.where("outcome = 'moved'").groupBy("stage").agg(F.max_by(F.struct("level_after", "threshold_after"), F.struct("at", "author")).alias("_last"))
    told = {"level": F.coalesce("_last.level_after", "level"), "threshold": F.when(F.col("_last").isNotNull(), F.col("_last.threshold_after")).otherwise(F.col("threshold"))}
    return dials.join(last, "stage", "left").withColumns(told).select(*dials.columns)


def diagnosed(documents: DataFrame, diagnoses: DataFrame, differs_in_time: Column) -> DataFrame:
    """document, case_id, version, kind, fires: what a diagnosis of its content says against a document.

    documents: document, case_id, kind, entity_name, period_ref; diagnoses: document, version, confirms
    (of the kind), found_kind, found_entity, found_period, legibility. differs_in_time compares
    period_ref and found_period, see `period.equivalent`. A name that is blank says nothing, one
    that the document lacks is no issue; the other kinds are said in every diagnosis. The rows go to `registration.issues`.
    """
    rows = diagnoses.join(documents.select("document", "case_id", "kind", "entity_name", "period_ref"), "document")
    name = _given(F.col("found_entity"))
    verdicts = {
        "wrong_entity": F.when(name.isNotNull() & F.col("entity_name").isNotNull(), F.lower(F.trim("entity_name")) != F.lower(name)),
        "wrong_kind": ~F.coalesce("confirms", F.lit(True)) | (F.col("found_kind").isNotNull() & ~F.col("found_kind").eqNullSafe(F.col("kind"))),
        "wrong_period": F.col("found_period").isNotNull() & differs_in_time,
        "illegible": F.coalesce(F.col("legibility") == "illegible", F.lit(False)),
    }
    told = F.array(*(F.struct(F.lit(k).alias("kind"), f.alias("fires")) for k, f in verdicts.items()))
    return rows.select("document", "case_id", "version", F.explode(told).alias("_t")).select("document", "case_id", "version", "_t.kind", "_t.fires").where("fires is not null")
