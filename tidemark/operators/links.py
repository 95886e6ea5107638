"""Lines linked to the assumptions that project them: requests with reasons of refusal, whole sections, removals.

A link is case_id, section, label (normal form), entity, assumption, seasonality; the first and the
three after it are its key, null and empty being the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Fixed value: the role of a line that an assumption may project.
ACCOUNT = "conta"
KEY = ("case_id", "section", "label", "entity")


def _with_active(rows: DataFrame, assumptions: DataFrame) -> DataFrame:
    """The rows with the codes that are active in their case, as many as the catalogue has at most."""
    codes = assumptions.where("active").groupBy("case_id").agg(F.collect_set("code").alias("_codes"))
    return rows.join(codes, "case_id", "left")


def _is_active(code: Column) -> Column:
    return F.coalesce(F.array_contains("_codes", code), F.lit(False))


def outcomes(requests: DataFrame, roles: DataFrame, assumptions: DataFrame) -> DataFrame:
    """The requests, labels in their normal form, with role and outcome.

    requests: a link's columns and at, author; roles: case_id, section, label, role, unique together
    but for the role (see `cases.role_of_labels`), labels in any form; assumptions: case_id, code,
    active. outcome: not_an_account (an assumption for a label that has another role in its section),
    assumption_inactive, seasonality_inactive, else linked. A request without assumption unlinks and
    is refused for neither role nor assumption; a label without role is taken.
    """
    known = roles.select("case_id", F.coalesce("section", F.lit("")).alias("_section"), text.normalize(F.col("label")).alias("label"), "role")
    known = known.groupBy("case_id", "_section", "label").agg(F.max(F.when(F.col("role") != ACCOUNT, F.col("role"))).alias("_other"), F.max("role").alias("_role")).select("case_id", "_section", "label", F.coalesce("_other", "_role").alias("role"))
    rows = requests.withColumn("label", text.normalize(F.col("label"))).withColumn("_section", F.coalesce("section", F.lit("")))
    rows = _with_active(rows.join(known, ["case_id", "_section", "label"], "left"), assumptions)
    asks = F.col("assumption").isNotNull()
    outcome = (
        F.when(asks & (F.col("role") != ACCOUNT), "not_an_account")
        .when(asks & ~_is_active(F.col("assumption")), "assumption_inactive")
        .when(F.col("seasonality").isNotNull() & ~_is_active(F.col("seasonality")), "seasonality_inactive")
        .otherwise("linked")
    )
    return rows.withColumn("outcome", outcome).select(*requests.columns, "role", "outcome")


def after_links(links: DataFrame, done: DataFrame) -> DataFrame:
    """The links with those that the last linked request of a key has set."""
    whole = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in KEY]
    new = done.where("outcome = 'linked'").select(*KEY, "assumption", "seasonality", F.lit(True).alias("_new"), "at", "author")
    had = links.select(*KEY, "assumption", "seasonality", F.lit(False).alias("_new"), F.lit(None).cast(new.schema["at"].dataType).alias("at"), F.lit(None).cast("string").alias("author"))
    last = F.max_by(F.struct(*KEY, "assumption", "seasonality"), F.struct("_new", "at", "author")).alias("_last")
    return had.unionByName(new).groupBy(*whole).agg(last).select("_last.*")


def of_sections(batches: DataFrame, lines: DataFrame) -> DataFrame:
    """Requests for all lines of the sections that batches name, one a line.

    batches: case_id, section, assumption, seasonality, at, author; lines: case_id, section, label, entity.
    """
    named = batches.withColumn("_section", F.coalesce("section", F.lit(""))).drop("section")
    return named.join(lines.select("case_id", "section", F.coalesce("section", F.lit("")).alias("_section"), "label", "entity"), ["case_id", "_section"]).select(*KEY, "assumption", "seasonality", "at", "author")


def of_batches(batches: DataFrame, done: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Per batch the outcome, and how many lines it linked and passed over.

    Lines of other roles are passed over and the batch goes on; an inactive assumption or
    seasonality refuses the whole of it, even where its section has no line.
    """
    keys = ["case_id", "_section", "assumption", "seasonality", "at", "author"]
    named = _with_active(batches.withColumn("_section", F.coalesce("section", F.lit(""))), assumptions)
    outcome = F.when(~_is_active(F.col("assumption")), "assumption_inactive").when(F.col("seasonality").isNotNull() & ~_is_active(F.col("seasonality")), "seasonality_inactive").otherwise("applied")
    counted = done.withColumn("_section", F.coalesce("section", F.lit(""))).groupBy(*keys).agg(F.count_if(F.col("outcome") == "linked").alias("n_linked"), F.count_if(F.col("outcome") == "not_an_account").alias("n_passed"))
    a, b = named.withColumn("outcome", outcome).alias("a"), counted.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    n = lambda c: F.when(F.col("a.outcome") == "applied", F.coalesce(F.col(f"b.{c}"), F.lit(0))).otherwise(0).alias(c)
    return a.join(b, on, "left").select(*(f"a.{c}" for c in batches.columns), "a.outcome", n("n_linked"), n("n_passed"))


def removals(requests: DataFrame, assumptions: DataFrame, catalogue: DataFrame, links: DataFrame) -> DataFrame:
    """Per request to deactivate an assumption of a case: outcome, and the links and curves that go with it.

    requests: case_id, code (unique together), author. outcome: unknown (not in the catalogue),
    not_active, else removed; values of a removed assumption stay with it.
    """
    known = requests.join(catalogue.select("code").distinct().withColumn("_known", F.lit(True)), "code", "left")
    rows = _with_active(known, assumptions)
    outcome = F.when(F.col("_known").isNull(), "unknown").when(~_is_active(F.col("code")), "not_active").otherwise("removed")
    rows = rows.withColumn("outcome", outcome)
    used = lambda c, n: links.where(F.col(c).isNotNull()).groupBy("case_id", F.col(c).alias("code")).agg(F.count("*").alias(n))
    rows = rows.join(used("assumption", "_links"), ["case_id", "code"], "left").join(used("seasonality", "_curves"), ["case_id", "code"], "left")
    n = lambda c: F.when(F.col("outcome") == "removed", F.coalesce(c, F.lit(0))).otherwise(0)
    return rows.select(*requests.columns, "outcome", n("_links").alias("n_links"), n("_curves").alias("n_curves"))


def after_removals(links: DataFrame, removed: DataFrame) -> DataFrame:
    """The links without what was removed; in a case with a removal, one that neither an assumption nor a curve holds is gone."""
    codes = removed.where("outcome = 'removed'").groupBy("case_id").agg(F.collect_set("code").alias("_off"))
    off = lambda c: F.when(~F.coalesce(F.array_contains("_off", F.col(c)), F.lit(False)), F.col(c))
    rows = links.join(codes, "case_id", "left").withColumns({"assumption": off("assumption"), "seasonality": off("seasonality")})
    return rows.where(F.col("_off").isNull() | F.col("assumption").isNotNull() | F.col("seasonality").isNotNull()).select(*links.columns)
