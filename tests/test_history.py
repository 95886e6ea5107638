"""Histories of changes against a replay, one request after another."""

import random

from pyspark.sql import functions as F

from tidemark.functions import period
from tidemark.operators import history

DOCS = "document int, case_id int, kind string, entity_id string, period_id string, reason string, confidence double, source string"
REVIEWS = "document int, at int, author string, kind string, entity_name string, period_kind string, period_ref string, reason string"


def tables(spark, n=300):
    rng = random.Random(3)
    docs = [(d, d // 5, rng.choice(["A", "B", None]), rng.choice(["e1", None]), rng.choice(["p1", None]), rng.choice(["r", None]), 0.5, rng.choice(["machine", None])) for d in range(40)]
    reviews = [(rng.randrange(45), k, rng.choice(["ana", "rui"]), rng.choice(["A", "B", "C", None]), rng.choice([" Vertentes ", "VERTENTES", "Norte", " ", None]), rng.choice(["annual", None]), rng.choice(["2024", "2025", "", None]), rng.choice(["x", None])) for k in range(n)]
    entities = [(c, f"e{c}{i}", name) for c in range(4) for i, name in enumerate(["vertentes", "Vertentes", "Sul", None])]
    periods = [(c, f"p{c}", "annual", "2024") for c in range(4)]
    return docs, reviews, entities, periods


def frames(spark, docs, reviews, entities, periods):
    return (spark.createDataFrame(docs, DOCS), spark.createDataFrame(reviews, REVIEWS), spark.createDataFrame(entities, "case_id int, entity_id string, name string"), spark.createDataFrame(periods, "case_id int, period_id string, period_kind string, period_ref string"))


def replay(docs, reviews, entities, periods):
    """(rows, documents): ids of made entities and periods are their keys."""
    state = {d[0]: list(d) for d in docs}
    names, times = {}, {(c, k, r): i for c, i, k, r in periods}
    for c, i, name in entities:
        if name:
            names[c, name.lower()] = min(i, names.get((c, name.lower()), i))
    rows = []
    for d, at, author, kind, name, pkind, ref, reason in sorted(reviews, key=lambda r: (r[1], r[2])):
        if d not in state:
            continue
        s = state[d]
        was = s[2:6]
        if kind:
            s[2] = kind
        if name and name.strip():
            s[3] = names.setdefault((s[1], name.strip().lower()), ("made", s[1], name.strip().lower()))
        if ref and ref.strip():
            s[4] = times.setdefault((s[1], pkind or "other", ref), ("made", s[1], pkind or "other", ref))
        if reason:
            s[5] = reason
        s[6:] = [1.0, "human"]
        rows.append((d, at, author, *was, *s[2:6], "correction" if was[0] != s[2] else "approval"))
    return rows, state


def test_reviews_against_a_replay(spark):
    given = tables(spark)
    documents, reviews, entities, periods = frames(spark, *given)
    got = history.reviewed(documents, reviews, entities, periods)
    want, state = replay(*given)
    columns = ["document", "at", "author", *(f"{c}_{w}" for w in ("before", "after") for c in ("kind", "entity_id", "period_id", "reason")), "decision"]
    rows = sorted(map(tuple, got.select(*columns).collect()))
    # made ids are digests: they have to correspond to the replay's, one to one
    ids = {}
    for mine, theirs in zip(rows, sorted(want, key=lambda r: r[:3]), strict=True):
        for a, b in zip(mine, theirs, strict=True):
            assert ids.setdefault(b, a) == a if isinstance(b, tuple) else a == b
    assert len(ids) == len(set(ids.values())) and len(ids) > 5
    after = {r[0]: tuple(r) for r in history.after_reviews(documents, got).collect()}
    assert after == {d: tuple(ids.get(x, x) if isinstance(x, tuple) else x for x in s) for d, s in state.items()}


def test_a_machine_does_not_overwrite_a_human(spark):
    given = tables(spark, 30)
    documents, reviews, entities, periods = frames(spark, *given)
    reviewed = history.after_reviews(documents, history.reviewed(documents, reviews, entities, periods)).cache()
    found = spark.createDataFrame([(d, "Z" if d % 2 else None) for d in range(40)], "document int, kind string")
    before = {r.document: r for r in reviewed.collect()}
    for r in history.after_machine(reviewed, found, ["kind"]).collect():
        free = r.source != "human" and r.document % 2
        assert r.kind == ("Z" if free else before[r.document].kind)


def test_issues_of_reviewed_documents_close(spark):
    trail = spark.createDataFrame([(1, 2, "rui"), (1, 1, "ana")], "document int, at int, author string")
    issues = spark.createDataFrame([(1, "wrong_kind", "open", None), (1, "wrong_period", "resolved", "eva"), (1, "extraction_failed", "open", None), (2, "wrong_kind", "open", None)], "document int, kind string, state string, resolved_by string")
    got = sorted(tuple(r) for r in history.issues_closed(issues, trail).collect())
    assert got == [(1, "extraction_failed", "open", None), (1, "wrong_kind", "resolved", "ana"), (1, "wrong_period", "resolved", "eva"), (2, "wrong_kind", "open", None)]


def test_dials_against_a_replay(spark):
    rng = random.Random(4)
    dials = [("lines", "N0", "N2", None), ("forms", "N2", "N3", 0.9), ("books", "N0", "N1", 0.5)]
    asked = [(rng.choice(["lines", "forms", "books", "none"]), k, "ana", rng.choice(["N0", "N1", "N2", "N3", None]), rng.choice([None, 0.8, 0.95])) for k in range(80)]
    d = spark.createDataFrame(dials, "stage string, level string, ceiling string, threshold double")
    got = history.dials_moved(d, spark.createDataFrame(asked, "stage string, at int, author string, level string, threshold double"))
    state, want = {s: [level, top, t] for s, level, top, t in dials}, []
    for s, at, author, level, t in asked:
        if s not in state:
            want.append((s, at, author, level, "unknown", None, None, None, None))
            continue
        was = state[s][0], state[s][2]
        ok = level is not None and level <= state[s][1]
        if ok:
            state[s] = [level, state[s][1], state[s][2] if t is None else t]
        want.append((s, at, author, level, "moved" if ok else "refused", *was, state[s][0], state[s][2]))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert {r.stage: [r.level, r.ceiling, r.threshold] for r in history.after_moves(d, got).collect()} == state


def test_diagnoses(spark):
    docs = spark.createDataFrame([(1, 1, "A", "Norte", "anual 2025"), (2, 1, None, None, None)], "document int, case_id int, kind string, entity_name string, period_ref string")
    rows = [(1, 1, None, "A", " NORTE", "2025-12-31", "good"), (1, 2, False, None, "Sul", "2024", "illegible"), (2, 3, True, "B", "Sul", "2024", None), (9, 4, False, None, None, None, None)]
    found = spark.createDataFrame(rows, "document int, version int, confirms boolean, found_kind string, found_entity string, found_period string, legibility string")
    got = history.diagnosed(docs, found, ~period.equivalent(F.col("period_ref"), F.col("found_period")))
    fires = {(r.version, r.kind) for r in got.collect() if r.fires}
    assert fires == {(2, "wrong_entity"), (2, "wrong_kind"), (2, "wrong_period"), (2, "illegible"), (3, "wrong_kind")}
    assert {(r.version, r.kind) for r in got.collect()} >= {(1, "wrong_entity"), (1, "illegible"), (3, "wrong_period")} and got.where("version = 3 and kind = 'wrong_entity'").isEmpty()
