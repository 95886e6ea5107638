"""Joins by likeness and match-or-create against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import match

WORDS = ["vertentes", "metalurgica", "metal", "logistica", "componentes", "holding", "norte", "nor", "comercio", "com", "de", "vt", "spe", "energia", "energetica", "participacoes", "part"]


def plain(name):
    folded = re.sub(r"\s+", " ", (name or "").lower().translate(str.maketrans(text.FOLD_FROM, text.FOLD_TO))).strip()
    folded = re.sub(text.LEGAL_SUFFIX, "", folded)
    return re.sub(r"\s+", " ", re.sub(r"""[.,;:/\\()'"-]""", " ", folded)).strip()


def same(a, b):
    x, y = plain(a), plain(b)
    if not x or not y:
        return False
    if x == y:
        return True
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    s, j = short.split(" "), 0
    for t in long.split(" "):
        if j < len(s) and t.startswith(s[j]):
            j += 1
    return any(len(t) >= 4 for t in s) and j == len(s)


def names(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
        name = rng.choice([name, name.title(), name.upper() + " LTDA", name + " S.A.", " " + name + ". "])
        out.append((i // 100, name, i))
    return out


def test_pairs_against_brute_force(spark):
    rows = names(1500, 1) + [(0, None, 0), (0, "", 0), (0, "...", 0), (None, "vertentes", 0), (0, "vt", 1), (0, "VT S.A.", 2)]
    left = spark.createDataFrame(rows, "scope int, a string, k int")
    right = spark.createDataFrame([(s, n, k) for s, n, k in names(1500, 2)] + [(0, "vt ltda", 1), (None, "vertentes", 0)], "scope int, b string, k int")
    got = sorted(map(tuple, match.same_entities(left, right, ["scope"], "a", "b").collect()))
    by = {}
    for s, n, _ in right.collect():
        by.setdefault(s, set()).add(n)
    want = sorted({(s, a, b) for s, a, _ in rows if s is not None for b in by.get(s, ()) if same(a, b)})
    assert got == want and len(want) > 1000


def in_turn(entities, batch):
    """Names one after another, as the rule says it."""
    known, out = {}, {}
    for scope, i, name in entities:
        known.setdefault(scope, []).append((name, i))
    for scope, name in dict.fromkeys((s, n) for s, n, _ in sorted(batch, key=lambda r: (r[2], r[1] or "")) if plain(n)):
        fits = sorted(e for e in known.get(scope, []) if same(e[0], name))
        old = [e for e in fits if e[1] is not None]
        if fits:
            best = old[0] if old else fits[0]
            out[scope, name] = (best[0], best[1], False)
        else:
            known.setdefault(scope, []).append((name, None))
            out[scope, name] = (name, None, True)
    return out


def test_match_or_create(spark):
    batch = names(5_000, 3) + [(0, None, 5), (0, " ", 6), (7, "Empresa Só Uma Ltda", 3), (7, "empresa so uma", 3)]
    old = [(s, f"id{s}-{k}", n) for k, (s, n) in enumerate(dict.fromkeys((s, n) for s, n, i in names(5_000, 3) if i % 37 == 0))][:150]
    entities = spark.createDataFrame(old, "scope int, entity_id string, name string")
    rows = spark.createDataFrame(batch, "scope int, name string, at int").repartition(5)
    got = match.upserted(entities, rows, ["scope"], "name", [F.col("at")]).collect()
    want = in_turn(old, batch)
    assert {(r.scope, r.name): (r.entity_name, r.created) for r in got} == {k: (v[0], v[2]) for k, v in want.items()} and len(got) == len(want)
    assert all(want[r.scope, r.name][1] in (None, r.entity_id) for r in got)
    # a rerun finds what the first run has made
    made = [(r.scope, r.entity_id, r.name) for r in got if r.created]
    assert made and len({m[1] for m in made}) == len(made)
    again = match.upserted(spark.createDataFrame(old + made, entities.schema), rows, ["scope"], "name", [F.col("at")])
    assert again.where("created").count() == 0
    assert match.upserted(entities, rows.where("false"), ["scope"], "name", [F.col("at")]).count() == 0


REFS = ["2024", "12M24", "23,24", "31/12/2025", "L24M", "", None, "2T23", "2021,2022,2023"]


@pytest.mark.parametrize("copies", [1, 3])
def test_periods_that_overlap(spark, copies):
    years = {"2024": {2024}, "12M24": {2024}, "23,24": {2023, 2024}, "31/12/2025": {2025}, "2T23": {2023}, "2021,2022,2023": {2021, 2022, 2023}}
    rows = [(k % 3, k, r) for k, r in enumerate(REFS * copies)]
    left = spark.createDataFrame(rows, "s int, a int, ra string")
    right = spark.createDataFrame(rows, "s int, b int, rb string")
    got = sorted((r.s, r.a, r.b) for r in match.overlapping(left, right, ["s"], "ra", "rb").collect())
    fits = lambda x, y: not years.get(x) or not years.get(y) or years[x] & years[y]
    assert got == sorted((s, a, b) for s, a, x in rows for t, b, y in rows if s == t and fits(x, y))
