import numpy as np
import pytest

from tests.llm.helpers import Union
from tidemark.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, n int, key string, cells string"


def brute(rows, threshold=0.98):
    n, parts = {r[0]: 0 for r in rows}, Union()
    good = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    for r in rows:
        parts.find(r[0])
    x = {r[0]: np.array(r[1], np.float64) for r in good}
    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = x[a[0]], x[b[0]]
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    parts.join(a[0], b[0])
    return {k: (n[k], parts.find(k), parts.find(k) == k) for k in n}


def found(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_small_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rng = np.random.default_rng(5)
    some = [(r["vec_id"], r["embedding"], r["label"]) for r in rows.collect()]
    near = [(10_000 + k, [float(np.float32(v)) for v in np.array(some[k % 40][1]) + rng.normal(0, 0.012, 64)], some[k % 40][2]) for k in range(200)]
    wanted = brute(some + near)
    got = found(multi_index.near_duplicates(spark.createDataFrame(some + near, "vec_id long, embedding array<float>, label int")))
    links, there = sum(v[0] for v in wanted.values()), sum(v[0] for v in got.values())
    assert 0.9 * links <= there <= links
    assert all(got[k][0] <= wanted[k][0] for k in wanted)
    assert np.mean([got[k] == wanted[k] for k in wanted]) > 0.97


@pytest.mark.parametrize("block", [16, 1024])
def test_hot_group(spark, monkeypatch, block):
    """A group of near copies in one cell, dealt in blocks, with exact copies and other labels."""
    monkeypatch.setattr(multi_index, "BLOCK", block)
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    rows = [(k, [float(np.float32(v)) for v in base + rng.normal(0, 0.08, 16)], k % 2) for k in range(150)]
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(40)]
    rows += [(2000 + k, [float(v) for v in rng.normal(size=16)], 0) for k in range(60)]
    got = found(multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")))
    wanted = brute(rows)
    assert sum(v[0] for v in got.values()) >= 0.98 * sum(v[0] for v in wanted.values())
    assert all(got[k][0] <= wanted[k][0] for k in wanted)


def test_edges(spark):
    e = (1, "k", "c")
    rows = [
        (1, [1.0, 0.0], 1, *e), (2, [2.0, 0.0], 1, *e), (3, [1.0, 0.0], None, *e), (4, [0.0, 0.0], 1, *e), (5, None, 1, *e), (6, [], 1, *e),
        (7, [float("nan"), 1.0], 1, *e), (8, [None, 1.0], 1, *e), (9, [1.0, 0.0, 0.0], 1, *e), (10, [1.0, 0.0], 2, *e), (11, [float("inf"), 1.0], 1, *e), (12, [-1.0, 0.0], 1, *e),
        (13, [0.5], 3, *e), (14, [7.5], 3, *e),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(multi_index.near_duplicates(df))
    assert got == brute([r[:3] for r in rows])
    with_null = found(multi_index.near_duplicates(spark.createDataFrame([*rows[:2], (None, [1.0, 0.0], 1, *e)], SCHEMA)))
    assert with_null == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, None)}
    assert multi_index.near_duplicates(df.limit(0)).count() == 0


def test_traversal_visits_cells_by_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random((5, 7)), rng.random((5, 6))
    got = multi_index.traverse(a, b, 20)
    for i in range(5):
        sums = (a[i][:, None] + b[i][None]).ravel()
        assert np.allclose(sums[got[i]], np.sort(sums)[:20])


def test_more_cells_until_the_recall_holds(monkeypatch):
    """Vectors of which halves say little about each other: the first cells tried are too few."""
    monkeypatch.setattr(multi_index, "FIRST_CELLS", 2)
    rng = np.random.default_rng(3)
    x = multi_index.unit(rng.normal(size=(3000, 4)))
    index = multi_index.Index(x, np.array(["a"] * len(x)), 0.9, 40, 0.999)
    assert index.visits > 8 and index.recall >= 0.999


def test_doubles_are_not_rounded(spark):
    # 1e300 is infinite as a float; the third vector equals the first one only when rounded to floats
    rows = [(1, [1e300, 1e300, 0.0], "x"), (2, [1e300, 1.0001e300, 0.0], "x"), (3, [1.0, 2.0, 3.0], "x"), (4, [1.0, 2.0, 3.0 + 1e-12], "x"), (5, [-1.0, 2.0, 3.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_duplicates(df, threshold=1 - 1e-6).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}
    assert {r.vec_id: r.n_links for r in multi_index.near_duplicates(df, threshold=1 - 1e-10).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}
