"""Operator 11 against plain k-means in whole numbers, and its statement in DuckDB."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ball_tree, queries

KIND = "vec_id long, embedding array<double>, cluster int, distance long, q string, x int, h string"
EXTRA = (9, 9, "q", 1, "h")


def plain(rows, k=16, rounds=3, width=64, scale=64):
    """{(vec_id, q): ...} of kept vectors, by comparing every vector with every centroid."""
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    z = [list(q) for _, q in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        to = [min(range(len(z)), key=lambda c, q=q: (far(q, z[c]), c)) for _, q in kept]
        if r < rounds:
            for c in range(len(z)):
                mine = [q for (_, q), t in zip(kept, to, strict=True) if t == c]
                if mine:
                    z[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    d = [far(q, z[t]) for (_, q), t in zip(kept, to, strict=True)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    inertia = [sum(x for x, t in zip(d, to, strict=True) if t == c) for c in range(len(z))]
    return sorted(((i, t, x, inertia[t], sum(d), digest[t]) for (i, _), t, x in zip(kept, to, d, strict=True)), key=str)


def result(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 64)) * 0.2
    rows = [(i, (middles[i % 12] + rng.normal(size=64) * 0.02).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)]  # a third are copies
    rows += [(3000 + i, [0.5 if j == i % 2 else 0.0 for j in range(64)]) for i in range(40)]  # ties
    return rows


@pytest.mark.parametrize("block", [64, 16_384])
def test_against_plain_k_means(spark, blobs, block):
    df = spark.createDataFrame([(i, v, *EXTRA) for i, v in blobs], KIND).repartition(3)
    assert result(ball_tree.cluster(df, block=block)) == plain(blobs)


def test_edges(spark):
    unit = [1.0] + [0.0] * 63
    rows = [
        (1, unit), (1, unit), (None, [0.25] * 64), (2, None), (3, []), (4, [0.1] * 63), (5, [0.1] * 63 + [None]), (6, [0.1] * 63 + [float("nan")]),
        (7, [0.1] * 63 + [float("inf")]), (8, [-1e6] * 64), (9, [2e6] * 64), (10, [-0.0] * 64), (-11, [-1e-9] * 64), (12, unit[::-1]), (1, unit[::-1]),
    ]
    df = spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], KIND)
    assert result(ball_tree.cluster(df)) == plain(rows)
    assert result(ball_tree.cluster(df, k=2)) == plain(rows, k=2)
    got = ball_tree.cluster(df.where("vec_id in (2, 3, 4)"))
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="fit into a long"):
        ball_tree.cluster(spark.createDataFrame([(1, [1e9] * 64, *EXTRA)], KIND)).collect()


def test_balls_are_taken_whole_and_close_calls_opened():
    rng = np.random.default_rng(5)
    near, far = rng.integers(-3, 4, (500, 64)), rng.integers(-3, 4, (500, 64)) + 400
    tree = ball_tree.Tree.built(np.concatenate((near, far)), pa.array(range(1000)))
    z = np.array([[0] * 64, [400] * 64], np.int64)
    balls, to, rows, _ = tree.filtered(z)
    assert tree.count[balls].sum() == 1000 and len(rows) == 0 and sorted(set(to.tolist())) == [0, 1] and len(balls) < 10
    assert tree.summed(z)[0].tolist() == [500, 500] and (tree.summed(z)[1][1] == far.sum(0)).all()
    # the same centroid twice: nothing is settled by balls, the smaller number wins
    balls, _, rows, row_to = tree.filtered(np.array([[7] * 64, [7] * 64], np.int64))
    assert len(balls) == 0 and len(rows) == 1000 and set(row_to.tolist()) == {0}


def test_large_numbers_are_exact():
    rng = np.random.default_rng(9)
    x = rng.integers(-(2**27), 2**27, (50, 64))
    z = rng.integers(-(2**27), 2**27, (4, 64))
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in z] for r in x]
    assert ball_tree.distances(x, z).tolist() == exact
    assert sum(ball_tree.Tree.built(x, pa.array(range(50)), 4).assigned(z)[1].tolist()) == sum(min(r) for r in exact)


def test_query_and_statement(spark, sf):
    mine = result(queries.op11_ball_tree(spark, sf))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    theirs = con.execute(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({queries.oracle_sql()['op11_ball_tree']})").fetchall()
    assert mine == sorted(theirs, key=str) and len(mine) == con.execute("select count(*) from embeddings").fetchone()[0]
