"""Centroids of integer vectors by k-means, filtered through ball trees.

Every task packs the vectors it reads into metric trees of at most BLOCK vectors. A ball (node)
stores its count, its integer sum and a radius that reaches from sum / count to its farthest
vector. A round broadcasts the k centroids and walks each tree from its root: a centroid that
by the triangle inequality is farther from every vector of a ball than another one drops out
for that ball; a ball with one centroid left goes to it whole, by its count and sum; any other
is opened, down to leaves whose vectors are compared in exact integers. Balls only save work:
ties and close calls always end in leaves, so the result is that of plain k-means.

The trees are written once to the shared folder, one row a tree, and read by every round. A
round sends back k sums a task; vectors never move, so groups of equal vectors weigh nothing.

Defined results
---------------
* kept are vectors with exactly `width` components, none null or non-finite; a component x
  becomes floor(scale * x), x as double. Other rows don't appear in the result.
* components beyond MOST after scaling raise an error: their squared distances would not
  fit into a long.
* rows with a null id take part; they start a centroid only where rows with an id are too
  few. Equal ids are rows of their own, told apart at the start by their components.
* fewer vectors than centroids: as many centroids as vectors. An empty table gives no rows.
* ties go to the smaller number of a centroid; a centroid that loses all vectors stays.
* cluster_inertia and inertia are null where they don't fit into a long.
* extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Largest component after scaling: 64 * (2 * 2**27) ** 2 is below 2**63.
MOST = 2**27
#: Vectors of a tree and of a leaf, at most.
BLOCK, LEAF = 16_384, 32
#: Up to this size of components products of rows are exact in doubles (64 * 2**44 < 2**53).
EXACT = 2**22
#: Part by which computed distances may be off; a centroid is dropped only beyond it.
SLACK = 1e-9

TREE = "ids array<long>, kind string, points binary, low array<int>, high array<int>, left array<int>, sums binary, radius array<double>"


class Tree:
    """Balls over rows of integers; the children of a ball stand next to one another.

    points and ids are in the order of the leaves: ball i holds rows low[i] to high[i].
    left[i] is the first of its two children, -1 for a leaf.
    """

    def __init__(self, points, ids, low, high, left, sums, radius):
        self.points, self.ids, self.low, self.high, self.left, self.sums, self.radius = points, ids, low, high, left, sums, radius
        self.count = high - low

    @classmethod
    def built(cls, points: np.ndarray, ids, leaf: int = LEAF) -> Tree:
        order = np.arange(len(points))
        x = points.astype(np.float64)
        low, high, left, sums, radius = [0], [len(points)], [-1], [None], [0.0]
        at = 0
        while at < len(low):
            rows = order[low[at] : high[at]]
            mine = x[rows]
            total = points[rows].sum(0)
            away = mine - total / len(rows)
            away = np.einsum("ij,ij->i", away, away)
            sums[at], radius[at] = total, float(np.sqrt(away.max()) * (1 + SLACK))
            if len(rows) > leaf and (mine != mine[0]).any():
                # the vector farthest from the middle and the one farthest from it span the cut
                one = mine[away.argmax()]
                gap = mine - one
                line = mine[np.einsum("ij,ij->i", gap, gap).argmax()] - one
                half = len(rows) // 2
                order[low[at] : high[at]] = rows[np.argpartition(mine @ line, half)]
                left[at] = len(low)
                for a, b in ((low[at], low[at] + half), (low[at] + half, high[at])):
                    low.append(a)
                    high.append(b)
                    left.append(-1)
                    sums.append(None)
                    radius.append(0.0)
            at += 1
        return cls(points[order], ids.take(pa.array(order)), *(np.array(c, np.int32) for c in (low, high, left)), np.array(sums, np.int64), np.array(radius))

    def row(self) -> list:
        kind = next(t for t in ("int8", "int16", "int32") if np.abs(self.points).max(initial=0) <= np.iinfo(t).max)
        return [self.ids, kind, self.points.astype(kind).tobytes(), self.low, self.high, self.left, self.sums.tobytes(), self.radius]

    @classmethod
    def of_row(cls, batch: pa.RecordBatch, i: int, width: int) -> Tree:
        ids, kind, points, low, high, left, sums, radius = (batch.column(c)[i] for c in range(batch.num_columns))
        numbers = lambda c: c.values.to_numpy(zero_copy_only=False)
        rows = np.frombuffer(points.as_buffer(), kind.as_py()).reshape(-1, width).astype(np.int64)
        return cls(rows, ids.values, numbers(low), numbers(high), numbers(left), np.frombuffer(sums.as_buffer(), np.int64).reshape(-1, width), numbers(radius))

    def filtered(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(balls, centroid of each) that are settled whole, (rows, centroid of each) of opened leaves."""
        k = len(centroids)
        z = centroids.astype(np.float64)
        balls, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        settled, settled_to, opened, opened_alive = [], [], [], []
        while len(balls):
            middle = self.sums[balls] / self.count[balls][:, None]
            d = np.stack([np.sqrt(np.einsum("ij,ij->i", middle - c, middle - c)) for c in z], 1)
            d[~alive] = np.inf
            near = d.min(1)
            alive = d <= (near + 2 * self.radius[balls] + SLACK * (1 + near))[:, None]
            one = alive.sum(1) == 1
            settled.append(balls[one])
            settled_to.append(alive[one].argmax(1))
            balls, alive = balls[~one], alive[~one]
            leaf = self.left[balls] < 0
            opened.append(balls[leaf])
            opened_alive.append(alive[leaf])
            first = self.left[balls[~leaf]].astype(np.int64)
            balls, alive = np.concatenate((first, first + 1)), np.concatenate((alive[~leaf], alive[~leaf]))
        leaves, allowed = np.concatenate(opened), np.concatenate(opened_alive)
        n = self.count[leaves]
        rows = np.repeat(self.low[leaves] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        to = np.zeros(len(rows), np.int64)
        if len(rows):
            d = distances(self.points[rows], centroids)
            d[~np.repeat(allowed, n, 0)] = np.iinfo(np.int64).max
            to = d.argmin(1)
        return np.concatenate(settled), np.concatenate(settled_to), rows, to

    def summed(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and integer sum of the vectors of each centroid."""
        balls, to, rows, row_to = self.filtered(centroids)
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        np.add.at(n, to, self.count[balls])
        np.add.at(total, to, self.sums[balls])
        for c in np.unique(row_to):
            mine = rows[row_to == c]
            n[c] += len(mine)
            total[c] += self.points[mine].sum(0)
        return n, total

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and exact squared distance of every row."""
        balls, ball_to, rows, row_to = self.filtered(centroids)
        to = np.zeros(len(self.points), np.int64)
        for ball, c in zip(balls.tolist(), ball_to.tolist(), strict=True):
            to[self.low[ball] : self.high[ball]] = c
        to[rows] = row_to
        gap = self.points - centroids[to]
        return to, np.einsum("ij,ij->i", gap, gap)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers from centroids."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        crossed = (points.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    else:
        crossed = points @ centroids.T
    square = lambda x: np.einsum("ij,ij->i", x, x)
    return square(points)[:, None] - 2 * crossed + square(centroids)[None]


def integers(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, q): the kept vectors, their components scaled and rounded down."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("x", lambda c: F.when(F.abs(c) * scale <= MOST, F.floor(c * scale)).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST} / {scale}: its squared distance may not fit into a long"))))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.coalesce((F.size("x") == width) & finite, F.lit(False)))
    return kept.select("vec_id", whole.alias("q"))


def trees(vectors: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row a tree of at most `block` of the vectors that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("points", pa.binary()), *((c, pa.list_(pa.int32())) for c in ("low", "high", "left")), ("sums", pa.binary()), ("radius", pa.list_(pa.float64()))])

        def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            ids = rows["vec_id"].combine_chunks()
            points = rows["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(Tree.built(points, ids).row(), schema.types, strict=True)], schema=schema)

        parts, n = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                some = batch.slice(at, block - n)
                at, n = at + len(some), n + len(some)
                parts.append(some)
                if n == block:
                    yield packed(parts)
                    parts, n = [], 0
        if n:
            yield packed(parts)

    return vectors.mapInArrow(run, TREE)


def _sums(packed: DataFrame, centroids: np.ndarray) -> list:
    """(centroid, component, vectors, sum) over all trees; a task sends its own sums only."""
    shared = packed.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = shared.value
        n, total = np.zeros(len(z), np.int64), np.zeros(z.shape, np.int64)
        for batch in batches:
            for i in range(len(batch)):
                more = Tree.of_row(batch, i, z.shape[1]).summed(z)
                n, total = n + more[0], total + more[1]
        k, w = z.shape
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), w)), pa.array(np.tile(np.arange(w, dtype=np.int32), k)), pa.array(np.repeat(n, w)), pa.array(total.ravel())], names=["c", "i", "n", "s"])

    sums = packed.mapInArrow(run, "c int, i int, n long, s long").groupBy("c", "i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sums.collect()
    shared.destroy()
    return found


def _assigned(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                tree = Tree.of_row(batch, i, centroids.shape[1])
                to, d = tree.assigned(centroids)
                yield pa.RecordBatch.from_arrays([tree.ids, pa.array(to.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return packed.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = "1", block: int = BLOCK, id_col: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the k vectors with the least sha256 of "seed:id".
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ball_tree")
    whole = integers(vectors, width, scale, id_col, embedding)
    named = whole.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.q for r in first], np.int64).reshape(-1, width)
    packed = scratch.save(trees(whole, width, block), "trees")
    for _ in range(rounds):
        centroids = centroids.copy()
        for r in _sums(packed, centroids):
            if r.n:
                centroids[r.c, r.i] = int(r.s) // int(r.n)
    found = scratch.save(_assigned(packed, centroids), "assigned")
    scratch.drop("trees")
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 2**63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    # k rows
    about = spark.createDataFrame([(c, fits(inertia[c]), fits(sum(inertia.values())), digest(centroids[c])) for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = "1") -> str:
    """The same rows as a DuckDB statement over the view embeddings."""
    steps = [
        f"kept as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor({scale} * x::double) as bigint)) as q from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda x: isfinite(x::double))) = {width})",
        "v as materialized (select vec_id, unnest(q) as x, generate_subscripts(q, 1) as i from kept)",
        f"first as (select vec_id, row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c from kept qualify c < {k})",
        "z0 as materialized (select c, i, x from first join v using (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} as materialized (select v.vec_id, c, sum((v.x - z.x) * (v.x - z.x)) as d from v join z{r} z using (i) group by v.vec_id, c)")
        steps.append(f"a{r} as materialized (select vec_id, c, d from d{r} qualify row_number() over (partition by vec_id order by d, c) = 1)")
        if r < rounds:
            steps.append(f"s{r} as (select c, i, sum(x) as s, count(*) as n from a{r} join v using (vec_id) group by c, i)")
            steps.append(f"z{r + 1} as materialized (select z.c, z.i, coalesce(cast((s - ((s % n) + n) % n) // n as bigint), z.x) as x from z{r} z left join s{r} using (c, i))")
    last = rounds
    return (
        f"with {', '.join(steps)}, h as (select c, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from z{last} group by c)"
        f" select vec_id, c::int as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256 from a{last} join h using (c)"
    )
