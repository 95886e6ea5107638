"""Near-duplicates of embeddings through an inverted multi-index.

Each half of the (normalised) vectors has a codebook of its own, and the product of both
is a grid of cells. Every vector lives in the cell of its nearest codewords. It visits
cells in the order of the summed distances of their codewords, as the multi-sequence
traversal of two sorted lists gives them, and as many of them as the target recall needs:
that number is measured on sample pairs, real ones and ones made at the very threshold.
If the cells tried are too few for it, more are tried, in the end all of them. In a visited
cell every vector of the same label is verified by cosine in double precision, so nothing
below the threshold is linked. The number of codewords grows with the square root of the
number of vectors, so that cells stay of one size.

Equal vectors of a label are one class with a number of members. A full cell is dealt in
blocks, its visitors in parts, and every part meets every block. Tasks count links and send, of the links
themselves, no more than a spanning star of what they have connected, so a group of k
alike vectors costs k rows; its k * k comparisons are blocks of matrix products.

The codebooks are fitted on the driver, on at most SAMPLE vectors, the first by a hash of
the id; every vector is indexed.

Defined results
---------------
* null labels; vectors that are null, empty, zero or hold null or non-finite components:
  linked with nothing: n_links 0, component_id their own id.
* vectors of different lengths are never linked.
* rows with a null id are linked with nothing, their component_id and kept are null.
* rows with the same id count as one node of the components.
* extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

THRESHOLD = 0.98
#: Vectors of a cell, in the mean, that the number of codewords aims at; least and most codewords of a half.
CELL, LEAST_CODEWORDS, MOST_CODEWORDS = 64, 16, 1024
#: Vectors that codebooks are fitted on, rounds of k-means.
SAMPLE, ROUNDS = 20_000, 12
#: Part of the similar pairs that the visited cells have to hold, and cells that are tried first.
RECALL, FIRST_CELLS = 0.999, 256
#: Vectors of a block of a cell and visitors of a part of it, in the mean; visitors compared with a block at once.
BLOCK, PART, VISITORS = 1024, 2048, 1024
#: Full cells up to this number are joined by broadcast, more by a shuffle.
BROADCAST_CELLS = 50_000


def _matrix(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of all usable rows, their lengths, rows that are usable) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(row, weights=~np.isfinite(values), minlength=len(lengths)) > 0
    top = np.zeros(len(lengths))
    if len(values):
        top[lengths > 0] = np.maximum.reduceat(np.abs(np.nan_to_num(values)), (np.cumsum(lengths) - lengths)[lengths > 0])
    return values, lengths, (lengths > 0) & ~bad & (top > 0)


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    x = values.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _units(column, width: int) -> np.ndarray:
    """Usable rows scaled to length one, padded or cut to a width; for places in the grid."""
    values, lengths, _ = _matrix(column)
    out = np.zeros((len(lengths), width))
    if len(values) and (lengths == lengths[0]).all():
        x = unit(values.reshape(len(lengths), -1))
        out[:, : min(width, x.shape[1])] = x[:, :width]
        return out
    ends = np.cumsum(lengths)
    for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
        out[i, : min(width, b - a)] = unit(values[None, a:b])[0, :width]
    return out


def _codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Codewords of the rows of x by k-means."""
    rng = np.random.default_rng(seed)
    words = x[rng.permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        near = _distances(x, words).argmin(1)
        n = np.bincount(near, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of rows from codewords."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None], 0)


def traverse(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """The n cells nearest to each row, nearest first, from its distances to both codebooks.

    With both lists of distances sorted, a cell of ranks r and s comes after the
    (r + 1) * (s + 1) - 1 cells of lower ranks, so only ranks with a product up to n can be
    among the first n; of these the sums are sorted.
    """
    k1, k2 = first.shape[1], second.shape[1]
    n = min(n, k1 * k2)
    o1, o2 = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
    r, s = np.array([(r, s) for r in range(k1) for s in range(k2) if (r + 1) * (s + 1) <= n], np.int64).reshape(-1, 2).T
    sums = np.take_along_axis(first, o1, 1)[:, r] + np.take_along_axis(second, o2, 1)[:, s]
    best = np.argsort(sums, 1, kind="stable")[:, :n]
    return np.take_along_axis(o1[:, r] * k2 + o2[:, s], best, 1)


class Index:
    """The codebooks of both halves and the number of cells that a vector visits."""

    def __init__(self, sample: np.ndarray, label: np.ndarray, threshold: float, codewords: int, recall: float):
        self.width = sample.shape[1]
        self.half = max(1, self.width // 2)
        halves = (sample[:, : self.half], sample[:, self.half :]) if self.width > 1 else (sample, np.zeros((len(sample), 1)))
        self.books = [_codebook(x, codewords, seed) for seed, x in enumerate(halves)]
        self.visits, self.recall = self._needed(sample, label, threshold, recall)

    def cells(self, x: np.ndarray, n: int) -> np.ndarray:
        a, b = (x[:, : self.half], x[:, self.half :]) if self.width > 1 else (x, np.zeros((len(x), 1)))
        return traverse(_distances(a, self.books[0]), _distances(b, self.books[1]), n)

    def _needed(self, sample: np.ndarray, label: np.ndarray, threshold: float, recall: float) -> tuple[int, float]:
        """Cells to visit until one of a pair meets the other in its home for the recall wanted, and the recall."""
        rng = np.random.default_rng(7)
        some = sample[:4000]
        # pairs at the very threshold: a step at a right angle
        step = rng.standard_normal(some.shape)
        step -= (step * some).sum(1, keepdims=True) * some
        step /= np.maximum(np.sqrt((step * step).sum(1, keepdims=True)), 1e-12)
        left, right = [some], [threshold * some + np.sqrt(max(0.0, 1 - threshold**2)) * step]
        for value in np.unique(label):
            mine = sample[label == value][:2000]
            a, b = np.nonzero(np.triu(mine @ mine.T >= threshold, 1))
            keep = rng.permutation(len(a))[:2000]
            left.append(mine[a[keep]])
            right.append(mine[b[keep]])
        x, y = np.concatenate(left), np.concatenate(right)
        every = len(self.books[0]) * len(self.books[1])
        tried = min(FIRST_CELLS, every)
        while True:
            ranks = []
            for i in range(0, len(x), 500):
                p, q = self.cells(x[i : i + 500], tried), self.cells(y[i : i + 500], tried)
                there = lambda seen, home: np.where((seen == home[:, :1]).any(1), (seen == home[:, :1]).argmax(1), tried)  # noqa: E731,B023
                ranks.append(np.minimum(there(p, q), there(q, p)))
            ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(1, np.int64)
            visits = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1
            if visits <= tried or tried == every:
                visits = min(visits, every)
                return visits, float((ranks < visits).mean())
            tried = min(4 * tried, every)


def _kind(vectors: DataFrame, embedding: str) -> str:
    """Floats stay floats; all other numbers are doubles, so that nothing is rounded."""
    return "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"


def _described(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, digest): what equal vectors have in common, null for unusable ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths, usable = _matrix(batch.column(2))
            values = values + 0.0  # one zero
            raw, ends = values.tobytes(), np.cumsum(lengths) * 8
            digest = [hashlib.blake2b(raw[b - 8 * n : b], digest_size=16).digest() if ok else None for b, n, ok in zip(ends.tolist(), lengths.tolist(), usable.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary())], names=["vec_id", "label", "digest"])

    return vectors.mapInArrow(run, "vec_id long, label string, digest binary")


def _placed(vectors: DataFrame, index: Index) -> DataFrame:
    """The vectors with the cells they visit, their home first."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value.cells(_units(batch.column(3), shared.value.width), shared.value.visits)
            offs = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
            column = pa.ListArray.from_arrays(offs, pa.array(cells.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=["vec_id", "label", "members", "embedding", "cells"])

    return vectors.mapInArrow(run, f"vec_id long, label string, members long, embedding {dict(vectors.dtypes)['embedding']}, cells array<int>")


class _Block:
    """The vectors of a block of a cell, gathered before its visitors come."""

    def __init__(self):
        self.parts: list[pa.Table] = []
        self.ready = None

    def add(self, table: pa.Table) -> None:
        self.parts.append(table)

    def data(self):
        if self.ready is None:
            self.ready = _rows(pa.concat_tables(self.parts))
        return self.ready


def _rows(table: pa.Table):
    """ids, members, cells visited and, by length, the places and units of the vectors."""
    table = table.combine_chunks()
    values, lengths, _ = _matrix(table["embedding"])
    begin = np.cumsum(lengths) - lengths
    by_length = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        by_length[n] = (at, unit(values[begin[at][:, None] + np.arange(n)]))
    return table["vec_id"].to_numpy(), table["members"].to_numpy(), table["cells"].combine_chunks(), by_length


def _compare(block, visitors, cell: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(visitor, other, members of each) of the similar pairs that are counted in this cell."""
    ids, members, cells, by_length = block
    v_ids, v_members, v_cells, v_by_length = visitors
    width = len(v_cells.values) // max(1, len(v_cells))
    home = v_cells.flatten().to_numpy().reshape(-1, width)[:, 0]
    visited = cells.flatten().to_numpy().reshape(-1, width)
    for n, (at, x) in v_by_length.items():
        if n not in by_length:
            continue
        there, y = by_length[n]
        for i in range(0, len(at), VISITORS):
            q, d = np.nonzero(x[i : i + VISITORS] @ y.T >= threshold)
            q, d = at[i : i + VISITORS][q], there[d]
            # a pair at home in one cell counts from its smaller id; a pair that meets in
            # both homes counts in the smaller cell
            same = home[q] == cell
            back = (visited[d] == home[q][:, None]).any(1)
            keep = np.where(same, v_ids[q] < ids[d], ~back | (cell < home[q]))
            q, d = q[keep], d[keep]
            yield v_ids[q], ids[d], v_members[q], members[d]


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star around the least node of each part that the links a-b connect."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _linked(met: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): n links more for a, or, with n = 0, a link between a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block = None, _Block()

        def answer(pairs) -> Iterator[pa.RecordBatch]:
            for a, b, m, k in pairs:
                if not len(a):
                    continue
                ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate((k, m)), minlength=len(ids)).astype(np.int64)
                left, right = _star(a, b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((ids, left))), pa.array(np.concatenate((ids, right))), pa.array(np.concatenate((n, np.zeros(len(left), np.int64))))],
                    names=["a", "b", "n"],
                )

        for batch in batches:
            keys = pc.run_end_encode(batch.column(0))
            begin = 0
            for key, end in zip(keys.values.to_pylist(), keys.run_ends.to_pylist(), strict=True):
                if key != group:
                    group, block = key, _Block()
                part = pa.Table.from_batches([batch.slice(begin, end - begin)])
                n_data = int(pc.sum(pc.equal(part["visitor"], 0)).as_py())
                if n_data:
                    block.add(part.slice(0, n_data))
                if n_data < len(part) and block.parts:
                    yield from answer(_compare(block.data(), _rows(part.slice(n_data)), int(key.split("|")[0]), threshold))
                begin = end

    return met.mapInArrow(run, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, codewords: int | None = None, recall: float = RECALL, sample: int = SAMPLE, id_col: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept (it is its component's least id), visits, recall.

    visits and recall are the index's: cells visited, and the part of the sample pairs that meet
    in them (null where there is nothing to index). codewords: of a half; by the number of
    vectors, where it is not given.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "multi_index")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast(_kind(vectors, embedding)).alias("embedding"))
    rows = scratch.save(_described(source), "rows")
    usable = rows.where("digest is not null and label is not null and vec_id is not null")
    heads = scratch.save(usable.groupBy("label", "digest").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("members")), "heads")
    own = heads.select(F.col("class_id").alias("vec_id"), "label", "members")
    first = source.join(own, ["vec_id", "label"]).select("vec_id", "label", "members", "embedding")
    first = scratch.save(first, "first")

    got = first.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("label", "embedding").toArrow().combine_chunks()
    no_links = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("int").alias("visits"), F.lit(None).cast("double").alias("recall"))
    if not len(got):
        return no_links
    codewords = codewords or int(np.clip(np.ceil(np.sqrt(first.count() / CELL)), LEAST_CODEWORDS, MOST_CODEWORDS))
    width = int(pc.max(pc.list_value_length(got["embedding"])).as_py())
    index = Index(_units(got["embedding"], width), got["label"].to_numpy(), threshold, codewords, recall)

    placed = scratch.save(_placed(first, index), "placed")
    homes = placed.groupBy("label", F.col("cells")[0].alias("cell")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("v"))
    visits = placed.select("label", F.explode("cells").alias("cell")).groupBy("label", "cell").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("v"))
    counts = homes.unionByName(visits).groupBy("label", "cell").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).where(f"n > {BLOCK} or (n > 0 and v > {PART})")
    dealt = [F.greatest(F.lit(1), F.ceil(F.col(c) / size).cast("int")).alias(x) for c, size, x in (("n", BLOCK, "blocks"), ("v", PART, "parts"))]
    full = scratch.save(counts.select(F.col("label").alias("_label"), F.col("cell").alias("_cell"), *dealt), "full")
    small = full.count() <= BROADCAST_CELLS
    same = lambda: (F.col("label") == F.col("_label")) & (F.col("cell") == F.col("_cell"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    one = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("vec_id")), F.coalesce(c, F.lit(1))).cast("int")
    data = placed.withColumn("cell", F.col("cells")[0]).join(F.broadcast(full) if small else full, same(), "left")
    data = data.withColumn("block", one("blocks", 1)).withColumn("part", every("parts"))
    calls = placed.withColumn("cell", F.explode("cells")).join(F.broadcast(full) if small else full, same(), "left")
    calls = calls.withColumn("block", every("blocks")).withColumn("part", one("parts", 2))
    # the cell stands first in the group's name, the label, which may hold anything, last
    columns = lambda visitor: (F.concat_ws("|", "cell", "block", "part", "label").alias("group"), F.lit(visitor).alias("visitor"), "vec_id", "members", "embedding", "cells")
    met = data.select(*columns(0)).union(calls.select(*columns(1)))
    found = scratch.save(_linked(met.repartition("group").sortWithinPartitions("group", "visitor"), threshold), "found")

    n_links = found.where("n > 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n"))
    parts = components(found.where("n = 0").select("a", "b"), scratch).select(F.col("node").alias("class_id"), "component")
    # as a table of their own, so that Spark can split the join of a class with many members
    classes = heads.join(n_links, "class_id", "left").join(parts, "class_id", "left")
    classes = scratch.save(classes.select(F.col("label").alias("_label"), F.col("digest").alias("_digest"), "class_id", "members", "n", "component"), "classes")
    scratch.drop("first", "placed", "full", "found", "heads")
    mine = (F.col("label") == F.col("_label")) & (F.col("digest") == F.col("_digest")) & F.col("vec_id").isNotNull()
    out = rows.join(classes, mine, "left")
    component = F.coalesce("component", "class_id", "vec_id")
    links = F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("members") - 1, F.lit(0))
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), F.lit(index.visits).alias("visits"), F.lit(index.recall).alias("recall"))
