"""N-gram Jaccard join: a size-aware heavy-light join of the documents' shingle sets.

A document's set is its distinct five-word shingles. Equal sets are one class, found by a
digest, so copies are never compared. Every shingle has a place in one global order, rare
ones first, taken from counts that all documents add to (hashed into a fixed number of
buckets, so the table of counts has a fixed size). Two sets of similarity t share at least
ceil(t * size) shingles, so with prefixes of size - ceil(t * size) + c shingles in that
order they share c of them:

* small sets enumerate the subsets of c = SUBSET shingles of their prefix and meet in those;
* large sets are scanned in the inverted lists of the single shingles of their prefix (c = 1).

The boundary between small and large is the size with the least estimated cost, and sets
near it are in both, so that a small set meets a large one in the lists. Lists of one set
are dropped. A set is first compared with two sets of each of its lists, the one with the
key at the first place and the one with the least hash, and then, wherever sets of a list
are not yet known to belong together, all such pairs are compared: no link between
different texts is lost that the components need, and hot lists of alike sets cost no
more than their length. Sets verify
each other on all their shingles, in integers: 100 * both >= 80 * either.

Then join() counts all links: similar sets are of one component, so the sets of each are
dealt to blocks, and every two blocks of a component are compared in numpy within a task,
all sets with all. No pairs are sent, only blocks and counts. A component of k sets costs
k * k comparisons.

Defined results
---------------
* null texts and texts without words have an empty set, linked with nothing; their
  component is their own id, n_links is 0.
* n_links counts the other documents with the same or a similar set. An id with different
  texts counts in each of their classes, and each of its rows has the links of its class.
* texts of one to four words have one shingle, the whole sequence.
* rows with the same id count as one document that has all their links; rows with a null
  id are counted (n_shingles) but linked with nothing and have no component.
* repeated rows stay rows; extra columns are ignored; an empty table gives no rows.
* sets are compared as sets of 64-bit hashes, whole texts however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext
from .common import Scratch, small_batches
from .components import components

WORDS, THRESHOLD = 5, 80
#: Shingles of a subset that small sets enumerate.
SUBSET = 2
#: log2 of the buckets that shingles are counted in; 4 bytes each are broadcast.
COUNT_BITS = 20
#: Buckets sent in one row, and the largest size told apart by the cost.
CHUNK, MOST_SIZE = 1 << 14, 4096
#: Sets of a list that are dealt to one part of it at most, in the mean.
PART = 4096
#: Taken off the places of subsets.
SUBSETS = 1 << 20
#: Shingles that are read for what a row costs that is moved.
READ = 64
#: Sets of a block of a component, and blocks from which on they grow up to the second size.
BLOCK, BLOCKS, MOST_BLOCK = 128, 32, 1024
#: Shingles of a block, in the mean, and cells of a matrix that blocks are compared in.
BLOCK_SHINGLES, CELLS = 1 << 20, 1 << 22
#: Components of several blocks that are broadcast at most.
BROADCAST_COMPONENTS = 1 << 18


def _needed(n: np.ndarray, threshold: int) -> np.ndarray:
    """Shingles that a set of n has in common with any other that it links with, at least."""
    return -(-n * threshold // 100)


def _sets(column) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted, and their number."""
    h, _, _, counts = vectext.words(*vectext.utf8(column))
    return vectext.distinct(*vectext.shingles(h, counts, WORDS))


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _described(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, n, digest): the size of each row's set and what equal sets have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.slices(batch):
                values, n = _sets(part.column(1))
                raw, ends = values.tobytes(), np.cumsum(n) * 8
                digest = [hashlib.blake2b(raw[b - 8 * k : b], digest_size=16).digest() for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(digest, pa.binary())], names=["doc_id", "n", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, digest binary")


def _counted(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each bucket: one array of fixed size for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for part in vectext.slices(batch):
                seen += np.bincount(_bucket(_sets(part.column(1))[0]), minlength=len(seen))
        for k in range(0, len(seen), CHUNK):
            if seen[k : k + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([seen[k : k + CHUNK].astype(np.uint32).tobytes()], pa.binary())], names=["chunk", "counts"])

    def add(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.int64)
        for batch in groups:
            for x in batch.column(1):
                total += np.frombuffer(x.as_py(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(1 << COUNT_BITS, np.int64)
    for row in sets.mapInArrow(run, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def _load(counts: np.ndarray) -> float:
    """Other sets that a shingle meets, in the mean: how far the filling of buckets is from even."""
    mean = counts.mean(dtype=np.float64)
    return float(max(0.0, counts.var(dtype=np.float64) / mean - 1)) if mean else 0.0


def _boundary(sizes: dict[int, int], load: float, threshold: int) -> int:
    """The largest size of a small set: least cost of subsets below and lists above.

    sizes: sets of each size; load: other sets that a shingle meets in its list. A subset
    costs a row; a list entry costs a row and the shingles of the sets it meets, READ a row.
    """
    least = lambda n: -(-n * threshold // 100)
    subsets = lambda n: comb(max(0, n - least(n) + SUBSET), SUBSET)
    entries = lambda n: (n - least(n) + 1) * (1 + load * n / READ)
    best, chosen = None, 0
    for bound in range(0, 129):
        cost = sum(k * subsets(n) for n, k in sizes.items() if n <= bound) + sum(k * entries(n) for n, k in sizes.items() if n >= least(bound + 1))
        if best is None or cost < best:
            best, chosen = cost, bound
    return chosen


def _keys(sets: DataFrame, counts, bound: int, threshold: int) -> DataFrame:
    """(key, part, parts, doc_id, n, place): what each set is looked up by.

    place is the position of the shingle in the set's order, in subsets the sum of both less
    SUBSETS, and so negative; a key whose bucket is very full is dealt in parts.
    """
    first_large = int(_needed(np.array([bound + 1]), threshold)[0])

    def parts_of(full: np.ndarray, even: int) -> np.ndarray:
        """Parts of keys by what their buckets hold over twice the even filling."""
        return np.maximum(full.astype(np.int64) - even, 0) // PART + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        even = int(2 * table.mean(dtype=np.float64))
        for batch in batches:
            for part in vectext.slices(batch):
                values, n = _sets(part.column(1))
                if not len(values):
                    continue
                row = np.repeat(np.arange(len(n)), n)
                # rare shingles first; ties by the shingle itself
                weight = table[_bucket(values)]
                order = np.lexsort((values, weight, row))
                values, weight = values[order], weight[order]
                place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
                spare = n - _needed(n, threshold)
                in_list = (place <= spare[row]) & (n >= first_large)[row]
                keys, docs, places, full = [values[in_list]], [row[in_list]], [place[in_list]], [weight[in_list]]
                small = np.flatnonzero((n > 1) & (n <= bound))
                begin = np.cumsum(n) - n
                prefix = np.minimum(spare + SUBSET, n)
                for size in np.unique(prefix[small]).tolist():
                    mine = small[prefix[small] == size]
                    one, two = np.triu_indices(size, 1)
                    a, b = values[begin[mine][:, None] + one], values[begin[mine][:, None] + two]
                    keys.append(vectext.mix(np.minimum(a, b) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(a, b)).ravel())
                    docs.append(np.repeat(mine, len(one)))
                    places.append(np.tile(one + two - SUBSETS, len(mine)))
                    full.append(np.minimum(weight[begin[mine][:, None] + one], weight[begin[mine][:, None] + two]).ravel())
                at = np.concatenate(docs)
                ids = part.column(0).to_numpy(zero_copy_only=False)[at]
                parts = parts_of(np.concatenate(full), even)
                mixed = vectext.mix(ids.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array((mixed % parts.astype(np.uint64)).astype(np.int32)), pa.array(parts.astype(np.int32)), pa.array(ids), pa.array(n[at].astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))],
                    names=["key", "part", "parts", "doc_id", "n", "place"],
                )

    return sets.mapInArrow(run, "key long, part int, parts int, doc_id long, n int, place int")


_HEADS = "first_doc long, first_n int, first_place int, any_doc long, any_n int, any_place int"


def _lists(keys: DataFrame) -> DataFrame:
    """The keys without those that one set alone has; those dealt in parts stay for the next step.

    Every row also names two sets of its list, or of its part of it: the one with the shingle
    at the first place, and the one with the least hash. A text that near copies were made
    from has no rare shingles of its own, so in its order the shared ones come first.
    """
    dealt = keys.repartition("key", "part").sortWithinPartitions("key", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            key, part = table["key"].to_numpy(), table["part"].to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            # the last list may go on in the next batch
            last = int(np.flatnonzero(new)[-1])
            yield from _shared(table.slice(0, last), new[:last])
            held = table.slice(last).combine_chunks().to_batches()[0]
        if held is not None:
            new = np.zeros(held.num_rows, bool)
            new[0] = True
            yield from _shared(pa.Table.from_batches([held]), new)

    return dealt.mapInArrow(run, f"key long, parts int, doc_id long, n int, place int, {_HEADS}")


def _shared(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(new)))
    keep = (np.repeat(size, size) > 1) | (table["parts"].to_numpy() > 1)
    doc, n, place = (table[c].to_numpy() for c in ("doc_id", "n", "place"))
    which = np.repeat(np.arange(len(begin)), size)
    hashed = vectext.mix(doc.astype(np.uint64) + np.uint64(1))
    columns = [table[c] for c in ("key", "parts", "doc_id", "n", "place")]
    for order in (np.lexsort((hashed, place, which)), np.lexsort((hashed, which))):
        head = np.repeat(order[begin], size)
        columns += [pa.array(doc[head]), pa.array(n[head]), pa.array(place[head])]
    names = ["key", "parts", "doc_id", "n", "place", *(x.split()[0] for x in _HEADS.split(", "))]
    yield from pa.Table.from_arrays(columns, names=names).filter(pa.array(keep)).combine_chunks().to_batches()


def _possible(threshold: int) -> Column:
    """Whether sets a and b that share a list entry can be similar: by sizes and by places.

    Where the first shared shingle stands at places i and j, no more than the shingles
    from there on can be shared; a pair that is similar passes at its first shared one.
    """
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    rest = F.least(F.col("n_a") - F.greatest("place_a", F.lit(0)), F.col("n_b") - F.greatest("place_b", F.lit(0)))
    return (low * 100 >= high * threshold) & (rest * (100 + threshold) >= (F.col("n_a") + F.col("n_b")) * threshold)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.slices(batch, "text_a", 1 << 20):
                left, n = _sets(part.column(2))
                right, m = _sets(part.column(3))
                # shingles that both sets of a row have, counted in one sort of row and shingle
                row = np.concatenate((np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)))
                values = np.concatenate((left, right))
                order = np.lexsort((values, row))
                row, values = row[order], values[order]
                twice = (values[1:] == values[:-1]) & (row[1:] == row[:-1])
                both = np.bincount(row[1:][twice], minlength=len(n))
                good = (both > 0) & (100 * both >= threshold * (n + m - both))
                yield from pa.Table.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good)).to_batches()

    named = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long").distinct()


def classes_of(docs: DataFrame, text: str, scratch: Scratch, rows_too: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, class_id) of all rows, and (doc_id, text) of one row of each class, in buckets.

    With rows_too the second also has the other columns of the rows, as a struct `row`. Texts
    are moved once, into the buckets, and later steps read them there.
    """
    small_batches(docs.sparkSession)
    rows = scratch.save(_described(docs, text), "rows")
    usable = rows.where("n > 0 and doc_id is not null")
    # tables of their own, so that Spark can split the hot keys of the joins with them
    heads = scratch.save(usable.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "heads")
    classes = rows.join(heads, "digest", "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))
    classes = scratch.save(classes, "classes")
    least = classes.where("doc_id = class_id").select("doc_id").distinct()
    whole = [F.struct(*(c for c in docs.columns if c != text)).alias("row")] if rows_too else []
    # by a merge at every size, since the rows are dealt to buckets by id anyway
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), *whole).join(least.hint("merge"), "doc_id", "left_semi")
    sets = scratch.bucketed(sets, "sets", "doc_id")
    return classes, sets


def settled(lists: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch, longest: int | None = None) -> DataFrame:
    """(node, component) of all linked sets, from the lists (key, parts, doc_id, n, place and heads) they meet in.

    Every pair of a list whose sets can be similar is compared, or known to be of one
    component already; sets (doc_id, text) holds the texts of all ids. Where `longest` is
    given, sets of longer lists are only compared where they also share a shingle of their
    prefixes, as all similar ones do.
    """
    # every set with the two sets that its lists name, and those of parts with those of the whole
    ordered = lambda x: x.where("a <> b").where(_possible(threshold)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    mine = [F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a")]
    pairs = [ordered(lists.select(*mine, *(F.col(f"{h}_{c}").alias(x) for c, x in (("doc", "b"), ("n", "n_b"), ("place", "place_b"))))) for h in ("first", "any")]
    heads = lists.where("parts > 1").select("key", F.col("first_doc").alias("a"), F.col("first_n").alias("n_a"), F.col("first_place").alias("place_a")).distinct()
    whole = heads.groupBy("key").agg(F.min(F.struct("place_a", F.xxhash64("a").alias("h"), "a", "n_a")).alias("m"))
    whole = whole.select("key", F.col("m.a").alias("b"), F.col("m.n_a").alias("n_b"), F.col("m.place_a").alias("place_b"))
    near = scratch.save(pairs[0].union(pairs[1]).union(ordered(heads.join(whole, "key"))).distinct(), "near")
    links = scratch.save(_verified(near, sets, threshold), "links")
    known = scratch.save(components(links, scratch, "first"), "known")

    # whatever is together in a list and not known to belong together
    labelled = lists.select("key", "doc_id", "n", "place").join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = labelled.select("key", "doc_id", "n", "place", F.coalesce("component", "doc_id").alias("c"))
    labelled = _open(labelled, scratch, "open")
    rest = _met(labelled.where(F.col("k") <= longest) if longest else labelled, threshold)
    if longest:
        rest = rest.union(_met(_prefixed(labelled.where(F.col("k") > longest), sets, threshold, scratch), threshold))
    rest = rest.distinct().join(near, ["a", "b"], "left_anti")
    more = scratch.save(_verified(scratch.save(rest, "rest"), sets, threshold), "more")
    stars = known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = components(stars.union(more), scratch, "second")
    found = scratch.save(found, "parts")
    scratch.drop("open", "open_keys", "prefixes", "prefixes_open", "prefixes_open_keys", "rest", "near", "links", "more", "known")
    return found


def _open(labelled: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The lists (key, doc_id, n, place, c) whose sets are of several components c, with their length k."""
    keys = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("key", "k")
    return scratch.save(labelled.join(scratch.save(keys, f"{name}_keys"), "key"), name)


def _met(labelled: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of a list that are of two components and can be similar.

    The smaller set of such a pair has its shared shingle early, in the part of its order
    that it can lack; the few rows for which this holds are joined with all.
    """
    side = lambda x: labelled.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "place", "c")))
    early = side("a").where(F.greatest("place_a", F.lit(0)) * (100 + threshold) <= F.col("n_a") * (100 - threshold))
    both = early.join(side("b"), "key").where("c_a <> c_b and (n_a < n_b or n_a = n_b and doc_id_a < doc_id_b)").where(_possible(threshold))
    return both.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"))


def _prefixed(labelled: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """The sets of some lists in other lists, of the shingles of their prefixes, so that similar ones still meet."""
    of = labelled.select("doc_id", "c").distinct()
    texts = sets.select("doc_id", "text").join(of.select("doc_id").hint("merge"), "doc_id", "left_semi")
    counts = sets.sparkSession.sparkContext.broadcast(_counted(texts))
    keys = _keys(texts, counts, 0, threshold).join(of, "doc_id").select("key", "doc_id", "n", "place", "c")
    return _open(scratch.save(keys, "prefixes"), scratch, "prefixes_open")


def _similar(a: tuple, b: tuple, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks (ids, members, sizes, values) whose sets are similar."""
    n, m = a[2], b[2]
    both = np.zeros((len(n), len(m)), np.int64)
    common = np.intersect1d(a[3], b[3])
    step = max(1, CELLS // max(len(n), len(m)))
    rows = [np.repeat(np.arange(len(x[2])), x[2]) for x in (a, b)]
    for k in range(0, len(common), step):
        some = common[k : k + step]
        sides = []
        for x, row in zip((a, b), rows, strict=True):
            at = np.minimum(np.searchsorted(some, x[3]), len(some) - 1)
            has = some[at] == x[3]
            side = np.zeros((len(x[2]), len(some)), np.float32)
            side[row[has], at[has]] = 1
            sides.append(side)
        both += (sides[0] @ sides[1].T).astype(np.int64)
    return np.nonzero((both > 0) & (100 * both >= threshold * (n[:, None] + m[None] - both)))


def _links(a: tuple, b: tuple | None, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Class ids of a block, or of two, and how many documents of the other classes they link with."""
    i, j = _similar(a, b or a, threshold)
    one, two = a[0][i], (b or a)[0][j]
    weight_one, weight_two = a[1][i], (b or a)[1][j]
    # an id with several sets counts once, and not with itself
    first = np.arange(len(one))
    if any(len(np.unique(x[0])) < len(x[0]) for x in (a, b or a)):
        _, first = np.unique(np.stack([one, two]), axis=1, return_index=True)
    first = first[one[first] != two[first]]
    ids, weights = one[first], weight_two[first]
    if b:
        ids, weights = np.concatenate((ids, two[first])), np.concatenate((weights, weight_one[first]))
    ids, at = np.unique(ids, return_inverse=True)
    return ids, np.bincount(at, weights=weights, minlength=len(ids)).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, which follow each other, also across batches."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = np.stack([table[k].to_numpy() for k in keys])
        starts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
        if held and any(held[-1][k][-1].as_py() != table[k][0].as_py() for k in keys):
            yield pa.concat_tables(held)
            held = []
        for begin, end in zip(starts, starts[1:], strict=False):
            if begin and held:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(begin, end - begin))
    if held:
        yield pa.concat_tables(held)


def _counted_links(found: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """(class_id, component, members, n_links) of every class, from the components (class_id, component)."""
    members = classes.where("class_id is not null").groupBy("class_id").agg(F.count_distinct("doc_id").alias("members"), F.max("n").alias("n"))
    members = scratch.save(members.join(found, "class_id", "left"), "members")
    linked = members.where("component is not null").select(F.col("class_id").alias("doc_id"), "component", "members", "n")
    size = F.least(F.greatest(F.col("k") / BLOCKS, F.lit(BLOCK)), F.lit(MOST_BLOCK))
    full = linked.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    full = full.select("component", F.ceil(F.greatest(F.col("k") / size, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1")
    full = scratch.save(full, "full")
    small = full.count() <= BROADCAST_COMPONENTS
    rows = sets.select("doc_id", "text").join(linked.drop("n"), "doc_id").join(F.broadcast(full) if small else full, "component", "left")
    rows = rows.select("component", F.coalesce("blocks", F.lit(1)).alias("blocks"), "doc_id", "members", "text").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of whole components, the blocks of others."""
        for rows in _groups(batches, ["component", "block"]):
            values, n = _sets(rows["text"])
            block = (rows["doc_id"].to_numpy(), rows["members"].to_numpy(), n, values)
            whole = rows["blocks"][0].as_py() == 1
            ids, links = _links(block, None, threshold) if whole else (np.zeros(1, np.int64),) * 2
            blank = lambda x, kind: pa.nulls(len(ids), kind) if whole else pa.array([x], kind)  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids),
                    pa.array(links),
                    blank(rows["component"][0].as_py(), pa.int64()),
                    blank(rows["blocks"][0].as_py(), pa.int32()),
                    blank(rows["block"][0].as_py(), pa.int32()),
                    blank(np.concatenate(block[:3]).astype(np.int64).tobytes(), pa.binary()),
                    blank(values.tobytes(), pa.binary()),
                ],
                names=["class_id", "n", "component", "blocks", "block", "head", "shingles"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["component", "lo", "hi"]):
            blocks = []
            for head, shingles in zip(rows["head"].to_pylist(), rows["shingles"].to_pylist(), strict=True):
                blocks.append((*np.frombuffer(head, np.int64).reshape(3, -1), np.frombuffer(shingles, np.uint64)))
            lone = rows["lo"][0].as_py() == rows["hi"][0].as_py()
            # a block that hashing has left empty meets nothing
            if lone or len(blocks) == 2:
                ids, links = _links(blocks[0], None if lone else blocks[1], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], names=["class_id", "n"])

    dealt = rows.repartition("component", "block").sortWithinPartitions("component", "block")
    dealt = scratch.save(dealt.mapInArrow(deal, "class_id long, n long, component long, blocks int, block int, head binary, shingles binary"), "blocks")
    calls = dealt.where("component is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    calls = calls.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "head", "shingles")
    met = calls.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(meet, "class_id long, n long")
    links = dealt.where("component is null").select("class_id", "n").union(met).groupBy("class_id").agg(F.sum("n").alias("n_links"))
    out = scratch.save(members.drop("n").join(links, "class_id", "left"), "linked")
    scratch.drop("members", "full", "blocks", "parts")
    return out


def by_class(classes: DataFrame, found: DataFrame, *more: Column) -> DataFrame:
    out = classes.join(found, "class_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id", "doc_id").alias("component_id"), "class_id", *more)


def join(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, class_id (least id with the same set), n_links."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    classes, sets = classes_of(docs, text, scratch)
    found = _counted_links(_found(classes, sets, threshold, scratch), classes, sets, threshold, scratch)
    scratch.drop_bucketed("sets")
    n_links = F.coalesce("n_links", F.lit(0)) + F.coalesce(F.col("members") - 1, F.lit(0))
    return by_class(classes, found, n_links.cast("long").alias("n_links"))


def _found(classes: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    counts = _counted(sets.select("doc_id", "text"))
    sizes = classes.where("doc_id = class_id").groupBy(F.least("n", F.lit(MOST_SIZE)).alias("n")).agg(F.count("*").alias("k")).collect()
    bound = _boundary({r["n"]: r["k"] for r in sizes}, _load(counts), threshold)
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    lists = scratch.save(_lists(_keys(sets.select("doc_id", "text"), shared, bound, threshold)), "lists")
    found = settled(lists, sets, threshold, scratch).withColumnRenamed("node", "class_id")
    scratch.drop("lists", "rows", "heads")
    return found


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One document of each component, the one with the least id; the columns of the input.

    The result reads the tables of scratch, which the caller clears once it is written.

    Rows with a null id stay, as they are linked with nothing. Of rows with the same id,
    which are one document, all stay or none does.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    classes, sets = classes_of(docs, text, scratch, rows_too=True)
    found = by_class(classes, _found(classes, sets, threshold, scratch))
    gone = scratch.save(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    # what stays is a class's own row, and those lie in buckets by id already; rows without
    # words or id have no class and are few
    kept = sets.join(gone.hint("merge"), "doc_id", "left_anti")
    kept = kept.select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    bare = docs.where(~worded | F.col("doc_id").isNull())
    taken = sets.select("doc_id").union(gone).distinct()
    return kept.unionByName(bare.join(taken, "doc_id", "left_anti").select(*docs.columns))
