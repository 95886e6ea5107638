"""Document fingerprints: MinHash over word shingles, banded near-duplicate join.

A shingle is a run of five words (A-Z lower-cased; runs of characters other than space and
\\x09-\\x0D), hashed to 64 bits; PERMUTATIONS universal hash functions a*x+b (mod 2^64,
upper half kept) give the signature, computed in numpy over whole Arrow batches. Equal
texts have equal fingerprints. `likeness` of two fingerprints is the part of equal
positions, an unbiased estimate of the Jaccard similarity of the shingle sets.

`near_duplicates` joins signature bands in Spark and verifies each candidate's Jaccard
similarity on the shingles themselves.

Defined results
---------------
* null text counts as empty. A text without words has the fingerprint of the empty set;
  two such fingerprints are alike (1.0), one such and any other are not (0.0), and they
  are never near-duplicates of anything.
* a text of one to four words has one shingle, its whole sequence.
* repeated rows are fingerprinted alike; extra columns are ignored; an empty table gives no rows.
* `fingerprints_with_next` orders by doc_id descending, then text; null ids come last.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jaccard_join, vectext
from .common import Scratch

PERMUTATIONS, WORDS = 128, 5
#: Rows of a band: 32 bands of 4 find a pair of similarity 0.8 with probability 1 - 5e-8.
BAND_ROWS = 4
#: Sets of a band's list whose pairs are all compared; in longer lists only those that share a rare shingle.
LONGEST = 4

_rng = np.random.default_rng(1729)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_EMPTY = np.uint32(0xFFFFFFFF)


def signatures(shingle: np.ndarray, counts: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """One row of 32-bit minima per document; all ones where it has no shingle."""
    out = np.full((len(counts), permutations), _EMPTY, np.uint32)
    some = np.flatnonzero(counts > 0)
    if not len(some):
        return out
    ends = np.cumsum(counts)
    i = 0
    while i < len(some):  # runs of documents whose shingles stay in cache
        base = int(ends[some[i]] - counts[some[i]])
        j = max(i + 1, int(np.searchsorted(ends[some], base + 16384, "right")))
        x = shingle[base : int(ends[some[j - 1]])]
        at = (ends[some[i:j]] - counts[some[i:j]]) - base
        y, top = np.empty_like(x), np.empty(len(x), np.uint32)
        for p in range(permutations):
            np.multiply(x, _A[p], out=y)
            y += _B[p]
            np.right_shift(y, np.uint64(32), out=y)
            top[:] = y
            out[some[i:j], p] = np.minimum.reduceat(top, at)
        i = j
    return out


def sign(column, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Signatures of a string column."""
    data, offs = vectext.utf8(column)
    h, _, _, counts = vectext.words(data, offs)
    return signatures(*vectext.shingles(h, counts, WORDS), permutations)


def _hex(sig: np.ndarray) -> list[str]:
    raw = sig.astype(">u4").tobytes().hex()
    width = sig.shape[1] * 8
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint): the signature in hexadecimal, 8 digits a permutation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_hex(sign(part.column(1))), pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, F.col(text).alias("text")).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def _neighbours(docs: DataFrame) -> DataFrame:
    """Rows dealt to runs of descending ids, each run also holding the next run's first row.

    Run borders are quantiles of the ids, so runs are even; the only rows moved twice are
    the first of each run. guest marks them, seq numbers the runs.
    """
    spark = docs.sparkSession
    runs = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = docs.select("doc_id")
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / runs for k in range(1, runs)], 0.1 / runs)))
    # run 0 holds the largest ids; null ids come after all others. The borders are one constant,
    # in pieces of which a row looks at one after it has looked at their first ones
    step = max(1, int(len(cuts) ** 0.5))
    pieces = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    heads_of = F.from_json(F.lit(json.dumps([p[0] for p in pieces])), "array<double>")
    inner = F.from_json(F.lit(json.dumps(pieces)), "array<array<double>>")
    below = F.size(F.filter(heads_of, lambda e: e < F.col("doc_id")))
    smaller = F.when(below == 0, 0).otherwise((below - 1) * step + F.size(F.filter(F.element_at(inner, F.greatest(below, F.lit(1))), lambda e: e < F.col("doc_id"))))
    run = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - (smaller if cuts else F.lit(0)))
    found = {r["run"]: r["head"] for r in ids.groupBy(run.alias("run")).agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(found)
    place = {r: k for k, r in enumerate(order)}
    seq = F.element_at(F.from_json(F.lit(json.dumps([place.get(r, 0) for r in range(len(cuts) + 2)])), "array<int>"), run + 1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), seq.alias("seq"))
    heads = [found[r] for r in order]
    known = [h for h in heads if h is not None]
    is_head = F.col("doc_id").isin(known) if known else F.lit(False)
    if None in heads:
        is_head = is_head | F.col("doc_id").isNull()
    is_head = F.coalesce(is_head, F.lit(False))
    before = F.pmod(F.col("seq") - 1, F.lit(max(1, len(order))))
    places = F.when(is_head, F.array(F.struct(F.col("seq").alias("seq"), F.lit(False).alias("guest")), F.struct(before.alias("seq"), F.lit(True).alias("guest"))))
    places = places.otherwise(F.array(F.struct(F.col("seq").alias("seq"), F.lit(False).alias("guest"))))
    dealt = rows.select("doc_id", "text", F.inline(places))
    n = max(1, len(order))
    return dealt.repartitionById(n, F.col("seq").cast("int")).sortWithinPartitions("guest", F.desc_nulls_last("doc_id"), "text")


def fingerprints_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of the text edited with its successor, and likenesses.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as
    many (or all) of the next document's, by descending doc_id; the last one's next is the
    first. Texts are moved once.
    """

    def head(raw: bytes, points: int) -> bytes:
        """The first code points of UTF-8 bytes."""
        a = np.frombuffer(raw, np.uint8)
        starts = np.flatnonzero((a & 0xC0) != 0x80)
        return raw if points >= len(starts) else raw[: int(starts[points])]

    def emit(ids, texts: list[bytes], following: bytes | None, next_sig):
        """All rows of `texts` but the last, or all of them where `following` is given."""
        nexts = texts[1:] + ([following] if following is not None else [])
        own = texts[: len(nexts)]
        lengths, edited = [], []
        for a, b in zip(own, nexts, strict=True):
            n = int(np.count_nonzero((np.frombuffer(a, np.uint8) & 0xC0) != 0x80))
            lengths.append(n)
            edited.append(head(a, n - n // 3) + head(b, n // 3))
        sig = sign(pa.array([x.decode() for x in [*own, nexts[-1]]], pa.large_string()))
        edit = sign(pa.array([x.decode() for x in edited], pa.large_string()))
        mine = sig[:-1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
                pa.array(_hex(mine), pa.string()),
                pa.array(_hex(edit), pa.string()),
                pa.array(likeness(mine, edit)),
                pa.array(likeness(mine, sig[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        guest = None
        for batch in batches:
            for part in vectext.slices(batch, most=1 << 20):
                data, offs = vectext.utf8(part.column(1))
                raw = data.tobytes()
                for i, g, a, b in zip(part.column(0).to_pylist(), part.column(3).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    if not g:
                        ids.append(i)
                        texts.append(raw[a:b])
                    elif guest is None:
                        guest = raw[a:b]
                if len(texts) > 1:
                    yield emit(ids[:-1], texts, None, None)
                    ids, texts = ids[-1:], texts[-1:]
        if texts:
            yield emit(ids, texts, guest if guest is not None else texts[0], None)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _neighbours(docs).mapInArrow(run, schema)


def band_keys(column) -> tuple[np.ndarray, np.ndarray]:
    """(key of every band, size of the shingle set) of the rows that have shingles."""
    h, _, _, counts = vectext.words(*vectext.utf8(column))
    values, sizes = vectext.distinct(*vectext.shingles(h, counts, WORDS))
    bands = signatures(values, sizes).reshape(len(sizes), -1, BAND_ROWS).astype(np.uint64)
    key = np.zeros(bands.shape[:2], np.uint64)
    for j in range(BAND_ROWS):
        key = vectext.mix(key ^ bands[:, :, j])
    return vectext.mix(key + np.arange(key.shape[1], dtype=np.uint64)), sizes


def near_duplicates(docs: DataFrame, threshold: int = 80, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, class_id (least id with the same set).

    Sets that share a band of the signature meet in a list; the sets of a list are
    verified against each other on all their shingles, as in the Jaccard join, so that
    what a band finds is exact. Of lists longer than LONGEST only those sets are compared
    that share a shingle of their prefixes, as all similar ones do. threshold is in hundredths.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    classes, sets = jaccard_join.classes_of(docs, text, scratch)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.slices(batch):
                key, n = band_keys(part.column(1))
                width = key.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), width)), pa.array(np.repeat(n, width).astype(np.int32))], names=["key", "doc_id", "n"]
                )

    keys = scratch.save(sets.select("doc_id", "text").mapInArrow(banded, "key long, doc_id long, n int"), "keys")
    least = [F.min(F.struct(F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"), "doc_id", "n")).alias(h) for seed, h in ((1, "first"), (2, "any"))]
    shared = scratch.save(keys.groupBy("key").agg(F.count("*").alias("met"), *least).where("met > 1"), "shared")
    named = [F.col(f"{h}.{c}").alias(f"{h}_{x}") for h in ("first", "any") for c, x in (("doc_id", "doc"), ("n", "n"))]
    bare = [F.lit(-1).alias(c) for c in ("place", "first_place", "any_place")]
    lists = keys.join(shared, "key").select("key", F.lit(1).alias("parts"), "doc_id", "n", *named, *bare)
    lists = scratch.save(lists, "lists")
    found = jaccard_join.settled(lists, sets, threshold, scratch, LONGEST).withColumnRenamed("node", "class_id")
    scratch.drop("keys", "shared", "lists", "rows", "heads")
    scratch.drop_bucketed("sets")
    return jaccard_join.by_class(classes, found)
