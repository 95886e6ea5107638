"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of every labelled training text per language
on the executors (one dense array of BUCKETS numbers a language and task, summed by
Spark); the driver sees BUCKETS numbers a language, whatever the size of the corpus.
The log-probability matrix is broadcast and texts are scored batch-wise in numpy.

Defined results
---------------
* null text, or a text without any letter: `und`, score 1.0 (nothing to decide).
* no training row at all: every text is `und`, score 0.0.
* ties between languages go to the one that sorts first by code point.
* repeated rows are scored alike; extra columns are ignored; an empty table gives no rows.
* texts are scored whole, however long; null doc_id is kept and counts as text "".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext

#: log2 of the hash buckets, shared by the three orders.
BITS = 16
ORDERS = (1, 2, 3)

_FOLD = np.arange(0x250, dtype=np.uint32)
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32
_FOLD[65:91] += 32
_FOLD[0xC0:0xD7] += 32
_FOLD[0xD8:0xDF] += 32


def held_out_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32(doc_id as text) mod folds is `fold`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _grams(column) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Bucket numbers of the n-grams of each order, and their number per row."""
    data, offs = vectext.utf8(column)
    rows = len(offs) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = (data & 0xC0) != 0x80
    upto = np.concatenate(([0], np.cumsum(starts)))[offs]
    lengths = np.diff(upto)
    small = points < len(_FOLD)
    c = points.copy()
    c[small] = _FOLD[points[small]]
    # runs of spaces count once
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    row = np.repeat(np.arange(rows), lengths)[keep]
    buckets, counts = [], []
    h = c * np.uint32(0x9E3779B1)
    mask = np.uint32((1 << BITS) - 1)
    for n in ORDERS:
        if n > 1:
            h = (h[:-1] * np.uint32(0x85EBCA6B)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        good = row[n - 1 :] == row[: len(row) - n + 1] if n > 1 else np.ones(len(row), bool)
        x = h + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        b = (x & mask)[good]
        buckets.append(b)
        counts.append(np.bincount(row[: len(row) - n + 1][good] if len(row) >= n else [], minlength=rows).astype(np.int64))
    return buckets, counts


def fit(train: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.1) -> dict | None:
    """The model of all training rows with text and language: languages and log matrix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for part in vectext.slices(batch):
                for code in pc.unique(part.column(1)).to_pylist():
                    mine = part.column(0).filter(pc.equal(part.column(1), code))
                    have = seen.setdefault(code, np.zeros(1 << BITS, np.int64))
                    docs[code] = docs.get(code, 0) + len(mine)
                    for b in _grams(mine)[0]:
                        have += np.bincount(b, minlength=1 << BITS)
        for code, have in seen.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays(
                [pa.array([code] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(have[at], docs[code]), pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    got = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    if got.empty:
        return None
    codes = sorted(got["lang"].unique())
    matrix = np.zeros((len(codes), 1 << BITS))
    prior = np.zeros(len(codes))
    for k, code in enumerate(codes):
        mine = got[got["lang"] == code]
        head = mine["bucket"] == -1
        prior[k] = mine["n"][head].iloc[0]
        matrix[k, mine["bucket"][~head].to_numpy()] = mine["n"][~head].to_numpy()
    total = matrix.sum(1, keepdims=True)
    log = np.log(matrix + smoothing) - np.log(total + smoothing * (1 << BITS))
    return {"langs": codes, "log": log.astype(np.float32), "prior": np.log(prior / prior.sum())}


def predict(docs: DataFrame, model: dict | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; score is the posterior of the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in vectext.slices(batch):
                column = pc.fill_null(part.column(1), "")
                letters = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
                if m is None:
                    best, top = np.zeros(len(column), np.int64), np.zeros(len(column))
                    names = ["und"]
                else:
                    names = m["langs"]
                    buckets, counts = _grams(column)
                    total = np.tile(m["prior"], (len(column), 1))
                    for b, n in zip(buckets, counts, strict=True):
                        for k in range(len(names)):
                            total[:, k] += vectext.sums(m["log"][k][b], n)
                    best = total.argmax(1)
                    top = 1 / np.exp(np.clip(total - total.max(1, keepdims=True), -700, 0)).sum(1)
                codes = pc.if_else(pa.array(letters), pa.array(names, pa.string()).take(pa.array(best)), "und")
                top = np.where(letters, top, 1.0 if m else 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), codes, pa.array(np.round(top, 9))], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).alias("text")).mapInArrow(score, f"{id_col} {kind}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts every row."""
    model = fit(docs.where(~held_out_fold(F.col("doc_id"), folds, fold)))
    return predict(docs, model).select("doc_id", held_out_fold(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")
