"""Quality classifier: co-training of a text-content and a page-metadata view.

The content view sees what is written: shares of pairs of character classes, how many
words are distinct, repeated at once, shouted or marked. The metadata view sees what a
crawler knows of the page without reading it: source, language, length and layout of
lines. Each view has a logistic classifier, first fitted on labelled rows. In every round
both score all other documents in Spark, and each hands those that it is sure of, as
pseudo-labels, to the other: the tasks add up gradient and curvature of the other view's
loss over them, which are matrices of fixed size, and the driver takes Newton steps with
these and its labelled rows. The pseudo-labels of a class weigh together PSEUDO times what its
labelled rows weigh, however many they are. Both views are then calibrated on labelled rows that neither has
seen, and their log-odds are combined by a third logistic function that scores all documents.
Both fits weigh the classes as they are among all labelled documents, however many are sampled.

Labelled rows are bounded, at most SAMPLE a class, the first by a hash of the id; all
documents outside this sample are the unlabelled side, in every round.

Defined results
---------------
* null text counts as empty; null source and language are values of their own; null
  n_chars is replaced by the length of the text.
* no labelled row of one of the classes: text_score, meta_score and score are 1.0 and
  everything is kept.
* labels that are null or not 0/1 are ignored; an id labelled twice takes the larger label.
* repeated rows are scored alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logistic, vectext
from .common import small_batches
from .language_id import held_out_fold

#: Labelled rows a class that the classifiers are fitted on, at most.
SAMPLE = 4000
ROUNDS = 4
#: How sure a view is of the pseudo-labels that it hands over, and what those of a class weigh beside labelled rows.
SURE, PSEUDO = 0.98, 0.5
RIDGE = 3.0
#: Numbers of the summed matrices that are sent in a row.
CHUNK = 4096
#: A document is kept from this score on.
KEEP = 0.5

CLASSES = 16
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\v\f", ".,;:", "!?", "#%&$*", "|", "'\"()[]{}", "<>/\\", "@_-+=~^`")):
    for _c in _chars.encode():
        _CLASS[_c] = _k + 1
_CLASS[128:192] = 14
_CLASS[192:] = 15
_SOURCES, _LANGS = 32, 8
#: Numbers of both views of a row; bytes of texts and views that a worker has in hand at once.
WIDTH = CLASSES**2 + 9 + _SOURCES + _LANGS + 4
SLICE = 1 << 20


def content_features(column) -> np.ndarray:
    """The content view of a column of texts, one row each."""
    data, offs = vectext.utf8(column)
    rows, size = len(offs) - 1, np.diff(offs)
    row = np.repeat(np.arange(rows), size)
    cls = _CLASS[data]
    pair = cls[:-1] * CLASSES + cls[1:]
    inside = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
    shares = np.bincount(row[:-1][inside] * CLASSES**2 + pair[inside], minlength=rows * CLASSES**2).reshape(rows, -1) if len(row) > 1 else np.zeros((rows, CLASSES**2))
    shares = np.sqrt(shares / np.maximum(size - 1, 1)[:, None])
    h, starts, ends, counts = vectext.words(data, offs, lower=False)
    n = np.maximum(counts, 1)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    first = (np.cumsum(counts) - counts)[counts > 0]
    again[first] = False
    share = lambda mask: vectext.sums(mask.astype(np.float64), counts) / n
    distinct = vectext.distinct(h, counts)[1] / n
    if len(h):
        last, head = cls[ends - 1], cls[starts]
        marked, shouted, piped = (last == 9) | (last == 8), (head == 2) & (cls[np.minimum(starts + 1, ends - 1)] == 2), head == 10
        length = (ends - starts).astype(np.float64)
    else:
        marked = shouted = piped = np.zeros(0, bool)
        length = np.zeros(0)
    mean = vectext.sums(length, counts) / n
    dense = np.stack([share(again), share(marked), share(shouted), share(piped), distinct, distinct * np.log1p(n), np.log1p(counts), np.minimum(mean, 40), (counts == 0).astype(float)], 1)
    return np.hstack([shares, dense])


def metadata_features(column, source, lang, n_chars) -> np.ndarray:
    """The metadata view: hashed source and language, length, layout of lines."""
    data, offs = vectext.utf8(column)
    rows = len(offs) - 1
    size = np.diff(offs)
    known = pc.is_valid(n_chars).to_numpy(zero_copy_only=False)
    points = pc.utf8_length(pc.fill_null(column, "")).to_numpy(zero_copy_only=False)
    chars = np.log1p(np.maximum(np.where(known, pc.fill_null(n_chars, 0).to_numpy(zero_copy_only=False), points), 0).astype(float))
    upto = np.concatenate(([0], np.cumsum(data == 10)))
    lines = upto[offs[1:]] - upto[offs[:-1]] + 1
    out = np.zeros((rows, _SOURCES + _LANGS + 4))
    for k, (names, buckets, base) in enumerate(((source, _SOURCES, 0), (lang, _LANGS, _SOURCES))):
        h, _, _, counts = vectext.words(*vectext.utf8(pc.replace_substring_regex(pc.fill_null(names, f"null{k}"), r"\s", "_")), lower=False)
        bucket = np.full(rows, 0)
        bucket[counts > 0] = (h % np.uint64(buckets)).astype(np.int64)
        out[np.arange(rows), base + bucket] = 1
    out[:, -4:] = np.stack([chars, chars**2 / 10, np.log(lines), np.log1p(size / lines)], 1)
    return out


_COLUMNS = ("doc_id", "text", "source", "lang", "n_chars")


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return content_features(part.column(1)), metadata_features(part.column(1), part.column(2), part.column(3), part.column(4))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return vectext.slices(batch, most=SLICE, each=8 * WIDTH)


def _needed(docs: DataFrame) -> DataFrame:
    """The columns that the views need; missing ones count as null."""
    have = set(docs.columns)
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    return docs.select("doc_id", "text", *((F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def _sampled(docs: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both views and the label of a bounded set of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                a, b = _views(part)
                both = np.hstack([a, b]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(5), vectext.lists(both.ravel(), np.full(len(both), both.shape[1]), pa.float32())], names=["doc_id", "cls", "x"])

    rows = _needed(docs).join(F.broadcast(chosen), "doc_id").select(*_COLUMNS, "cls")
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {kind}, cls int, x array<float>").toArrow()
    width = CLASSES**2 + 9
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(got), width + _SOURCES + _LANGS + 4)
    # in the order of the ids, and a repeated id counts once
    _, first = np.unique(got["doc_id"].to_numpy(), return_index=True)
    return x[first, :width].astype(np.float64), x[first, width:].astype(np.float64), got["cls"].to_numpy()[first].astype(int)


def handed(models: list, views: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """What each view learns from the other's pseudo-labels over some rows, one array a view.

    An array holds, for class 0 and then 1, the number of rows, the gradient and the curvature
    of the view's loss at its present weights. Rows of which the views are sure of different
    classes count for neither.
    """
    p = [logistic.sigmoid(_odds(m, x)) for m, x in zip(models, views, strict=True)]
    sure = [np.where(q >= SURE, 1, np.where(q <= 1 - SURE, 0, -1)) for q in p]
    torn = (sure[0] >= 0) & (sure[1] >= 0) & (sure[0] != sure[1])
    out = []
    for v in (0, 1):
        w, centre, scale = models[v][0]
        sums = []
        for cls in (0, 1):
            mine = (sure[1 - v] == cls) & ~torn
            z = np.hstack([np.ones((int(mine.sum()), 1)), (views[v][mine] - centre) / scale])
            q = logistic.sigmoid(np.clip(z @ w, -30, 30))
            sums += [[len(z)], z.T @ (q - cls), ((z * (q * (1 - q))[:, None]).T @ z).ravel()]
        out.append(np.concatenate(sums))
    return out


def _odds(model: tuple, x: np.ndarray) -> np.ndarray:
    return logistic.predict(model[1], logistic.predict(model[0], x)[:, None])


def _stepped(model: tuple, sums: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    """The view's weights after Newton steps over its labelled rows and the pseudo-labels' quadratic."""
    w, centre, scale = model
    k = len(w)
    parts = []
    for cls, part in enumerate(np.split(sums, 2)):
        share = PSEUDO * weight[y == cls].sum() / max(1.0, part[0])
        parts.append((share * part[1 : 1 + k], share * part[1 + k :].reshape(k, k)))
    z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    start = w
    for _ in range(60):
        p = logistic.sigmoid(np.clip(z @ w, -30, 30))
        g = z.T @ (weight * (p - y)) + RIDGE * w + sum(a + h @ (w - start) for a, h in parts)
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(k) + sum(h for _, h in parts)
        step = np.linalg.solve(hess, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def co_train(content: np.ndarray, meta: np.ndarray, label: np.ndarray, unlabelled: Callable[[list], list[np.ndarray]], rounds: int = ROUNDS, rates: dict[int, int] | None = None) -> dict | None:
    """The fitted views and their combination, from labelled rows and what others say.

    unlabelled: gives `handed` summed over all unlabelled rows. rates: how many documents have
    each label, where label holds a sample of them.
    """
    views = (content, meta)
    # one labelled row in three is kept for calibration
    later = np.arange(0, len(label), 3)
    early = np.setdiff1d(np.arange(len(label)), later)
    if len(set(label[early])) < 2 or len(set(label[later])) < 2:
        return None
    # the sample holds classes in other parts than the labels do
    y = label[later].astype(float)
    true = np.ones(len(y)) if rates is None else np.where(y == 1, rates[1] / (y == 1).sum(), rates[0] / (y == 0).sum())
    true = true * len(y) / true.sum()
    target = label[early].astype(float)
    weight = np.where(target == 1, 0.5 / (target == 1).sum(), 0.5 / (target == 0).sum()) * len(target)

    def calibrated(model: tuple, v: int) -> tuple:
        return model, logistic.fit(logistic.predict(model, views[v][later])[:, None], y, true)

    models = [calibrated(logistic.fit(views[v][early], target, weight, ridge=RIDGE), v) for v in (0, 1)]
    for _ in range(rounds):
        sums = unlabelled(models)
        models = [calibrated(_stepped(models[v][0], sums[v], views[v][early], target, weight), v) for v in (0, 1)]
    both = np.stack([_odds(models[v], views[v][later]) for v in (0, 1)], 1)
    return {"views": models, "both": logistic.fit(both, y, true)}


def _handed_by_all(docs: DataFrame, chosen: DataFrame) -> Callable[[list], list[np.ndarray]]:
    """`handed` over all documents but the chosen ones, added up by Spark in chunks of fixed size."""
    rest = _needed(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")

    def unlabelled(models: list) -> list[np.ndarray]:
        shared = docs.sparkSession.sparkContext.broadcast(models)
        size = [2 * (1 + len(m[0][0]) + len(m[0][0]) ** 2) for m in models]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(n) for n in size]
            for batch in batches:
                for part in _slices(batch):
                    for have, more in zip(total, handed(shared.value, _views(part)), strict=True):
                        have += more
            flat = np.concatenate(total)
            if flat.any():
                chunks = [flat[k : k + CHUNK].tobytes() for k in range(0, len(flat), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "sums"])

        def add(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(min(CHUNK, sum(size) - key[0].as_py() * CHUNK))
            for batch in groups:
                for x in batch.column(1):
                    total += np.frombuffer(x.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "sums"])

        kind = "chunk int, sums binary"
        flat = np.zeros(sum(size))
        for row in rest.mapInArrow(run, kind).groupBy("chunk").applyInArrow(add, kind).collect():
            flat[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["sums"])
        shared.unpersist()
        return [flat[: size[0]], flat[size[0] :]]

    return unlabelled


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict | None:
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("cls"))
    present = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    rates = {r["cls"]: r["n"] for r in present.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(f"cls = {c}").orderBy(*first).limit(sample) for c in (0, 1)]
    # a bounded number of ids, fixed before it is joined again and again
    ids = picked[0].union(picked[1]).toArrow()
    if not len(ids):
        return None
    chosen = docs.sparkSession.createDataFrame(ids, known.schema)
    return co_train(*_sampled(docs, chosen), _handed_by_all(docs, chosen), rates=rates)


def score(docs: DataFrame, model: dict | None, keep: float = KEEP) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in _slices(batch):
                if m:
                    z = np.stack([logistic.predict(own, logistic.predict(view, x)[:, None]) for (view, own), x in zip(m["views"], _views(part), strict=True)], 1)
                    all_p = [logistic.sigmoid(z[:, 0]), logistic.sigmoid(z[:, 1]), logistic.sigmoid(logistic.predict(m["both"], z))]
                else:
                    all_p = [np.ones(part.num_rows)] * 3
                p = [np.round(x, 9) for x in all_p]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, p), pa.array(p[2] >= keep)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _needed(docs).mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Learns labels outside the held-out fold and scores every document."""
    held = held_out_fold(F.col("doc_id"), folds, fold)
    return score(docs, fit(docs, labels.where(~held))).select("doc_id", held.alias("held_out"), "text_score", "meta_score", "score", "kept")


def keep(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows that the classifier keeps, with the columns of the input.

    The decision is made row by row beside the text, so nothing is joined back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns
    kinds = dict(docs.dtypes)
    at = [names.index(c) if c in names else -1 for c in _COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in _slices(batch):
                if m:
                    empty = {2: pa.string(), 3: pa.string(), 4: pa.int64()}
                    needed = [part.column(i) if i >= 0 else pa.nulls(part.num_rows, empty[k]) for k, i in enumerate(at)]
                    needed[2:] = [x.cast(empty[k + 2]) for k, x in enumerate(needed[2:])]
                    a, b = content_features(needed[1]), metadata_features(*needed[1:])
                    z = np.stack([logistic.predict(own, logistic.predict(view, x)[:, None]) for (view, own), x in zip(m["views"], (a, b), strict=True)], 1)
                    part = part.filter(pa.array(np.round(logistic.sigmoid(logistic.predict(m["both"], z)), 9) >= least))
                yield part

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))
