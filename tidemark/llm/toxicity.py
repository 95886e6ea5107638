"""Toxicity: class-conditional Kneser-Ney word models compared by length-normalised likelihood.

Both classes (toxic, ordinary) share the counts of an interpolated Kneser-Ney bigram model:

    p(w | h) = max(n(h, w) - D, 0) / n(h) + D * T(h) / n(h) * q(w)
    q(w) = max(f(w) - E, 0) / F + E * V / F / (V + 1)

n counts bigrams, f the distinct histories of a word, T(h) the distinct words after h; D and E
are estimated from counts of counts and lie in (0, 1]. A class has its own share of every
expression, backed off from the bigram to the word to all words:

    s(c, w) = (1 - o) * pi(c) + o * (max(f(c, w) - E, 0) + (1 + taken off) * pi(c)) / (f(w) + 1)

and likewise for a bigram, with its word's share in the place of pi(c). o is the posterior
probability that the classes don't share the expression as expected, from its two counts: a
rare expression has little of it and stays with the shared backoff, one that is seen again
and again in one class leaves it. All expressions count, whatever their number. The class
model is a distribution of bigrams,

    p(h, w | c) = n(h) / N * p(w | h) * g(c, h, w) / Z(c),

with g the share over pi(c) (the word's, where the bigram is not seen) and Z(c) such that it
sums up to 1 over all bigrams. The evidence of a text is the difference of the two
log-likelihoods of its bigrams divided by its number of words, and the score a logistic
function of that ratio alone, fitted on training rows that the models have not seen.

The models are fitted on at most SAMPLE labelled rows a class, the first by a hash of the
id; counts are made by Spark, and the driver holds the words and bigrams of that bounded sample.

Defined results
---------------
* null and empty texts have no evidence: they get the score of the ratio 0.
* no labelled row of one of the classes: every score is 0.0.
* rows with the same id share the label; a label counts once per document row; labels
  that are null or not 0/1 are ignored. Repeated rows are scored alike; extra columns are
  ignored; an empty table gives no rows. Whole texts are scored, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logistic, vectext
from .common import Scratch
from .language_id import held_out_fold

#: Labelled rows per class that the models are fitted on, at most.
SAMPLE = 6000
#: Prior odds that classes differ in an expression, and how firmly its share is otherwise the class's.
DIFFER, FIRM = 0.01, 100.0
#: Ratios up to about this size count as near 0.
NEAR = 0.01


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return vectext.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _bigrams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word and of the word before (1 at the row's start), words per row."""
    h, _, _, counts = vectext.words(*vectext.utf8(column))
    before = np.concatenate((np.zeros(1, np.uint64), h[:-1])) if len(h) else h
    before[(np.cumsum(counts) - counts)[counts > 0]] = np.uint64(1)
    return before, h, counts


def discount(ones: int, twos: int) -> float:
    """What is taken off every count: ones / (ones + 2 * twos), from how many are seen once and twice."""
    return min(1.0, max(0.1, ones / max(1, ones + 2 * twos)))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers by Stirling's series, begun eight further up."""
    y = x + 8
    steps = np.log(x)
    for i in range(1, 8):
        steps = steps + np.log(x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - steps


def _rising(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return _log_gamma(start + counts) - _log_gamma(start + 0.0 * counts)


def differs(counts: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The posterior probability that counts by class (two rows) don't share out as `part` says."""
    both = counts.sum(0)
    free = _rising(0.5, counts).sum(0) - _rising(1.0, both)
    firm = _rising(FIRM * part, counts).sum(0) - _rising(FIRM, both)
    return 1 / (1 + np.exp(-np.clip(np.log(DIFFER) + free - firm, -50, 50)))


def shares(counts: np.ndarray, off: float, part: np.ndarray) -> np.ndarray:
    """How expressions with these counts by class (first toxic) share out, backed off to `part`."""
    taken = np.minimum(counts, off).sum(0)
    own = (np.maximum(counts - off, 0) + (1 + taken) * part) / (counts.sum(0) + 1)
    o = differs(counts, part)
    return o * own + (1 - o) * part


class Model:
    """What the classes make of words and bigrams, looked up by hash."""

    def __init__(self, words: pa.Table):
        two = np.stack([words["f1"].to_numpy(), words["f0"].to_numpy()]).astype(np.int64)
        word = words["word"].to_numpy().view(np.uint64)
        order = np.argsort(word)
        self.word, two = word[order], two[:, order]
        f = two.sum(0)
        self.prior = (two.sum(1) / two.sum())[:, None]
        self.off = discount(int((f == 1).sum()), int((f == 2).sum()))
        #: q of every word, and of all unknown words together
        unknown = self.off * len(f) / f.sum() / (len(f) + 1)
        self.shared = np.maximum(f - self.off, 0) / f.sum() + unknown
        self.factor = shares(two, self.off, self.prior + 0.0 * two) / self.prior
        #: sum of q(w) * g(c, w) over all words
        self.whole = self.factor @ self.shared + unknown
        self.ratio = np.log(self.factor[0]) - np.log(self.factor[1])
        self.pair, self.pair_ratio = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        self.pair_off, self.total = 1.0, np.ones(2)

    @staticmethod
    def find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places of x in sorted keys, -1 where missing."""
        if not len(keys):
            return np.full(len(x), -1)
        at = np.searchsorted(keys, x)
        at[at == len(keys)] = 0
        return np.where(keys[at] == x, at, -1)

    def pairs(self, b: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """g of seen bigrams with these counts by class, and q(w) times what it has over g of the word."""
        at = np.searchsorted(self.word, b)
        part = self.prior * self.factor[:, at]
        got = shares(counts, self.pair_off, part / part.sum(0)) / self.prior
        return got, self.shared[at] * (got - self.factor[:, at])

    def evidence(self, before: np.ndarray, h: np.ndarray) -> np.ndarray:
        """log p(before, word | toxic) - log p(before, word | ordinary) of each word."""
        w, p = self.find(self.word, h), self.find(self.pair, _pair(before, h))
        out = np.where(w >= 0, self.ratio[w], 0.0)
        if len(self.pair):
            out = np.where(p >= 0, self.pair_ratio[p], out)
        return out - (np.log(self.total[0]) - np.log(self.total[1]))

    def ratios(self, column) -> np.ndarray:
        """The length-normalised log-likelihood ratio of each text."""
        before, h, counts = _bigrams(column)
        return vectext.sums(self.evidence(before, h), counts) / np.maximum(counts, 1)

    def signals(self, column) -> np.ndarray:
        """The ratio on the scale that the logistic function is fitted on: even near 0, logarithmic far away."""
        return np.arcsinh(self.ratios(column) / NEAR)[:, None]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> dict | None:
    """The class models and the logistic function, from labelled documents."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("cls"))
    rates = {r["cls"]: r["n"] for r in known.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    if not rates.get(0) or not rates.get(1):
        return None
    picked = [known.where(F.col("cls") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))
    # one in three of the sample is kept for the logistic function
    rows = docs.join(chosen, "doc_id").select("doc_id", "text", "cls", (F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(3)) == 0).alias("later"))

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.slices(batch):
                before, h, counts = _bigrams(part.column(0))
                cls = np.repeat(part.column(1).to_numpy(zero_copy_only=False), counts)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int32()), pa.array(before.view(np.int64)), pa.array(h.view(np.int64))], names=["cls", "a", "b"])

    scratch = Scratch(docs.sparkSession, "toxicity")
    counted = rows.where(~F.col("later")).select("text", F.col("cls").cast("int")).mapInArrow(bigrams, "cls int, a long, b long")
    counted = scratch.save(counted.groupBy("a", "b").agg(F.sum("cls").alias("n1"), F.sum(1 - F.col("cls")).alias("n0")), "counted")
    some = lambda x: F.sum((F.col(x) > 0).cast("long"))
    words = counted.groupBy(F.col("b").alias("word")).agg(some("n1").alias("f1"), some("n0").alias("f0")).toArrow()
    if not len(words) or not words["f1"].to_numpy().any() or not words["f0"].to_numpy().any():
        scratch.clear()
        return None
    model = Model(words)
    seen = counted.agg(F.count_if(F.col("n1") + F.col("n0") == 1).alias("ones"), F.count_if(F.col("n1") + F.col("n0") == 2).alias("twos")).first()
    model.pair_off = discount(seen["ones"], seen["twos"])
    first = docs.sparkSession.sparkContext.broadcast(model)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = first.value
        for batch in batches:
            a, b = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            counts = np.stack([batch.column(i).to_numpy() for i in (2, 3)])
            got, more = m.pairs(b, counts)
            n = counts.sum(0)
            kept = (n - m.pair_off) * got
            e = (np.log(got[0]) - np.log(got[1])).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_pair(a, b).view(np.int64)), pa.array(e), pa.array(n), *map(pa.array, (kept[0], kept[1], more[0], more[1]))], names=["a", "pair", "e", "n", "x1", "x0", "y1", "y0"]
            )

    weights = counted.mapInArrow(weighed, "a long, pair long, e float, n long, x1 double, x0 double, y1 double, y0 double")
    weights = scratch.save(weights, "weights")
    # what all bigrams of a class sum up to: the seen ones, and after every history the backed-off ones
    after = weights.groupBy("a").agg(F.sum("n").alias("n"), F.count("*").alias("types"), *(F.sum(c).alias(c) for c in ("x1", "x0", "y1", "y0")))
    sums = [F.sum(F.col(f"x{k}") + model.pair_off * F.col("types") * (F.lit(float(model.whole[1 - k])) + F.col(f"y{k}"))) / F.sum("n") for k in (1, 0)]
    model.total = np.array(after.agg(*sums).first(), float)
    pairs = weights.select("pair", "e").toArrow()
    key = pairs["pair"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    model.pair, model.pair_ratio = key[order], pairs["e"].to_numpy()[order]
    scratch.clear()
    first.unpersist()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(shared.value.signals(part.column(0))[:, 0])], names=["cls", "x"])

    later = rows.where("later").select("text", F.col("cls").cast("int")).mapInArrow(ratios, "cls int, x double").toArrow()
    y = later["cls"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    # the sample holds classes in other parts than the labels do
    weight = np.where(y == 1, rates[1] / (y == 1).sum(), rates[0] / (y == 0).sum())
    return {"model": shared, "logistic": logistic.fit(later["x"].to_numpy()[:, None], y, weight / weight.mean())}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vectext.slices(batch):
                p = np.zeros(part.num_rows)
                if model:
                    p = logistic.sigmoid(logistic.predict(model["logistic"], model["model"].value.signals(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(p, 9))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Learns labels outside the held-out fold and scores every document."""
    held = held_out_fold(F.col("doc_id"), folds, fold)
    model = fit(docs, labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
