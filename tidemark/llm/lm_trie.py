"""Language-model scoring with an Elias-Fano n-gram trie in memory-mapped levels.

The model is an interpolated trigram model with absolute discounting; its unigrams are
add-one estimates over all training tokens, its bigrams and trigrams those seen LEAST
times or more, which is all of them. Texts are read three times, once for the counts of each order, and a
fourth time to be scored. Counts are merged per task in numpy, packed, and summed per
shard by Spark; each shard writes its part of a level into the folder that
spark.checkpoint.dir names, and every task maps the parts it needs into memory. Nothing
but a few numbers a shard passes through the driver, so the model grows with the corpus.

Levels
------
1. words by 64-bit hash, in shards of equal hash ranges: the hashes and running counts.
2. the successors of each word: pointers (Elias-Fano), word numbers, quantised discounted
   probabilities, and the quantised backoff of each context. Shards are ranges of (context,
   successor) of equal expected mass, so a hot context is spread over several.
3. the successors of each bigram: pointers (Elias-Fano), the last word's place among the
   successors of the middle word (a context-relative number), probabilities and backoffs.

A lookup finds the range of a context by its pointers and then the successor within it.

Defined results
---------------
* null text counts as empty; an empty text is one token, its end.
* no training row: every probability is 1 / (0 + 1 * (0 + 1)), all scores are 0.0.
* an unknown word has the unigram probability 1 / (N + V + 1) and gives no context.
* null doc_id is kept and counts as text "" for the held-out fold.
* repeated rows count and are scored as rows; extra columns are ignored; an empty table
  gives no rows; texts are read whole, however long.
* words are told apart by 64-bit hashes; up to 2^32 different words.
* the folder of spark.checkpoint.dir has to be mounted on driver and executors, otherwise
  building raises a ValueError; a shard that was written and is not found where it is needed
  raises a FileNotFoundError. The levels are deleted by remove(), or when the program ends.
"""

from __future__ import annotations

import atexit
import functools
import json
import mmap
import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .common import shared_dir
from .language_id import held_out_fold

#: N-grams of two and three words seen less often are left to the shorter ones.
LEAST = 1
DISCOUNT = 0.6
#: Bytes of training text that a shard stands for, of text worked on at once, and packed counts of a task.
SHARD, SLICE, HELD = 1 << 25, 1 << 22, 4_000_000
#: Steps of the quantised probabilities in a halving.
STEPS = 2048
_DECODE = np.exp2(-np.arange(1 << 16) / STEPS)
_END = np.uint64(0xE5D0E5D0E5D0E5D1)
_ONE, _LOW = np.uint64(1), np.uint64(0xFFFFFFFF)


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log2(np.maximum(p, 1e-300)) * STEPS), 65535).astype(np.uint16)


# --- monotone sequences -------------------------------------------------------------


def elias_fano(values: np.ndarray) -> dict[str, np.ndarray]:
    """A monotone sequence: lower bits packed, upper bits in unary with running counts."""
    values = values.astype(np.uint64)
    n, top = len(values), int(values[-1]) + 1 if len(values) else 1
    width = max(0, (top // max(1, n)).bit_length() - 1)
    high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    upper = np.zeros((int(high[-1]) >> 6) + 1 if n else 1, np.uint64)
    np.bitwise_or.at(upper, high >> 6, _ONE << (high & 63).astype(np.uint64))
    ones = np.bitwise_count(upper).astype(np.int64)
    lower = np.zeros((n * width >> 6) + 2, np.uint64)
    if width:
        low = values & ((_ONE << np.uint64(width)) - _ONE)
        at = np.arange(n) * width
        shift = (at & 63).astype(np.uint64)
        np.bitwise_or.at(lower, at >> 6, low << shift)
        over = np.flatnonzero((at & 63) + width > 64)
        np.bitwise_or.at(lower, (at[over] >> 6) + 1, low[over] >> (np.uint64(64) - shift[over]))
    return {"upper": upper, "before": (np.cumsum(ones) - ones).astype(np.uint32), "lower": lower, "width": np.array([width], np.int64)}


def elias_fano_at(ef: dict[str, np.ndarray], i: np.ndarray) -> np.ndarray:
    """The values at places i."""
    word = np.searchsorted(ef["before"], i.astype(np.uint32), "right") - 1
    left = (i - ef["before"][word]).astype(np.int64)
    bits = ef["upper"][word]
    at = np.zeros(len(i), np.int64)
    for step in (32, 16, 8, 4, 2, 1):  # the place of the one that has `left` ones before it
        ones = np.bitwise_count((bits >> at.astype(np.uint64)) & ((_ONE << np.uint64(step)) - _ONE)).astype(np.int64)
        go = ones <= left
        left -= np.where(go, ones, 0)
        at += np.where(go, step, 0)
    high = ((word << 6) + at - i).astype(np.uint64)
    width = int(ef["width"][0])
    if not width:
        return high.astype(np.int64)
    place = i.astype(np.int64) * width
    shift = (place & 63).astype(np.uint64)
    low = ef["lower"][place >> 6] >> shift
    over = (place & 63) + width > 64
    low = np.where(over, low | (ef["lower"][(place >> 6) + 1] << ((np.uint64(64) - shift) & np.uint64(63))), low)
    return ((high << np.uint64(width)) | (low & ((_ONE << np.uint64(width)) - _ONE))).astype(np.int64)


# --- files of a level ---------------------------------------------------------------


def _store(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another behind a line that names them; appears as a whole."""
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(line)
        for x in arrays.values():
            f.write(x.tobytes() + b"\0" * (-x.nbytes % 64))
    os.replace(own, path)


@functools.lru_cache(maxsize=100_000)
def _mapped(path: str) -> dict:
    """The arrays of a file, mapped into memory."""
    with open(path, "rb") as f:
        raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    end = raw.find(b"\n")
    out: dict = {}
    for name, (kind, n, at) in json.loads(raw[:end]).items():
        x = np.frombuffer(raw, np.dtype(kind), n, end + 1 + at)
        group, _, part = name.rpartition(".")
        if group:
            out.setdefault(group, {})[part] = x
        else:
            out[name] = x
    return out


def _named(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in arrays.items()}


def local_dir(spark) -> str:
    """The shared folder as a path that tasks can map: it has to be a mounted one."""
    where = urlparse(shared_dir(spark))
    if where.scheme not in ("", "file"):
        raise ValueError(f"the levels are mapped into memory, so spark.checkpoint.dir has to be on a mounted file system, not {where.scheme}:")
    return where.path


# --- counts on their way ------------------------------------------------------------


def _pack(x: np.ndarray) -> bytes:
    """An array of numbers, bytes of one weight side by side, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


class _Counter:
    """Counts of (shard, key) of a task; sends them packed, a row a shard."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, shard: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((key, shard))
        shard, key = shard[order], key[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (shard[1:] != shard[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.parts.append((shard[first].astype(np.int32), key[first], np.diff(np.append(first, len(key))).astype(np.int64)))
        self.held += len(first)
        if self.held > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        shard, key, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.lexsort((key, shard))
        shard, key, n = shard[order], key[order], n[order]
        begin = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(shard)).tolist(), strict=True):
            k, c = _summed(key[a:b], n[a:b])
            gaps = np.diff(k, prepend=np.uint64(0))
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int32()), pa.array([_pack(gaps)], pa.binary()), pa.array([_pack(c.astype(np.uint32))], pa.binary())], names=["shard", "keys", "counts"])


_SENT = "shard int, keys binary, counts binary"


def _gathered(groups: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The summed counts of one shard."""
    keys, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for batch in groups:
        for k, c in zip(batch.column(1), batch.column(2), strict=True):
            keys.append(np.cumsum(_unpack(k.as_py(), np.uint64), dtype=np.uint64))
            counts.append(_unpack(c.as_py(), np.uint32).astype(np.int64))
            held += len(keys[-1])
            if held > HELD:
                one = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [one[0]], [one[1]], 0
    return _summed(np.concatenate(keys), np.concatenate(counts))


# --- reading the trie ---------------------------------------------------------------


class Trie:
    """The model: where its levels lie, and numbers of each shard; small, sent to all tasks."""

    def __init__(self, root: str, shards: int):
        self.root, self.shards = root, shards
        self.tokens, self.words = 0, 0
        self.word_base = self.token_base = np.zeros(shards, np.int64)
        self.pair_low = self.pair_lead = np.zeros(shards, np.int64)
        self.edge_ids, self.edge_backoff = np.zeros(0, np.int64), np.zeros(0)
        self.written = {n: np.zeros(shards, bool) for n in (1, 2, 3)}
        atexit.register(shutil.rmtree, root, ignore_errors=True)

    def level(self, number: int, shard: int) -> dict | None:
        """A shard of a level; None where it has no n-grams. A written one that is not there is an error."""
        return _mapped(f"{self.root}/{number}/{shard}") if self.written[number][shard] else None

    def remove(self) -> None:
        """Deletes the levels; what has been scored from them has to be written before."""
        shutil.rmtree(self.root, ignore_errors=True)

    def word_shard(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def find_words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers (-1: unknown), counts and the tokens before, of sorted hashes."""
        number, count, before = np.full(len(h), -1), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        shard = self.word_shard(h)
        for s, a, b in _runs(shard):
            part = self.level(1, s)
            if part is None:
                continue
            at = np.searchsorted(part["hash"], h[a:b])
            at[at == len(part["hash"])] = 0
            there = part["hash"][at] == h[a:b]
            number[a:b] = np.where(there, at + self.word_base[s], -1)
            run = part["before"]
            count[a:b] = np.where(there, run[at + 1] - run[at], 0)
            before[a:b] = np.where(there, run[at] + self.token_base[s], 0)
        return number, count, before

    def pair_shard(self, before_a: np.ndarray, count_a: np.ndarray, before_b: np.ndarray) -> np.ndarray:
        """The shard of a pair: its expected place in the order of pairs."""
        x = before_a + count_a * (before_b / max(1, self.tokens))
        return np.minimum(x * self.shards / max(1, self.tokens), self.shards - 1).astype(np.int64)

    def word_backoff(self, number: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Backoffs of words as contexts."""
        out = np.ones(len(number))
        shard = self.pair_shard(before, count, np.zeros(len(before)))
        for s in np.unique(shard[number >= 0]).tolist():
            part = self.level(2, s)
            if part is None:
                continue
            mine = np.flatnonzero((shard == s) & (number >= 0))
            at = number[mine] - self.pair_low[s]
            inside = (at >= 0) & (at < len(part["backoff"]))
            out[mine[inside]] = _DECODE[part["backoff"][at[inside]]]
        if len(self.edge_ids):
            at = np.searchsorted(self.edge_ids, number)
            at[at == len(self.edge_ids)] = 0
            out = np.where(self.edge_ids[at] == number, self.edge_backoff[at], out)
        return out

    def find_pairs(self, a: np.ndarray, b: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in their shards (-1: none), probabilities, and the places among a's successors."""
        place, prob, relative = np.full(len(a), -1), np.zeros(len(a)), np.zeros(len(a), np.int64)
        order = np.argsort(shard, kind="stable")
        for s, first, last in _runs(shard[order]):
            mine = order[first:last]
            part = self.level(2, s)
            if part is None:
                continue
            context, at = np.unique(a[mine] - self.pair_low[s], return_inverse=True)
            begin, end = _ranges(part["pointer"], context, len(part["backoff"]))
            begin, end = begin[at], end[at]
            got = successor(part["next"], begin, end, b[mine])
            good = got >= 0
            mine, got, begin = mine[good], got[good], begin[good]
            place[mine] = got
            prob[mine] = _DECODE[part["prob"][got]]
            relative[mine] = got - begin + np.where(a[mine] == self.pair_low[s], self.pair_lead[s], 0)
        return place, prob, relative

    def find_triples(self, pair: np.ndarray, shard: np.ndarray, relative: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, backoff of the pair) of the pair and, where wanted, a successor's relative place."""
        prob, backoff = np.zeros(len(pair)), np.ones(len(pair))
        order = np.argsort(shard, kind="stable")
        for s, first, last in _runs(shard[order]):
            mine = order[first:last]
            part = self.level(3, s)
            if part is None:
                continue
            backoff[mine] = _DECODE[part["backoff"][pair[mine]]]
            mine = mine[wanted[mine]]
            begin, end = _ranges(part["pointer"], pair[mine], len(part["backoff"]))
            got = successor(part["next"], begin, end, relative[mine])
            prob[mine[got >= 0]] = _DECODE[part["prob"][got[got >= 0]]]
        return prob, backoff


def _runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, first, last + 1) of every shard that occurs in sorted numbers."""
    if not len(shard):
        return
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    yield from zip(shard[first].tolist(), first.tolist(), np.append(first[1:], len(shard)).tolist(), strict=True)


def _ranges(pointer: dict, context: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    inside = (context >= 0) & (context < n)
    safe = np.where(inside, context, 0)
    begin, end = elias_fano_at(pointer, safe), elias_fano_at(pointer, safe + 1)
    return begin, np.where(inside, end, begin)


def successor(values: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in its own sorted range of values; -1 where it doesn't."""
    low, high = begin.copy(), end.copy()
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        less = values[middle] < wanted[active]
        low[active[less]] = middle[less] + 1
        high[active[~less]] = middle[~less]
        active = active[low[active] < high[active]]
    there = np.flatnonzero(low < end)
    out = np.full(len(begin), -1)
    same = values[low[there]] == wanted[there]
    out[there[same]] = low[there[same]]
    return out


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each row, and the tokens per row."""
    h, _, _, counts = vectext.words(*vectext.utf8(column))
    return np.insert(h, np.cumsum(counts), _END), counts + 1


class _Looked:
    """The tokens of some rows with what level 1 has of them."""

    def __init__(self, trie: Trie, column):
        h, self.per_row = _tokens(column)
        distinct, self.at = np.unique(h, return_inverse=True)
        self.number, self.count, self.before = trie.find_words(distinct)
        self.first = np.zeros(len(h), bool)
        self.first[np.cumsum(self.per_row) - self.per_row] = True

    def pairs(self, trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of second words of pairs that may be in level 2; both numbers and the shard."""
        often = self.count[self.at] >= LEAST
        i = np.flatnonzero(often[1:] & often[:-1] & ~self.first[1:]) + 1
        a, b = self.at[i - 1], self.at[i]
        return i, self.number[a], self.number[b], trie.pair_shard(self.before[a], self.count[a], self.before[b])


# --- building it --------------------------------------------------------------------


def build(train: DataFrame, text: str = "text") -> Trie:
    """Counts all training rows and writes the three levels."""
    spark = train.sparkSession
    rows = train.select(F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    trie = Trie(f"{local_dir(spark)}/lm-{uuid.uuid4().hex}", max(1, -(-(size["n"] or 0) // SHARD)))
    if not size["rows"]:
        return trie

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for part in vectext.slices(batch, most=SLICE):
                h, _ = _tokens(part.column(0))
                yield from counter.add(trie.word_shard(h), h)
        yield from counter.flush()

    def write_words(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        h, n = _gathered(groups)
        _store(f"{trie.root}/1/{shard}", {"hash": h, "before": np.append(0, np.cumsum(n))})
        yield pa.RecordBatch.from_pylist([{"shard": shard, "words": len(h), "tokens": int(n.sum())}])

    per_shard = lambda sent, write, out: sent.groupBy("shard").applyInArrow(write, out).collect()
    words, tokens = np.zeros(trie.shards, np.int64), np.zeros(trie.shards, np.int64)
    for r in per_shard(rows.mapInArrow(count_words, _SENT), write_words, "shard long, words long, tokens long"):
        words[r["shard"]], tokens[r["shard"]] = r["words"], r["tokens"]
        trie.written[1][r["shard"]] = True
    trie.words, trie.tokens = int(words.sum()), int(tokens.sum())
    trie.word_base, trie.token_base = np.cumsum(words) - words, np.cumsum(tokens) - tokens
    if trie.words >= 1 << 32:
        raise ValueError("more than 2^32 different words")
    _build_pairs(trie, rows, per_shard)
    _build_triples(trie, rows, per_shard)
    return trie


def _build_pairs(trie: Trie, rows: DataFrame, per_shard) -> None:
    known = rows.sparkSession.sparkContext.broadcast(trie)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, model = _Counter(), known.value
        for batch in batches:
            for part in vectext.slices(batch, most=SLICE):
                _, a, b, shard = _Looked(model, part.column(0)).pairs(model)
                yield from counter.add(shard, a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
        yield from counter.flush()

    def write(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, model = key[0].as_py(), known.value
        pair, n = _gathered(groups)
        pair, n = pair[n >= LEAST], n[n >= LEAST]
        if not len(pair):
            return
        a = (pair >> np.uint64(32)).astype(np.int64)
        low, high = int(a[0]), int(a[-1])
        total = _counts_of(model, low, high)
        own = (n - DISCOUNT) / total[a - low]
        mass = np.bincount(a - low, weights=own, minlength=high - low + 1)
        many = np.bincount(a - low, minlength=high - low + 1)
        pointer = elias_fano(np.append(0, np.cumsum(many)))
        _store(f"{model.root}/2/{shard}", {"next": (pair & _LOW).astype(np.uint32), "prob": _quantised(own), "count": n, "backoff": _quantised(1 - mass), **_named("pointer", pointer)})
        yield pa.RecordBatch.from_pylist([{"shard": shard, "low": low, "high": high, "n": len(pair), "mass_low": float(mass[0]), "mass_high": float(mass[-1]), "many_low": int(many[0]), "many_high": int(many[-1])}])

    found = {r["shard"]: r for r in per_shard(rows.mapInArrow(count, _SENT), write, "shard long, low long, high long, n long, mass_low double, mass_high double, many_low long, many_high long")}
    trie.written[2][list(found)] = True
    # contexts at the edges of shards can go on in the next one
    low, lead, edges = np.full(trie.shards, 1 << 40), np.zeros(trie.shards, np.int64), {}
    before: tuple[int, int] = (-1, 0)  # the last context so far and its successors so far
    for s in sorted(found):
        r = found[s]
        low[s] = r["low"]
        edges[r["low"]] = edges.get(r["low"], 0.0) + r["mass_low"]
        lead[s] = before[1] if before[0] == r["low"] else 0
        if r["high"] != r["low"]:
            edges[r["high"]] = edges.get(r["high"], 0.0) + r["mass_high"]
            before = (r["high"], r["many_high"])
        else:
            before = (r["low"], int(lead[s]) + r["many_low"])
    trie.pair_low, trie.pair_lead = low, lead
    trie.edge_ids = np.array(sorted(edges), np.int64)
    trie.edge_backoff = np.array([max(1e-9, 1 - edges[k]) for k in sorted(edges)])


def _counts_of(trie: Trie, low: int, high: int) -> np.ndarray:
    """Counts of the words numbered low to high."""
    out = []
    first = max(0, int(np.searchsorted(trie.word_base, low, "right")) - 1)
    for s in range(first, trie.shards):  # no further than high
        base = int(trie.word_base[s])
        if base > high:
            break
        part = trie.level(1, s)
        if part is not None and base + len(part["hash"]) > low:
            a, b = max(0, low - base), min(len(part["hash"]), high + 1 - base)
            out.append(np.diff(part["before"][a : b + 1]))
    return np.concatenate(out)


def _build_triples(trie: Trie, rows: DataFrame, per_shard) -> None:
    known = rows.sparkSession.sparkContext.broadcast(trie)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, model = _Counter(), known.value
        for batch in batches:
            for part in vectext.slices(batch, most=SLICE):
                i, a, b, shard = _Looked(model, part.column(0)).pairs(model)
                place, _, relative = model.find_pairs(a, b, shard)
                # pairs that follow one another
                two = np.flatnonzero((i[1:] == i[:-1] + 1) & (place[1:] >= 0) & (place[:-1] >= 0))
                key = place[two].astype(np.uint64) << np.uint64(32) | relative[two + 1].astype(np.uint64)
                yield from counter.add(shard[two], key)
        yield from counter.flush()

    def write(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, model = key[0].as_py(), known.value
        triple, n = _gathered(groups)
        triple, n = triple[n >= LEAST], n[n >= LEAST]
        pair = (triple >> np.uint64(32)).astype(np.int64)
        total = model.level(2, shard)["count"]
        own = (n - DISCOUNT) / total[pair]
        mass = np.bincount(pair, weights=own, minlength=len(total))
        pointer = elias_fano(np.append(0, np.cumsum(np.bincount(pair, minlength=len(total)))))
        _store(f"{model.root}/3/{shard}", {"next": (triple & _LOW).astype(np.uint32), "prob": _quantised(own), "backoff": _quantised(1 - mass), **_named("pointer", pointer)})
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n": len(triple)}])

    trie.written[3][[r["shard"] for r in per_shard(rows.mapInArrow(count, _SENT), write, "shard long, n long")]] = True


# --- scoring ------------------------------------------------------------------------


def log_probabilities(trie: Trie, looked: _Looked) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the base and of the model's probability of every token."""
    base = (looked.count + 1) / (trie.tokens + trie.words + 1)
    single = base[looked.at]
    model = single.copy()
    i, a, b, shard = looked.pairs(trie)
    # every token after a known one is backed off from it
    follows = np.flatnonzero(~looked.first)
    backoff = trie.word_backoff(looked.number, looked.before, looked.count)
    model[follows] *= backoff[looked.at[follows - 1]]
    place, prob, relative = trie.find_pairs(a, b, shard)
    model[i] += prob
    # and from the pair before it
    spot = np.full(len(single), -1)
    spot[i] = np.arange(len(i))
    had = np.flatnonzero(place >= 0)
    had = had[i[had] + 1 < len(single)]
    had = had[~looked.first[i[had] + 1]]
    third = i[had] + 1
    mine = spot[third]
    wanted = (mine >= 0) & (place[mine] >= 0)
    prob, backoff = trie.find_triples(place[had], shard[had], relative[mine], wanted)
    model[third] = model[third] * backoff + prob
    return np.log10(base)[looked.at], np.log10(model)


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    known = docs.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            for part in vectext.slices(batch, most=SLICE):
                looked = _Looked(model, part.column(1))
                base, own = log_probabilities(model, looked)
                there = vectext.sums((looked.count > 0)[looked.at].astype(np.float64), looked.per_row)
                n = len(looked.per_row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(looked.per_row), pa.array(there.astype(np.int64)), pa.array(np.full(n, model.tokens)), pa.array(vectext.sums(base, looked.per_row)), pa.array(vectext.sums(own, looked.per_row))],
                    names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).alias("text")).mapInArrow(run, f"{id_col} {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def model_scores(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Learns from the rows outside the held-out fold and scores every row."""
    held = held_out_fold(F.col("doc_id"), folds, fold)
    found = score(docs, build(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
