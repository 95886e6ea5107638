"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed and rebuilt as a `tokenizers` pipeline: the normaliser (the
precompiled character map, extra white space, the marker before the text), the metaspace
marker for spaces, the unigram scores or the merges that BPE scores imply, and byte
fallback. Arrow batches of whole texts are encoded multithreaded.

Where the normaliser is the identity and no piece crosses from a letter to a space, a text
is cut before its runs of spaces and every distinct word of a batch is encoded once. Equal
scores are settled by place in SentencePiece, which a merge list cannot say: runs of
spaces, whose pieces all share one score, are merged by that rule. Each distinct word is
encoded by the reference library too, and words whose pieces differ are counted; the pieces
stay those of the rebuilt tokenizer.

Defined results
---------------
* null text: null pieces, n_pieces 0, decoded null. Empty text: no pieces, decoded empty.
* repeated rows are encoded alike; extra columns are ignored; an empty table gives no rows.
* texts are encoded whole, however long. Text that looks like a control piece is ordinary text.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .common import small_batches

SPACE = "▁"
#: Threads of one encoding worker; a worker is a task of Spark, which has a core of its own.
THREADS = 2
#: Words whose pieces a worker keeps from batch to batch, at most.
KNOWN_WORDS = 500_000
#: Bytes of text that a worker encodes at once.
SLICE = 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32))


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin..begin+size-1 of each span, one after another."""
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - (total - size), size)


class Codec:
    """A SentencePiece model rebuilt on `tokenizers`; made from the bytes of the model file."""

    def __init__(self, raw: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.trainer, self.normal = proto.trainer_spec, proto.normalizer_spec
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.unk = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.spaces = {len(p): i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL and p == SPACE * len(p)}
        self.one_space = self.spaces.get(1, -1)
        self.is_space = np.zeros(len(self.pieces), np.int64)
        for n, i in self.spaces.items():
            self.is_space[i] = n
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        #: no piece crosses from a letter to a space: the text can be cut before spaces
        self.cuts = not any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable)
        self.tokenizer = self._rebuild(usable)
        self.known = _NOTHING
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i, k in enumerate(self.kinds) if k == BYTE}
        shown = [bytes([self.bytes[i]]) if i in self.bytes else p.replace(SPACE, " ").encode() if self.kinds[i] in (NORMAL, USER) else b"" for i, p in enumerate(self.pieces)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([*map(len, shown)], np.int64)
        self.shown_begin = np.cumsum(self.shown_size) - self.shown_size

    def _merges(self, usable: list[int]) -> list[tuple[str, str]]:
        found = []
        for i in usable:
            p = self.pieces[i]
            if len(p) > 1 and (p != SPACE * len(p) or not self.cuts):
                found += [(-self.scores[i], i, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        return [(a, b) for _, _, _, a, b in sorted(found)]

    def _rebuild(self, usable: list[int]):
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        if self.trainer.model_type == BPE:
            vocab = {p: i for p, i in self.ids.items() if self.kinds[i] != CONTROL}
            merges = self._merges(usable)
            model = models.BPE(vocab=vocab, merges=merges, unk_token=self.pieces[self.unk], fuse_unk=True, byte_fallback=bool(self.trainer.byte_fallback), cache_capacity=0)
        elif self.trainer.model_type == UNIGRAM:
            model = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), unk_id=self.unk, byte_fallback=bool(self.trainer.byte_fallback))
        else:
            raise ValueError(f"model type {self.trainer.model_type} is neither unigram nor BPE")
        #: for words that are normalised and cut already
        self.words = Tokenizer(model)
        out = Tokenizer(model)
        steps = []
        if self.normal.precompiled_charsmap:
            steps.append(normalizers.Precompiled(self.normal.precompiled_charsmap))
        if self.normal.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.normal.add_dummy_prefix:
            steps.append(normalizers.Prepend(SPACE))
        if self.normal.escape_whitespaces:
            steps.append(normalizers.Replace(" ", SPACE))
        if steps:
            out.normalizer = normalizers.Sequence(steps)
        if self.cuts:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
        return out

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def _space_run(self, n: int) -> tuple[int, ...]:
        """Pieces of n spaces: equal scores, so the leftmost possible merge goes first."""
        size, after, before = [1] * n, [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(-self.scores[self.spaces[2]], i, 1, 1) for i in range(n - 1)] if 2 in self.spaces else []
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or size[i] != a or size[j] != b:
                continue
            size[i], size[j] = a + b, 0
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and size[x] + size[y] in self.spaces:
                    heapq.heappush(heap, (-self.scores[self.spaces[size[x] + size[y]]], x, size[x], size[y]))
        return tuple(self.spaces[s] for s in size if s)

    def _merge_spaces(self, ids: np.ndarray) -> np.ndarray:
        single = ids == self.one_space
        if not (single[1:] & single[:-1]).any():
            return ids
        edge = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
        out, last = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a > 1:
                out += [ids[last:a], np.array(self._space_run(b - a), ids.dtype)]
                last = b
        return np.concatenate([*out, ids[last:]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of whole texts."""
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [self._merge_spaces(x) for x in found] if self.cuts else found

    def decode(self, ids) -> str:
        """The text of piece ids; the marker before the text is taken off."""
        parts, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run.clear()
            if i is not None and self.kinds[i] != CONTROL:
                parts.append(" ⁇ " if i == self.unk else self.pieces[i].replace(SPACE, " "))
        out = "".join(parts)
        return out[1:] if self.normal.add_dummy_prefix and out.startswith(" ") else out

    def _learn(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> int:
        """Encodes the words (with the space before them) that are not known yet; how many the reference library cuts otherwise."""
        keys, begin, sizes, good, flat = self.known
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        new = np.flatnonzero(keys[at] != h) if len(keys) else np.arange(len(h))
        if len(keys) and len(keys) + len(new) > KNOWN_WORDS:
            self.known = _NOTHING
            return self._learn(h, data, starts, ends)
        if not len(new):
            return 0
        raw, starts, ends = data.tobytes(), starts[new], ends[new]
        words = [raw[a:b].decode() for a, b in zip((starts + 1).tolist(), ends.tolist(), strict=True)]
        found = [e.ids for e in self.words.encode_batch_fast([(SPACE + w).replace(" ", SPACE) for w in words], add_special_tokens=False)]
        differing = 0
        for k, (x, y) in enumerate(zip(found, self.reference.encode(words, num_threads=THREADS), strict=True)):
            if x != y and words[k]:
                found[k] = self._merge_spaces(np.array(x, np.int32)).tolist()
                differing += found[k] != y
        n = np.array([*map(len, found)], np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(n.sum()))
        # do the pieces' bytes give the word back?
        length = self.shown_size[ids]
        total = np.bincount(np.repeat(np.arange(len(n)), n), weights=length, minlength=len(n)).astype(np.int64)
        fine = total == ends - starts
        whole = np.repeat(fine, n)
        mine = self.shown[_spans(self.shown_begin[ids[whole]], length[whole])]
        differ = mine != data[_spans(starts[fine], total[fine])]
        fine[fine] = np.bincount(np.repeat(np.arange(int(fine.sum())), total[fine]), weights=differ, minlength=int(fine.sum())) == 0
        keys, order = np.unique(np.concatenate((keys, h[new])), return_index=True)
        begin = np.concatenate((begin, len(flat) + np.cumsum(n) - n))
        self.known = (keys, begin[order], np.concatenate((sizes, n))[order], np.concatenate((good, fine))[order], np.concatenate((flat, ids)))
        return differing

    def encode_column(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(ids of all rows, their number per row, rows that decode to their text, words that the reference library cuts otherwise)."""
        plain = self.cuts and self.normal.add_dummy_prefix and self.normal.name == "identity" and not self.normal.remove_extra_whitespaces
        data, offs = vectext.utf8(column)
        if not plain or SPACE.encode() in data.tobytes():
            texts = [x or "" for x in column.to_pylist()]
            found = self.encode(texts)
            known = self.reference.encode(texts, num_threads=THREADS)
            differing = sum(a.tolist() != b for a, b in zip(found, known, strict=True))
            exact = np.array([self.decode(x.tolist()) == t for x, t in zip(found, texts, strict=True)], bool)
            return np.concatenate([*found, np.zeros(0, np.int32)]), np.array([len(x) for x in found], np.int64), exact, differing
        # a space before every text that isn't empty, then cuts before runs of spaces
        some = np.flatnonzero(np.diff(offs) > 0)
        data = np.insert(data, offs[some], np.uint8(32))
        offs = offs + np.concatenate(([0], np.cumsum(np.diff(offs) > 0)))
        rows = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64), np.ones(rows, bool), 0
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        h, first, at = np.unique(vectext.hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        differing = self._learn(h, data, starts[first], ends[first])
        keys, begin, sizes, good, flat = self.known
        at = np.searchsorted(keys, h)[at]
        n = sizes[at]
        ids = flat[_spans(begin[at], n)]
        row_of = np.searchsorted(offs, starts, "right") - 1
        counts = np.bincount(row_of, weights=n, minlength=rows).astype(np.int64)
        exact = np.bincount(row_of, weights=~good[at], minlength=rows) == 0
        return ids, counts, exact, differing


@functools.lru_cache(maxsize=2)
def _codec(raw: bytes) -> Codec:
    return Codec(raw)


def encode(docs: DataFrame, model: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_pieces, pieces, round_trip, differing): piece ids of every whole text.

    model: path of the SentencePiece model on the driver; its bytes, half a megabyte for
    32,000 pieces, are broadcast. round_trip: the pieces decode to the text; differing:
    words of the row's batch whose pieces are not those of the reference library.
    """
    small_batches(docs.sparkSession)
    with open(model or default_model(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for part in vectext.slices(batch, most=SLICE):
                ids, counts, exact, differing = codec.encode_column(part.column(1))
                null = part.column(1).is_null()
                offs = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=offs[1:])
                column = pa.ListArray.from_arrays(pa.array(offs), pa.array(ids), mask=null)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), column, pa.array(exact), pa.array(np.full(len(counts), differing, np.int64))],
                    names=[id_col, "n_pieces", "pieces", "round_trip", "differing"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).alias("text")).mapInArrow(run, f"{id_col} {kind}, n_pieces long, pieces array<int>, round_trip boolean, differing long")


def decode(encoded: DataFrame, model: str | None = None, pieces: str = "pieces", id_col: str = "doc_id") -> DataFrame:
    """(id, text): the texts of piece ids; null pieces give null."""
    with open(model or default_model(), "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, F.col(pieces).alias("pieces")).mapInArrow(run, f"{id_col} {kind}, text string")
