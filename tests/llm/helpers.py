"""Fixtures and brute-force versions that the tests of the llm operators share."""

import re
import zlib

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, block int, score double, size string, _size int, digest string, cells string"


def edge_docs(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, clashing columns."""
    extra = (7, "k", 1, 0.5, "s", 3, "d", "c")
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45, *extra),
        (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45, *extra),
        (3, "", "en", "b", 0, *extra),
        (4, None, None, None, None, *([None] * 8)),
        (5, LONG, "de", "b", len(LONG), *extra),
        (6, LONG + " x", "de", "b", None, *extra),
        (7, "eins", None, "c", 4, *extra),
        (8, " \n\t ", "fr", "c", 4, *extra),
        (9, "Été à l’école \U0001f600 ï", "fr", "c", 20, *extra),
        (None, "no id at all here now", "en", "a", 21, *extra),
        (10, "twice the same row", "en", "b", 18, *extra),
        (10, "twice the same row", "en", "b", 18, *extra),
    ]
    return spark.createDataFrame(rows, DOCS)


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", ((text or "").translate(LOWER) if lower else text or ""))


def shingles(text, k=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def remainder(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


class Union:
    """Disjoint sets with the least member as their name."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
