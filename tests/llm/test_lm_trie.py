import math
import os
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import edge_docs, remainder, words
from tidemark.llm import lm_trie


def test_elias_fano():
    rng = np.random.default_rng(1)
    for _ in range(100):
        v = np.sort(rng.integers(0, rng.integers(1, 100_000), rng.integers(1, 400)))
        ef = lm_trie.elias_fano(v)
        assert (lm_trie.elias_fano_at(ef, np.arange(len(v))) == v).all()


def brute(texts, train):
    end = ("end",)
    tokens = {k: [*words(t), end] for k, t in texts.items()}
    c1, c2, c3 = Counter(), Counter(), Counter()
    for k in train:
        w = tokens[k]
        c1.update(w)
        c2.update(zip(w, w[1:], strict=False))
        c3.update(zip(w, w[1:], w[2:], strict=False))
    n, v, d = sum(c1.values()), len(c1), lm_trie.DISCOUNT
    k2, k3 = {k: x for k, x in c2.items() if x >= lm_trie.LEAST}, {k: x for k, x in c3.items() if x >= lm_trie.LEAST}
    m1, m2 = Counter(), Counter()
    for (a, _), x in k2.items():
        m1[a] += (x - d) / c1[a]
    for (a, b, _), x in k3.items():
        m2[a, b] += (x - d) / c2[a, b]
    out = {}
    for k, w in tokens.items():
        base = own = 0.0
        for i, x in enumerate(w):
            p = (c1[x] + 1) / (n + v + 1)
            base += math.log10(p)
            if i:
                a = w[i - 1]
                p = ((k2[a, x] - d) / c1[a] if (a, x) in k2 else 0) + (1 - m1[a]) * p
                if i > 1 and (w[i - 2], a) in k2:
                    q = (w[i - 2], a)
                    p = ((k3[(*q, x)] - d) / c2[q] if (*q, x) in k3 else 0) + (1 - m2[q]) * p
            own += math.log10(p)
        out[k] = (len(w), sum(c1[x] > 0 for x in w), n, base, own)
    return out


@pytest.mark.parametrize("shard", [1 << 25, 40_000])
def test_against_brute_force(spark, sf, monkeypatch, shard):
    monkeypatch.setattr(lm_trie, "SHARD", shard)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    wanted = brute(texts, [k for k in texts if remainder(k, 7) != 2])
    got = lm_trie.model_scores(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        n, known, total, base, own = wanted[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["held_out"] == (remainder(r["doc_id"], 7) == 2)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        # probabilities are quantised
        assert math.isclose(r["score"], own, rel_tol=5e-3)


def test_edges(spark):
    docs = edge_docs(spark)
    got = lm_trie.model_scores(docs).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["n_tokens"] == by_id[4]["n_tokens"] == by_id[8]["n_tokens"] == 1
    assert by_id[3]["score"] == by_id[4]["score"] < 0
    assert lm_trie.model_scores(docs.limit(0)).count() == 0
    nothing = lm_trie.score(docs, lm_trie.build(docs.limit(0))).collect()
    assert {(r["n_known"], r["base_score"], r["score"]) for r in nothing} == {(0, 0.0, 0.0)}


def test_needs_a_mounted_folder(spark, monkeypatch):
    monkeypatch.setattr(lm_trie, "shared_dir", lambda s: "hdfs://somewhere/x")
    with pytest.raises(ValueError, match="mounted"):
        lm_trie.local_dir(spark)


def test_phrases_seen_once_count(spark):
    rows = [(i, f"a{i} b{i} c{i}") for i in range(40)]
    got = lm_trie.model_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("not held_out").collect()
    assert got and all(r["score"] > r["base_score"] + 1 for r in got)


def test_a_lost_shard_is_an_error(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    trie = lm_trie.build(docs.limit(50))
    lm_trie.score(docs, trie).count()
    os.remove(f"{trie.root}/2/0")
    lm_trie._mapped.cache_clear()
    with pytest.raises(Exception, match="No such file"):
        lm_trie.score(docs.repartition(3), trie).write.format("noop").mode("overwrite").save()
    trie.remove()
    assert not os.path.exists(trie.root)
