import random

import pytest

from tests.llm.helpers import Union, edge_docs, shingles
from tidemark.llm import jaccard_join


def brute(rows):
    sets, parts = {i: shingles(t) for i, t in rows}, Union()
    ids = sorted(sets)
    for i in ids:
        parts.find(i)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parts.join(a, b)
    return {i: (len(sets[i]), parts.find(i)) for i in ids}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def planted():
    """Chains of edits, copies, short texts, texts of one passage, in all sizes."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for n in (1, 2, 4, 5, 6, 8, 9, 12, 20, 33, 60, 150, 300):
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts.append(base)
            for _ in range(4):
                base = list(base)
                for _ in range(max(1, n // 40)):
                    base[rng.randrange(len(base))] = word()
                if rng.random() < 0.5:
                    base.append(word())
                texts.append(base)
            texts.append(list(base))
    texts += [passage + [word() for _ in range(k)] for k in (0, 2, 5, 9, 14, 30, 80)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("bound", [None, 0, 12, 128])
def test_planted(spark, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr(jaccard_join, "_boundary", lambda *a: bound)
    rows = planted()
    assert found(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_lists_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART", 4)
    rows = planted()
    assert found(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(jaccard_join.join(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("block", [128, 3])
def test_all_links_are_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "CELLS", 1000 * block)
    rng = random.Random(9)
    base = [str(k) for k in range(100)]
    # near copies of one text: most pairs of them are similar too
    near = [" ".join(base[: 80 + k % 9] + [f"x{k}"]) for k in range(30)]
    rows = planted() + [(10_000 + i, t) for i, t in enumerate(near + near[:3])]
    rng.shuffle(rows)
    sets = {i: shingles(t) for i, t in rows}
    links = {i: sum(i != j and bool(x and y) and 100 * len(x & y) >= 80 * len(x | y) for j, y in sets.items()) for i, x in sets.items()}
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == links and max(links.values()) >= 30


def test_edges(spark):
    docs = edge_docs(spark)
    got = jaccard_join.join(docs).collect()
    assert len(got) == docs.count()
    known = {r["doc_id"]: r for r in got}
    assert (known[1]["component_id"], known[2]["component_id"], known[6]["component_id"]) == (1, 1, 5)
    assert (known[3]["component_id"], known[4]["n_shingles"], known[8]["component_id"]) == (3, 0, 8)
    assert known[None]["component_id"] is None and known[10]["component_id"] == 10
    kept = jaccard_join.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 8, 9, 10, 10]
    assert jaccard_join.join(docs.limit(0)).count() == 0
