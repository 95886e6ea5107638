import hashlib

from tests.llm.helpers import edge_docs, shingles
from tidemark.llm import minhash


def check(rows, docs):
    """rows by id against the contract worked out in Python."""
    order = sorted(docs, key=lambda d: -d[0])
    for k, (i, text) in enumerate(order):
        own, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(own)
        edited = own[: n - n // 3] + following[: n // 3]
        r = rows[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", following)):
            a, b = shingles(own), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(r[name] - true) < 0.2, (i, name, r[name], true)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in minhash.fingerprints_with_next(docs).collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(rows) == len(texts)
    check(rows, texts)
    prints = {}
    for i, t in texts:
        assert prints.setdefault(t, rows[i]["fingerprint"]) == rows[i]["fingerprint"]


def test_edges(spark):
    docs = edge_docs(spark)
    got = minhash.fingerprints_with_next(docs).collect()
    assert len(got) == docs.count()
    known = {r["doc_id"]: r for r in got}
    assert known[3]["fingerprint"] == known[4]["fingerprint"] == known[8]["fingerprint"]
    assert known[1]["fingerprint"] == known[2]["fingerprint"] != known[7]["fingerprint"]
    assert minhash.fingerprints_with_next(docs.limit(0)).count() == 0
    one = minhash.fingerprints_with_next(docs.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(120))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " more"), (4, base.replace("word60 ", "other ")), (5, " ".join(f"x{i}" for i in range(120))), (6, None), (7, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7}


def test_banded_join_on_the_whole_table_and_edges(spark, sf):
    from tests.llm.helpers import edge_docs
    from tests.llm.test_jaccard_join import brute, found

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(minhash.near_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    edges = edge_docs(spark)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(edges).collect()}
    assert (got[1], got[2], got[6], got[3], got[8], got[None]) == (1, 1, 5, 3, 8, None)
    assert minhash.near_duplicates(edges.limit(0)).count() == 0


def test_long_lists_of_bands_are_not_compared_all_with_all(spark, monkeypatch):
    """Texts that share a passage meet in long lists, but few of their pairs can be similar."""
    from tests.llm.test_jaccard_join import brute, found
    from tidemark.llm import jaccard_join

    passage = [f"p{i}" for i in range(240)]
    texts = [" ".join([*passage, *(f"u{k}x{i}" for i in range(160))]) for k in range(150)]
    # copies of some texts: similar ones, and ones that share about four fifths
    texts += [t + " more" for t in texts[:10]] + [" ".join(t.split()[: 330 + 2 * k]) for k, t in enumerate(texts[5:15])]
    rows = [(i * 37 % 170, t) for i, t in enumerate(texts)]
    compared, verified = [], jaccard_join._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert compared[1] <= 4 * len(rows), compared
