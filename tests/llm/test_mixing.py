from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.helpers import edge_docs, words
from tidemark.llm import mixing


def targets(sizes):
    """The contract by rounds in plain Python."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and left * weight[s] / w > 2 * sizes[s]} if w else set()
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        capped |= over


def check(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(words(d["text"]))
    wanted = targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - wanted[r["source"]]) < 1e-6 * max(1, wanted[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, want in wanted.items():
        assert abs(taken[s] - want) <= 1


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check(rows, docs.collect())
    again = mixing.mix(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["taken"], tuple(r["shards"])) for r in rows} == {(r["doc_id"], r["taken"], tuple(r["shards"])) for r in again}
    # every shard gets its share of the draws
    per_shard = defaultdict(int)
    for r in rows:
        for s in r["shards"]:
            per_shard[s] += 1
    assert set(per_shard) == set(range(8))


def test_materialised(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    out = mixing.materialise(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == taken


def test_edges(spark):
    docs = edge_docs(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check(rows, docs.collect())
    out = mixing.materialise(docs)
    assert out.columns == docs.columns
    assert sum(len(words(r["text"])) for r in out.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_shards(spark, sf):
    """Draws go to the shards that the tree gives them, and the tree's shares are even in the mean."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wanted = defaultdict(list)
    for r in mixing.mix(docs).collect():
        wanted[r["doc_id"]] += list(r["shards"])
    got = defaultdict(list)
    for r in mixing.materialise(docs, shard="_to").select("doc_id", "_to").collect():
        got[r["doc_id"]].append(r["_to"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items() if v}
    keys = spark.range(2000).select(mixing._shares(F.lit(24).cast("long"), F.lit(64).cast("long"), F.xxhash64("id"), 8).alias("s"))
    shares = [r["s"] for r in keys.collect()]
    assert all(sum(s) == 24 and max(s) <= 8 for s in shares)
    means = [sum(s[k] for s in shares) / len(shares) for k in range(8)]
    # of a hypergeometric draw of 24 of 64 into 8: mean 3, variance 24/64 * 40/63 * 8
    assert all(abs(m - 3) < 0.15 for m in means)
    variance = sum((s[0] - 3) ** 2 for s in shares) / len(shares)
    assert abs(variance - 8 * (24 / 64) * (40 / 64) * (56 / 63)) < 0.25


def test_rows_alike_share_the_cut(spark):
    rows = [(1, "one two three four", "a")] * 9 + [(None, f"word {k}", "b") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in ("a", "b"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= (5 if s == "a" else 1)
