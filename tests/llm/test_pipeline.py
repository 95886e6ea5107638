"""Every stage against brute force on what its predecessor kept."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import Union, edge_docs, shingles, words
from tests.llm.test_mixing import targets
from tidemark.llm import common, pii, quality


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    start, good, single, private, mixed, encoded = ([r.asDict() for r in d.collect()] for d in kept)
    assert all(d.columns == columns for d in kept[:5])

    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    there = {r["doc_id"] for r in good}
    assert all(r in start for r in good[:50])
    assert sum(label.get(r["doc_id"]) == 1 and r["doc_id"] not in there for r in start) <= 3
    assert sum(label.get(i) == 0 for i in there) <= 3

    sets, parts, seen = {r["doc_id"]: shingles(r["text"]) for r in good}, Union(), {}
    for i in sorted(sets):
        parts.find(i)
        for j in {j for s in sets[i] for j in seen.get(s, ())}:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parts.join(i, j)
        for s in sets[i]:
            seen.setdefault(s, []).append(i)
    assert {r["doc_id"] for r in single} == {i for i in sets if parts.find(i) == i}

    left = {r["doc_id"]: r for r in private}
    assert left.keys() == {r["doc_id"] for r in single}
    assert all(r["n_chars"] == len(r["text"]) for r in private)
    counts = pii.report(kept[3]).selectExpr("sum(n_email)", "sum(n_ip)", "sum(n_card)").first()
    assert sum(counts) == 0

    sizes, taken = {}, {}
    for r in private:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
        assert r["doc_id"] in left
    assert all(abs(taken[s] - want) <= 1 for s, want in targets(sizes).items())

    assert len(encoded) == len(mixed) and all(r["round_trip"] for r in encoded)


def test_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


@pytest.fixture(scope="module")
def labelled(tmp_path_factory):
    return str(tmp_path_factory.mktemp("edges"))


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_on_edges(spark, labelled):
    """Nulls, repeated rows, empty and very long texts, clashing columns, in each stage's own input."""
    docs = edge_docs(spark)
    columns = docs.columns
    spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{labelled}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)

    # too few labels for two classes: nothing goes
    assert plain(stage["quality"](spark, docs, labelled)) == plain(docs)

    # 1 and 2 are equal, 5 and 6 nearly so; rows without id, words or text stay, so do both rows of 10
    single = stage["near_duplicates"](spark, docs, labelled)
    assert plain(single) == plain(docs.where("doc_id is null or doc_id not in (2, 6)")) and single.columns == columns

    private = stage["personal_data"](spark, docs.withColumn("text", F.when(F.col("doc_id") == 1, "a@b.de 10.0.0.1").otherwise(F.col("text"))), labelled)
    assert private.columns == columns
    got = {r.doc_id: (r.text, r.n_chars) for r in private.collect()}
    want = {r.doc_id: (r.text, None if r.text is None else len(r.text)) for r in docs.collect()} | {1: ("<EMAIL> <IP>", 12)}
    assert got == want

    mixed = stage["mixing"](spark, docs, labelled)
    assert mixed.columns == columns
    rows = mixed.collect()
    assert not any(r.doc_id in (3, 4, 8) for r in rows) and all(r.n_chars == len(r.text) for r in rows)
    known = {r.doc_id: words(r.text, False) for r in docs.collect()}
    assert all(words(r.text, False) == known[r.doc_id][: len(words(r.text, False))] for r in rows)
    assert plain(mixed) == plain(stage["mixing"](spark, docs, labelled))

    encoded = stage["pieces"](spark, docs, labelled)
    assert encoded.count() == docs.count() and [(r.n_pieces, r.pieces) for r in encoded.where("doc_id = 4").collect()] == [(0, None)]
    assert len({tuple(r.pieces) for r in encoded.where("doc_id = 10").collect()}) == 1


def test_two_results_stand_side_by_side(spark, labelled):
    """A stage called on other rows leaves what an unwritten result still reads."""
    docs = edge_docs(spark)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    first = stage(spark, docs, labelled)
    second = stage(spark, docs.where("doc_id in (1, 2)"), labelled)
    assert second.count() == 1 and dict(corpus_pipeline.STAGES)["personal_data"](spark, second, labelled).count() == 1
    assert first.count() == docs.count() - 2


def batch_sizes(spark, path):
    """Bytes of the batches that Python workers get of a table of one partition."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    return [r["n"] for r in spark.read.parquet(path).mapInArrow(run, "n long").collect()]


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "pieces"])
def test_workers_get_bounded_batches(spark, tmp_path, name):
    path = f"{tmp_path}/documents"
    long = spark.range(0, 6000, 1, 1).selectExpr("id as doc_id", "concat('w', id, repeat(' long text', 300)) as text", "'en' as lang", "'a' as source", "3000L as n_chars")
    long.write.parquet(path)
    own = spark.newSession()
    dict(corpus_pipeline.STAGES)[name](own, own.read.parquet(path).limit(20), "/root/testdata/sf0.001")
    sizes = batch_sizes(own, path)
    assert sum(sizes) > 3 * common.BATCH_BYTES and max(sizes) < 1.2 * common.BATCH_BYTES


def test_bound_of_the_session_stays(spark, sf):
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20)
    common.small_batches(own)
    assert int(own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == 1 << 20


def test_slices_of_short_texts_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["", None] * 5000, pa.string())], names=["doc_id", "text"])
    parts = list(quality._slices(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert max(8 * quality.WIDTH * p.num_rows for p in parts) <= quality.SLICE
