import pyarrow as pa
import pytest

from tests.llm.helpers import edge_docs
from tidemark.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def codec():
    with open(pieces.default_model(), "rb") as f:
        return pieces.Codec(f.read())


CASES = ["", " ", "a", " a", "a ", "  Hello  world \n x\t é \U0001f600", "a" + " " * 45 + "b", " " * 33, "<s>hi</s><unk>", "▁x", "a▁▁b", "hahahahahaha", "--------====", "a\x00b", "end ", "\n\n\n", "ﬁ Ⅷ ñ"]


def test_parity_of_cases(codec):
    ids, counts, exact, differing = codec.encode_column(pa.array([c for c in CASES if "▁" not in c]))
    assert differing == 0 and exact.all()
    at = 0
    for text, n in zip([c for c in CASES if "▁" not in c], counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == codec.reference.encode(text), repr(text)
        at += n
    for text in CASES:
        assert codec.encode([text])[0].tolist() == codec.reference.encode(text), repr(text)
        assert codec.encode_column(pa.array([text]))[0].tolist() == codec.reference.encode(text), repr(text)
        assert codec.decode(codec.reference.encode(text)) == codec.reference.decode(codec.reference.encode(text))


def test_whole_table(spark, sf, codec):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    encoded = pieces.encode(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in encoded.collect():
        assert r["pieces"] == codec.reference.encode(texts[r["doc_id"]]) and r["n_pieces"] == len(r["pieces"]) and r["round_trip"] and r["differing"] == 0
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()} == texts


def test_edges(spark):
    docs = edge_docs(spark)
    encoded = pieces.encode(docs)
    got = {r["doc_id"]: r for r in encoded.collect()}
    assert got[4]["pieces"] is None and got[3]["pieces"] == [] and got[8]["round_trip"]
    assert encoded.count() == docs.count()
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert pieces.encode(docs.limit(0)).count() == 0


def test_few_known_words(monkeypatch, codec):
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 3)
    text = "one two three four five six one two"
    for _ in range(2):
        assert codec.encode_column(pa.array([text, text]))[0].tolist() == codec.reference.encode(text) * 2


def test_unigram_models_are_rebuilt():
    """The same pieces as a unigram model: best segmentation by score, bytes for the unknown."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pieces.UNIGRAM
    for p in proto.pieces:
        if p.type == pieces.NORMAL:
            p.score = -3.0 - len(p.piece) * 0.1 + (hash(p.piece) % 1000) / 1e5
    codec = pieces.Codec(proto.SerializeToString())
    for text in ("Hello world", "été à l'école", "numbers 123 and so on"):
        assert codec.encode([text])[0].tolist() == codec.reference.encode(text)
