import hashlib
import random
import re

from tests.llm.helpers import edge_docs
from tidemark.llm import pii


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute(text):
    spans = [[f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for kind, (p, ok) in BASE.items()]
    return [len(s) for s in spans], hashlib.sha256(",".join(x for s in spans for x in s).encode()).hexdigest()


def check(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.report(docs).collect():
        counts, digest = brute(texts[r["doc_id"]])
        assert ([r[f"n_{k}"] for k in BASE], r["base_sha256"]) == (counts, digest), repr(texts[r["doc_id"]])


def test_whole_table(spark, sf):
    check(spark, [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_random_texts(spark):
    rng = random.Random(4)
    kinds = ["a1.@-", "0123456789 -", "0123456789.+() ", "ab@.%+-_ é\U0001f600"]
    check(spark, ["".join(rng.choice(k) for _ in range(rng.randint(0, 70))) for k in kinds for _ in range(600)])


def test_cases(spark):
    check(
        spark,
        ["mail a.b+c@x-y.co.uk, x@y", "a@b.c@d.e", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.255", "+49 (30) 123-4567 89", "+1 2", "\U0001f600 +44 20 7946 0958 é a@b.de", None, "", "1" * 5000, "a." * 4000 + "@", "5 " * 3000],
    )


def test_iban_and_scores(spark):
    docs = spark.createDataFrame([(1, "bank account DE89 3704 0044 0532 0130 00 please"), (2, "DE89 3704 0044 0532 0130 01"), (3, "credit card 4111111111111111")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert (got[1]["n_iban"], got[2]["n_iban"]) == (1, 0) and "iban:13:40" in got[1]["spans"]
    assert got[3]["scored_spans"] == "card:12:28:0.95"


def test_masks(spark):
    docs = spark.createDataFrame([(1, "write a@b.de or +49 30 1234567 or 10.0.0.1 or 4111 1111 1111 1111 or 999.1.1.1", "z"), (2, None, "z"), (3, "", "z")], "doc_id long, text string, n string")
    got = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert got == {1: "write <EMAIL> or <PHONE> or <IP> or <CARD> or 999.1.1.1", 2: None, 3: ""}


def test_edges(spark):
    docs = edge_docs(spark)
    assert pii.report(docs).count() == docs.count() and pii.report(docs.limit(0)).count() == 0
    assert pii.mask(docs).columns == docs.columns


def test_context_reaches_over_other_matches(spark):
    text = "credit 10.0.0.1 and 4111 1111 1111 1111, 5500 0000 0000 0004"
    got = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    scores = [s.rsplit(":", 1)[1] for s in got["scored_spans"].split(",") if s.startswith("card")]
    assert scores == ["0.95", "0.95"]


def test_contexts_of_crowded_matches_are_those_of_the_text(spark):
    rng = random.Random(11)
    bits = ["+12 345 678 90", "a@b.c", "x@y.zz", " tel ", "call", " 10.0.0.1", "test ", "é\U0001f600", "\n", "mail ", "4111111111111111", "credit "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    got = {r["doc_id"]: r["scored_spans"] for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        for kind, start, end, score in (s.split(":") for s in got[i].split(",") if s):
            past, ahead = text[: int(start)][-60:], text[int(end) :][:60]
            near = " ".join((re.search(r"(?s)\S{0,20}.{0,40}$", past)[0], re.search(r"(?s)^.{0,40}\S{0,20}", ahead)[0])).lower()
            want = pii.CONFIDENCE[kind] + (0.15 if re.search(pii.CONTEXT[kind], near) else 0) - (0.1 if re.search(pii.AGAINST, near) else 0)
            assert abs(float(score) - want) < 0.006, (text, kind, start)


def test_the_work_is_not_quadratic_in_the_matches(spark):
    import time

    took = {}
    for n in (10_000, 10_000, 40_000):
        docs = spark.createDataFrame([(1, " ".join(f"u{i}@mail.org" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        r = pii.report(docs).first()
        took[n] = time.time() - began
        assert r["n_email"] == n and r["scored_spans"].startswith("email:0:11:0.95,email:12:23:0.95")
    # four times the matches would take sixteen times as long
    assert took[40_000] < 10 * took[10_000]
