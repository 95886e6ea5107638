"""Operator 13 against plain counting, and its statement in DuckDB on the test table."""

import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from tests.llm.helpers import LOWER, edge_docs
from tidemark.llm import divergence, queries


def plain(rows, least, top):
    """rows of (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        terms = [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    kept = {lang: [t for t, n in docs[lang].items() if n >= least] for lang, _ in groups}
    rate = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    out = []
    for lang, source in groups:
        terms = kept[lang]
        p = {s: {t: rate(counts[lang, s][t], sum(counts[lang, s][u] for u in terms), len(terms)) for t in terms} for one, s in groups if one == lang}
        whole = Counter({t: sum(counts[lang, s][t] for s in p) for t in terms})
        q = {t: rate(whole[t], sum(whole.values()), len(terms)) for t in terms}
        pairs = [(s, sum(abs(p[source][t] - p[s][t]) for t in terms)) for s in p if s != source]
        best = [(t, p[source][t] - q[t]) for t in terms if counts[lang, source][t] > 0 and p[source][t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", best, top)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def texts(spark):
    rows = []
    for i in range(240):
        lang, source = "en" if i % 3 else "fr", f"s{i % 7 if i % 4 else 0}"
        words = [f"w{chr(97 + (i * k) % 23)}" for k in range(1, 9 + i % 5)] + ["Été", "ÀB", "ab\U0001f600c", "Zed'zed", "AND", "and"][: i % 7]
        rows.append((i, " ".join(words) + " a1b2", lang, source))
    rows += [(900, "one", "xx", "s1"), (901, "", "xx", "s2"), (902, None, None, None), (903, "\x00nul\x00byte", "xx", "s3"), (904, "lonely", "yy", "s1"), (0, "wa wb", "en", "s0"), (0, "wa wb", "en", "s0")]
    return rows


@pytest.mark.parametrize("least, top", [(30, 50), (3, 4), (10_000, 50)])
def test_against_plain_counting(spark, monkeypatch, least, top):
    monkeypatch.setattr(divergence, "SHARD", 40)
    rows = texts(spark)
    df = spark.createDataFrame([(*r, 7, "t", 1) for r in rows], "doc_id long, text string, lang string, source string, n long, term string, rank int").repartition(5)
    got = sorted(map(tuple, divergence.audit(df, least, top).collect()))
    assert got == plain([(x[2], x[3], x[1]) for x in rows], least, top)


def test_tasks_that_hold_many_counts_add_them_up(spark, monkeypatch):
    # workers don't see what a test sets, so the tasks' functions run here
    monkeypatch.setattr(divergence, "HELD", 30)
    monkeypatch.setattr(divergence, "PIECE", 300)
    rows = texts(spark)
    def run(f, rows, schema):
        table = pa.Table.from_pylist(rows, schema=schema)
        return [r for b in f(iter(table.to_batches(max_chunksize=17))) for r in b.to_pylist()]

    docs = [{"lang": r[2] or "", "source": r[3] or "", "text": r[1] or ""} for r in rows]
    counted = run(divergence._count, docs, pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())]))
    total = Counter()
    for r in counted:
        total[r["lang"], r["source"], r["term"]] += r["n"]
    expected = Counter()
    for d in docs:
        expected.update((d["lang"], d["source"], w.translate(LOWER)) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", d["text"]))
    assert total == expected and len(counted) > len(total)
    kept = run(divergence._keep(1), counted, divergence.COUNTED)
    assert {(r["lang"], r["source"], r["term"]): r["n"] for r in kept} == expected
    assert sum(r["first"] for r in kept) == len({(r["lang"], r["term"]) for r in kept})


def test_edges(spark):
    docs = edge_docs(spark)
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    for least in (1, 30):
        assert sorted(map(tuple, divergence.audit(docs, least).collect())) == plain(rows, least, 50)
    none = divergence.audit(docs.where("false"))
    assert none.collect() == [] and none.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_query_and_statement(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    theirs = con.execute(f"select lang, source, part, item, value, rank from ({queries.oracle_sql()['op13_divergence']})").fetchall()
    assert sorted(map(tuple, queries.op13_divergence(spark, sf).collect())) == sorted(theirs)
    assert sorted(theirs) == plain(con.execute("select lang, source, text from documents").fetchall(), 30, 50)
