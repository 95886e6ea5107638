"""Operator 12: exact round trips, framing and digests that fail, revisits."""

import gzip
import hashlib
import io
import tempfile

import pytest

from tidemark.llm import queries, warc
from tidemark.llm.common import Scratch

KIND = "page_id long, url string, html string, path string, id long, n long, record_type string, refers_to string, _digest string"
EXTRA = ("p", 5, 6, "t", "r", "d")
BIG = "große Seite \U0001f600 " * 400


def pages(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], KIND)


ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (None, "http://a/n", BIG), (3, None, BIG), (4, " ", None), (5, "http://a/ b\r\nX: y", ""), (-6, "u", "short"),
    (7, "u", "short"), (8, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 2000), (9, "u", "y" * 3_000_000), (None, "u", "z" * 1000), (None, "v", "z" * 1000), (10, "u", "w" * 999), (11, "u", "w" * 999),
]


def expected(rows):
    heads = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= warc.LEAST:
            heads[html] = max(i, heads.get(html, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        head = heads.get(html) if len(data) >= warc.LEAST else None
        head = head if head is not None and head != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if head is not None else "response", head, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive", [1, warc.ARCHIVE])
def test_round_trip(spark, archive):
    got = warc.round_trip(pages(spark, ROWS).repartition(3), archive=archive)
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)


def test_large_numbers_of_heads_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_HEADS", 0)
    got = warc.round_trip(pages(spark, ROWS))
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)


def test_no_rows(spark):
    got = warc.round_trip(pages(spark, ROWS).where("page_id > 99"))
    assert got.collect() == [] and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]


def test_payloads_come_back_and_revisits_are_resolved(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    manifest = Scratch(spark, "t").save(warc.write(warc.planned(pages(spark, ROWS), Scratch(spark, "t")), folder), "m")
    assert sum(r.records for r in manifest.collect()) == len(ROWS)
    listed = warc.found(spark, folder)
    assert sorted(r.path.rpartition("/")[2] for r in listed.collect()) == sorted(r.path.rpartition("/")[2] for r in manifest.collect())
    back = warc.resolved(warc.read(listed, payload=True)).where("record_type <> 'warcinfo'").collect()
    assert sorted(bytes(r.payload).decode() for r in back) == sorted(html or "" for _, _, html in ROWS)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes for r in back)
    assert {r.target_uri for r in back if r.record_id == "urn:x-row:5"} == {"http://a/%20b%0D%0AX:%20y"}
    assert {r.target_uri for r in back if r.record_id == "urn:x-row:4"} == {"urn:x-row:4"}


def test_members_are_plain_gzip_and_offsets_lead_to_them():
    data = warc.page_record(1, "u", b"a" * 5000, None) + warc.page_record(2, "u", b"a" * 5000, 1)
    got = list(warc.records(io.BytesIO(data), payload=True))
    assert [r.fields["warc-type"] for r in got] == ["response", "revisit"] and b"".join(got[0].parts) == b"a" * 5000 and got[1].parts == []
    assert gzip.decompress(data[got[1].offset :]).startswith(b"WARC/1.1\r\nWARC-Type: revisit")
    assert [r.payload_bytes for r in got] == [5000, 5000] and got[0].payload_digest == got[1].payload_digest


def member(text):
    return gzip.compress(text)


@pytest.mark.parametrize(
    "data, says",
    [
        (warc.page_record(1, "u", b"abc" * 900, None)[:-20], "ends early"),
        (b"not gzip at all", "no gzip member"),
        (member(b"HTTP/1.1 200 OK\r\n\r\n"), "no WARC header"),
        (member(b"WARC/1.1\r\nWARC-Type: resource\r\n\r\n"), "no Content-Length"),
        (member(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), "shorter"),
        (member(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n"), "longer"),
        (member(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), "longer"),
    ],
)
def test_broken_members(data, says):
    good = warc.page_record(1, "u", b"", None)
    with pytest.raises(ValueError, match=f"offset {len(good)}: .*{says}"):
        list(warc.records(io.BytesIO(good + data)))


def test_digests(spark):
    text = gzip.decompress(warc.page_record(1, "u", b"abc", None)).replace(b"abc\r\n", b"abd\r\n")
    assert [r.verified for r in warc.records(io.BytesIO(member(text)))] == [False]
    bare = b"WARC/1.0\r\nwarc-type:resource\r\nContent-Type: text/plain\r\nX-Long: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (r,) = warc.records(io.BytesIO(member(bare)), payload=True)
    assert (r.verified, r.parts, r.fields["x-long"], r.payload_digest) == (None, [b"abc"], "a b", hashlib.sha1(b"abc").hexdigest())
    where = tempfile.mkdtemp(prefix="spark-") + "/x.warc.gz"
    with open(where, "wb") as f:
        f.write(member(text))
    paths = spark.createDataFrame([(where,)], "path string")
    assert [r.verified for r in warc.read(paths, strict=False).collect()] == [False]
    with pytest.raises(Exception, match="a digest differs"):
        warc.read(paths).collect()


def test_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    data = b"".join(warc.page_record(i, "u", bytes([i]) * (i * 50), None) for i in range(1, 9))
    got = list(warc.records(io.BytesIO(data), payload=True))
    assert [b"".join(r.parts) for r in got] == [bytes([i]) * (i * 50) for i in range(1, 9)] and all(r.verified for r in got)


def test_query_against_its_statement(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    got = queries.op12_warc(spark, sf)
    theirs = con.execute(f"select {', '.join(got.columns)} from ({queries.oracle_sql()['op12_warc']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(theirs, key=str)
