"""WARC archives: written by tasks, one gzip member a record, and read back in sequence.

Writing: every task streams its rows into archives of its own in a shared folder. A task's
archives have names of their own for each attempt, and count only through the manifest, a
table that Spark commits task by task: what a lost or repeated task has left behind is never
read. Reading: an archive is one row of work. Its bytes are inflated in pieces, member by
member; Content-Length frames the block in what comes out; block and payload are digested as
they pass and held against the digests in the header. Without `payload` no record is held in memory.

Copies become revisit records (identical payload digest). Which ones are told by the SHA-256 of
the payloads, on narrow rows, combined before they are shuffled; the SHA-1 of the WARC
headers is only written and verified.

The folder has to be one that pyarrow's file systems open (mounted, hdfs, s3, gcs, ...).

Defined results
---------------
* null html is an empty payload; null and blank urls become the record's own URI; control
  characters and blanks of urls are percent-encoded.
* equal payloads of at least `least` bytes: the record with the largest id is the response,
  the others revisit it. Rows that repeat the largest id are responses too; rows with a null
  id revisit it; payloads that only rows with null ids hold are all responses.
* a row with a null id gets a record id of its own and comes back with a null id.
* an empty table gives no archive and no rows; extra columns are ignored.
* reading: a member that ends early, a block shorter or longer than its Content-Length, a
  header that is none, or, with strict, a digest that differs, raise an error that names the
  archive and the offset. Without strict `verified` says so (null: the record has no digest).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Payloads from this many bytes on are told apart from their copies.
LEAST = 1000
#: Bytes after which a task begins another archive; level of compression.
ARCHIVE, LEVEL = 512 << 20, 6
#: Bytes read and inflated at once; a record's header, and the HTTP header of a payload, at most.
PIECE, HEADER = 1 << 20, 1 << 20
#: Heads of copies up to this number are broadcast (about 100 bytes each), more are joined by a shuffle.
BROADCAST_HEADS = 50_000
DATE = "1970-01-01T00:00:00Z"
#: Names fixed by the WARC format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

OWN = "urn:x-row:"
RECORD = "path string, offset long, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, verified boolean"


def _open(path: str, write: bool = False):
    where, inner = fs.FileSystem.from_uri(path)
    if write:
        where.create_dir(inner.rpartition("/")[0])
        return where.open_output_stream(inner, compression=None)
    return where.open_input_stream(inner, compression=None)


def _uri(url: str | None, record: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url and url.strip() else record


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, block: bytes, fields: list[tuple[str, str]], level: int) -> bytes:
    """A record as one gzip member."""
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))]
    text = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join((squeeze.compress(text.encode()), squeeze.compress(block), squeeze.compress(b"\r\n\r\n"), squeeze.flush()))


def page_record(row_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = LEVEL) -> bytes:
    """A response, or, with refers_to, a revisit: the HTTP header alone, length and digest of the whole payload."""
    own = f"{OWN}{row_id}" if row_id is not None else f"urn:uuid:{uuid.uuid4()}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", f"<{own}>"), ("WARC-Target-URI", _uri(url, own)), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", _sha1(payload))]
    if refers_to is None:
        return _record("response", http + payload, fields, level)
    return _record("revisit", http, [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{OWN}{refers_to}>")], level)


def write(rows: DataFrame, folder: str, archive: int = ARCHIVE, level: int = LEVEL) -> DataFrame:
    """Writes (id long, url, html, refers_to long) as archives; returns (path, records, bytes), to be saved before it is read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size = None, None, 0, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])
        try:
            for batch in batches:
                for row_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = _open(path, write=True)
                        about = _record("warcinfo", b"format: WARC File Format 1.1\r\n", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], level)
                        size = out.write(about)
                    size += out.write(page_record(row_id, url, (html or "").encode(), refers_to, level))
                    n += 1
                    if size >= archive:
                        out.close()
                        out = None
                        yield done()
            if out is not None:
                out.close()
                out = None
                yield done()
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(run, "path string, records long, bytes long")


class _Members:
    """What the gzip members of a stream hold, one member after another, in pieces."""

    def __init__(self, stream):
        self.stream, self.raw, self.taken = stream, b"", 0
        self.inflate = None

    def begin(self) -> int | None:
        """Offset of the next member; None at the end of the stream."""
        if not self.raw:
            self._more()
        if not self.raw:
            return None
        self.inflate = zlib.decompressobj(31)
        return self.taken - len(self.raw)

    def _more(self) -> bool:
        got = self.stream.read(PIECE)
        self.taken += len(got)
        self.raw += got
        return bool(got)

    def read(self) -> bytes:
        """Up to PIECE bytes of the member; none at its end."""
        while not self.inflate.eof:
            if not self.raw and not self._more():
                raise ValueError("a gzip member ends early")
            try:
                out = self.inflate.decompress(self.raw, PIECE)
            except zlib.error as e:
                raise ValueError(f"no gzip member: {e}") from e
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                return out
        return b""


@dataclass
class Record:
    offset: int
    fields: dict[str, str]
    payload_bytes: int = 0
    payload_digest: str | None = None
    verified: bool | None = None
    parts: list[bytes] = field(default_factory=list)

    def row(self, path: str) -> list:
        bare = lambda name: re.sub(r"^<(.*)>$", r"\1", self.fields[name]) if name in self.fields else None
        return [path, self.offset, self.fields.get("warc-type"), bare("warc-record-id"), bare("warc-refers-to"), self.fields.get("warc-target-uri"), self.payload_bytes, self.payload_digest, self.verified]


def _fields(head: bytes) -> dict[str, str]:
    """Named fields below the version line; names in lower case, folded lines joined."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not lines[0].startswith((b"WARC/1.", b"WARC/0.")):
        raise ValueError("no WARC header")
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}


def _bare_sha1(value: str | None) -> str | None:
    """The lower-case hex form of a sha1 digest in base 32 or base 16; None for anything else."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if len(text) == 32:
        return base64.b32decode(text.upper()).hex()
    return text.lower() if re.fullmatch("[0-9a-fA-F]{40}", text) else None


def records(stream, payload: bool = False) -> Iterator[Record]:
    """The records of an archive, in order. Errors name the member's offset."""
    members = _Members(stream)
    while (offset := members.begin()) is not None:
        try:
            yield _one(members, offset, payload)
        except ValueError as e:
            raise ValueError(f"offset {offset}: {e}") from e


def _one(members: _Members, offset: int, keep: bool) -> Record:
    data = b""
    while (end := data.find(b"\r\n\r\n")) < 0:
        more = members.read()
        if not more or len(data) > HEADER:
            raise ValueError("no WARC header")
        data += more
    record = Record(offset, _fields(data[:end]))
    if not re.fullmatch("[0-9]+", record.fields.get("content-length", "")):
        raise ValueError("no Content-Length")
    left, data = int(record.fields["content-length"]), data[end + 4 :]
    whole, body = hashlib.sha1(), hashlib.sha1()
    # the payload of an HTTP message begins after its own header
    http: bytes | None = b"" if record.fields.get("content-type", "").startswith("application/http") else None
    told = None
    while True:
        block, data = data[:left], data[left:]
        left -= len(block)
        whole.update(block)
        if http is not None:
            http += block
            at = http.find(b"\r\n\r\n")
            if at >= 0:
                told = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", http[: at + 2])
                block, http = http[at + 4 :], None
            elif len(http) > HEADER:
                block, http = http, None
            else:
                block = b""
        body.update(block)
        record.payload_bytes += len(block)
        if keep and block:
            record.parts.append(block)
        if not left:
            break
        data = members.read()
        if not data:
            raise ValueError("the block is shorter than its Content-Length")
    while len(data) < 4 and (more := members.read()):
        data += more
    if data != b"\r\n\r\n" or members.read():
        raise ValueError("the block is longer than its Content-Length")
    revisit = record.fields.get("warc-type") == "revisit"
    stated = _bare_sha1(record.fields.get("warc-payload-digest"))
    checks = [_bare_sha1(record.fields.get("warc-block-digest"))] + ([] if revisit else [stated])
    found = [whole.hexdigest(), body.hexdigest()]
    held = [a == b for a, b in zip(checks, found, strict=False) if a]
    record.verified = all(held) if held else None
    record.payload_digest = stated if revisit else body.hexdigest()
    if revisit and told:
        record.payload_bytes = int(told[1])
    return record


def read(archives: DataFrame, payload: bool = False, strict: bool = True, path: str = "path") -> DataFrame:
    """One row a record of the archives named in a column; with `payload` also its bytes.

    payload_bytes and payload_digest (bare hex SHA-1) of a revisit are those of the payload
    it stands for, as its headers say; its own payload is empty.
    """
    schema = RECORD + (", payload binary" if payload else "")
    types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_(), *[pa.binary()] * payload]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for where in batch.column(0).to_pylist():
                rows, held = [], 0
                with _open(where) as stream:
                    try:
                        for r in records(stream, payload):
                            if strict and r.verified is False:
                                raise ValueError(f"offset {r.offset}: a digest differs")
                            rows.append(r.row(where) + ([b"".join(r.parts)] if payload else []))
                            held += 1 + sum(map(len, r.parts)) // 2000
                            if held >= 5000:
                                yield pack(rows)
                                rows, held = [], 0
                    except ValueError as e:
                        raise ValueError(f"{where}, {e}") from e
                if rows:
                    yield pack(rows)

    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select(path).repartition(parts, path).mapInArrow(run, schema)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """The archives (.warc.gz) under a folder, listed without opening them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def resolved(read_back: DataFrame) -> DataFrame:
    """Records read with their payload; each revisit with the payload of the response it refers to, null where that is missing."""
    answers = read_back.where("record_type = 'response'").groupBy(F.col("record_id").alias("_id")).agg(F.first("payload").alias("_payload"))
    both = read_back.join(answers, F.col("refers_to") == F.col("_id"), "left")
    return both.withColumn("payload", F.when(F.col("record_type") == "revisit", F.col("_payload")).otherwise(F.col("payload"))).drop("_id", "_payload")


def planned(pages: DataFrame, scratch: Scratch, least: int = LEAST, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, html, refers_to): the id of the response that a copy revisits, null for responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= least, F.sha2("html", 256))
    heads = rows.select("id", digest.alias("_digest")).where("_digest is not null").groupBy("_digest").agg(F.max("id").alias("_head"), F.count("*").alias("n"))
    heads = scratch.save(heads.where("n > 1 and _head is not null").select("_digest", "_head"), "heads")
    small = heads.count() <= BROADCAST_HEADS
    both = rows.withColumn("_key", digest).join(F.broadcast(heads) if small else heads, F.col("_key") == F.col("_digest"), "left")
    return both.select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("_head")), F.col("_head")).alias("refers_to"))


def round_trip(pages: DataFrame, least: int = LEAST, archive: int = ARCHIVE, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page, as read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, verified."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = scratch.save(write(planned(pages, scratch, least, id_col, url, html), scratch.path("archives"), archive), "manifest")
    number = lambda c: F.when(F.col(c).startswith(OWN), F.substring(c, len(OWN) + 1, 20).cast("long"))
    return read(manifest).where("record_type in ('response', 'revisit')").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "verified"
    )


SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select *, strlen(html) as n, max(page_id) over (partition by html) as head from p)
select page_id, n::bigint as payload_bytes, sha1(html) as payload_digest,
  case when n >= {LEAST} and page_id <> head then 'revisit' else 'response' end as record_type,
  case when n >= {LEAST} and page_id <> head then head end as refers_to, true as verified
from h"""
