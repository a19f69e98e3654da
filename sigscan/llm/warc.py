"""Operator 5, WARC archives: write one gzip member per record, read them back sequentially.

Writing: each partition of pages becomes one ``.warc.gz`` file in the shared
folder (a temporary name, renamed when complete). A payload of at least
``min_bytes`` that an earlier page (by page_id) has too is written as a revisit
record without its payload. Which are is decided from ids and digests; pages
meet that decision in a join as finished gzip members, so that what it may have
to move is as small as the archives. Reading: members are decompressed incrementally,
each record is framed by its content length, and block and payload digests are
verified; memory holds one record.

Nulls, ties and odd rows: null html is an empty payload; a null url gives a urn;
rows that repeat a page_id and its payload are all the same record type; a row
without page_id is never referred to, and is a revisit if a page with an id has
its payload, else a response; an empty table gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscan.llm.common import open_fs, tidied
from sigscan.session import materialize, shared_path, ship

#: Fixed values of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of every record; archives of the same pages are then equal byte by byte.
DATE = b"2000-01-01T00:00:00Z"
_CHUNK = 1 << 18


def _urn(page_id: int | None, tie: str = "") -> bytes:
    return b"<urn:x-page:%s>" % (b"none" + tie.encode() if page_id is None else str(page_id).encode())


def _record(kind: bytes, page_id: int | None, url: str | None, digest: str, block: bytes, more: tuple[bytes, ...] = ()) -> bytes:
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]|") if url else f"urn:x-page:{page_id}"
    head = [
        VERSION,
        b"WARC-Type: " + kind,
        b"WARC-Record-ID: " + _urn(page_id, "-" + digest[:16]),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + target.encode(),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
        *more,
    ]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _http(size: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def record(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    """A response, uncompressed: an HTTP header and the payload."""
    return _record(b"response", page_id, url, digest, _http(len(payload)) + payload)


def revisit(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int) -> bytes:
    """A record that refers to the response with the same payload: the HTTP header alone."""
    return _record(b"revisit", page_id, url, digest, _http(size), (b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: " + _urn(refers_to)))


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, each decompressed as its bytes arrive."""
    z, out, begun = zlib.decompressobj(31), [], False
    while data := stream.read(_CHUNK):
        while data:
            begun = True
            out.append(z.decompress(data))
            if not z.eof:
                break
            yield b"".join(out)
            data, z, out, begun = z.unused_data, zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the archive ends inside a gzip member")


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def _header(data: bytes, start: int = 0) -> tuple[bytes, dict[bytes, bytes], int]:
    """First line, fields by lower-case name, and where the body starts."""
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        raise ValueError("a record's header has no end")
    first, _, rest = data[start:end].partition(b"\r\n")
    fields = {m[1].lower(): m[2] for m in map(_FIELD.fullmatch, rest.split(b"\r\n")) if m}
    return first, fields, end + 4


def _page_of(urn: bytes) -> int | None:
    m = re.fullmatch(rb"<urn:x-page:(-?\d+)>", urn)
    return int(m[1]) if m else None


def parse(data: bytes) -> dict:
    """A record's fields and payload; ValueError if its framing or a digest is wrong."""
    version, fields, at = _header(data)
    if not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    n = int(fields[b"content-length"])
    block = data[at : at + n]
    if len(block) != n or data[at + n :] != b"\r\n\r\n":
        raise ValueError("content length and record differ")
    if (want := fields.get(b"warc-block-digest")) and want != b"sha256:" + hashlib.sha256(block).hexdigest().encode():
        raise ValueError("wrong block digest")
    _, http, body = _header(block)
    kind, payload = fields[b"warc-type"].decode(), block[body:]
    digest = fields[b"warc-payload-digest"].removeprefix(b"sha256:").decode()
    size = int(http[b"content-length"])
    if kind == "response":
        if size != len(payload) or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("wrong payload digest")
    return {
        "page_id": _page_of(fields[b"warc-record-id"]), "url": fields[b"warc-target-uri"].decode(), "payload": payload, "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": _page_of(fields[b"warc-refers-to"]) if b"warc-refers-to" in fields else None,
    }


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 100) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``; one row (path, records) a file."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    # which payloads repeat is decided from ids and digests alone
    sums = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", key.alias("key"), F.sha2("payload", 256).alias("digest"))
    first = sums.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("digest", "first")
    again = materialize(sums.join(materialize(first, "repeated"), "digest").where("page_id is null or page_id <> first").groupBy("key", "digest").agg(F.min("first").alias("refers_to")), "revisits")

    @tidied
    def pack(batches):
        for b in batches:
            for i in range(0, b.num_rows, 128):
                s = b.slice(i, 128)
                out = []
                for page_id, url, payload in zip(*(s.column(k).to_pylist() for k in range(3)), strict=True):
                    digest = hashlib.sha256(payload).hexdigest()
                    out.append({"page_id": page_id, "key": "" if page_id is None else str(page_id), "url": url, "size": len(payload), "digest": digest, "data": member(record(page_id, url, payload, digest))})
                yield pa.RecordBatch.from_pylist(out, PACKED)

    # the size of ``again`` is known, so Spark itself broadcasts it where it is small; else the members move
    packed = rows.mapInArrow(pack, "page_id long, key string, url string, size long, digest string, data binary")
    marked = packed.join(again, ["key", "digest"], "left").select("page_id", "url", "size", "digest", "data", "refers_to")

    @tidied
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        temp, name, count = f"{base}/.{part:06d}-{uuid.uuid4().hex}", f"part-{part:06d}.warc.gz", 0
        with fs.open_output_stream(temp, compression=None) as out:
            for b in batches:
                for i in range(0, b.num_rows, 128):
                    s = b.slice(i, 128)
                    for page_id, url, size, digest, data, refers_to in zip(*(s.column(k).to_pylist() for k in range(6)), strict=True):
                        out.write(data if refers_to is None else member(revisit(page_id, url, size, digest, refers_to)))
                        count += 1
        if not count:
            fs.delete_file(temp)
            return
        fs.move(temp, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([count], pa.int64())})

    return materialize(marked.mapInArrow(run, "path string, records long"), "archives")


PACKED = pa.schema([("page_id", pa.int64()), ("key", pa.string()), ("url", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("data", pa.binary())])
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(archives: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives that ``archives`` (path) lists, verified; with ``payload`` their payloads too."""
    ship(archives.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload)

    @tidied
    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = open_fs(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as f:
                    for data in members(f):
                        row = parse(data)
                        if not payload:
                            row.pop("payload")
                        rows.append(row)
                        held += len(data) if payload else 0
                        if len(rows) >= 4096 or held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    paths = archives.select("path")
    return paths.repartition(max(archives.count(), 1), "path").mapInArrow(run, READ_SCHEMA + ", payload binary" * payload)


def warc_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 100) -> DataFrame:
    """Write the pages and read the archives back."""
    return read_warc(write_warc(pages, folder or shared_path(pages.sparkSession, "warc"), min_bytes))
