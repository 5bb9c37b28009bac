"""WARC archives: index first, then sorted and coalesced byte-range reads.

Writing makes one record per row, each its own gzip member, and an index with
path, offset, length, URL and digest of every record. Reading takes index rows
(any selection), sorts them by path and offset, joins ranges that lie close
together into one read, and parses the records of each read.

Defined results
- null payload counts as empty; null URL: no target header; control characters in a URL are percent-encoded in the header.
- of records with equal payloads that with the smallest page_id is the response, the others revisit it; rows that repeat that page_id are responses too. A null page_id revisits where the group has another id, else it is a response.
- payloads and URLs may have any length; an empty table gives an empty index; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.llm import files
from bramble.llm.common import fresh_dir, materialize, partitions

#: A new archive begins beyond so many bytes; ranges this close are read at once, up to so many bytes.
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES = 256_000_000, 65_536, 8_000_000
_ID = "urn:page:"
INDEX = "path string, offset long, length long, url string, digest string, page_id long, record_type string"
_INDEX_TYPES = {"path": pa.string(), "offset": pa.int64(), "length": pa.int64(), "url": pa.string(), "digest": pa.string(), "page_id": pa.int64(), "record_type": pa.string()}
RECORD = "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, payload binary"
_RECORD_TYPES = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}


class Record(NamedTuple):
    page_id: int | None
    record_type: str
    refers_to: int | None
    url: str | None
    payload_digest: str
    payload_bytes: int
    payload: bytes | None  # none in a revisit


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_url(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def pack(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, sha: str) -> bytes:
    """One record as a gzip member; a revisit of refers_to unless that is None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_url(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{sha}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def unpack(member: bytes) -> Record:
    """The record in a gzip member; raises if the payload does not have its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda s: int(s) if (s := s[1:-1].removeprefix(_ID)) else None
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != sha):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return Record(number(fields["WARC-Record-ID"]), fields["WARC-Type"], number(fields["WARC-Refers-To"]) if revisit else None, fields.get("WARC-Target-URI"), sha, size, None if revisit else payload)


def _table(rows: list[tuple], types: dict) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], names=list(types))


def _write(directory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, path, out, at = TaskContext.get().partitionId(), None, None, 0
        for b in batches:
            rows = []
            for page_id, url, payload, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path = files.new_name(directory, part, ".warc.gz")
                    out, at = files.open_new(path), 0
                sha = digest(payload)
                member = pack(page_id, url, payload, refers_to, sha)
                out.write(member)
                rows.append((path, at, len(member), url, sha, page_id, "response" if refers_to is None else "revisit"))
                at += len(member)
            yield _table(rows, _INDEX_TYPES)
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame, payload: str = "html", directory: str | None = None) -> DataFrame:
    """Archives all rows (page_id, url, payload) and returns the index."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), "url", body.alias("payload"), F.sha2(body, 256).alias("same"))
    repeated = rows.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first")
    # Stored, so that the join has an exchange on either side and Spark can split it at a payload that many pages have.
    rows = rows.join(materialize(repeated, "repeated"), "same", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return materialize(rows.mapInArrow(_write(directory or fresh_dir(spark, "warc")), INDEX), "warc-index")


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Reads (path, begin, end, its records) for records in the order of path and offset."""
    held: list[tuple[int, int]] = []
    path, begin, end = "", 0, 0
    for p, offset, length in rows:
        if held and (p != path or offset - end > GAP_BYTES or max(end, offset + length) - begin > READ_BYTES):
            yield path, begin, end, held
            held = []
        if not held:
            path, begin, end = p, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield path, begin, end, held


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, f = None, None
    for b in batches:
        for p, begin, end, records in _ranges(list(zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True))):
            if p != path:
                if f is not None:
                    f.close()
                path, f = p, files.open_old(p)
            data = memoryview(f.read_at(end - begin, begin))
            yield _table([unpack(data[o - begin : o - begin + n]) for o, n in records], _RECORD_TYPES)
    if f is not None:
        f.close()


def read(index: DataFrame) -> DataFrame:
    """The records of the given index rows."""
    n = partitions(index.sparkSession)
    ranges = index.select("path", "offset", "length").repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    return ranges.mapInArrow(_read, RECORD)
