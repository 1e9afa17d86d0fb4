"""WARC records in ZIP packages: written by tasks, read by ranges without extraction.

A package holds two stored members: ``archive/pages.warc.gz``, one gzip member per record, and
``indexes/index.jsonl``, a line per record with its offset and length in the archive member. The
reader parses the end record, the ZIP64 end record and the central directory, finds where a stored
member's bytes begin, reads the index and then each record by its range.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored
from .files import open_fs, put

ARCHIVE, INDEX = "archive/pages.warc.gz", "indexes/index.jsonl"
PACKAGE_BYTES = 16 << 20  # a package closes with the record that reaches so many
_DATE = "2000-01-01T00:00:00Z"  # pages carry no time of their own
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FULL2, _FULL4 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    header: int
    packed: int
    size: int


class ZipReader:
    """Members of a ZIP file, from its directory; ``source`` is an open pyarrow input file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail_at = max(0, size - 22 - 0xFFFF - 20)
        tail = source.read_at(size - tail_at, tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20:end - 16] == b"PK\x06\x07" and (count, length, at) != (0, 0, 0) and (
                count == _FULL2 or length == _FULL4 or at == _FULL4):
            end64 = source.read_at(56, struct.unpack_from("<Q", tail, end - 12)[0])
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("damaged ZIP64 end of central directory")
            count, length, at = struct.unpack_from("<QQQ", end64, 32)
        self.members = {m.name: m for m in self._directory(source.read_at(length, at), count)}

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if raw[at:at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, size, names, extras, comment = struct.unpack_from("<IIHHH", raw, at + 20)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46:at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + names:at + 46 + names + extras]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # ZIP64: only the fields that are full above, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = next(wide) if size == _FULL4 else size
                    packed = next(wide) if packed == _FULL4 else packed
                    header = next(wide) if header == _FULL4 else header
                extra = extra[4 + n:]
            yield Member(name, method, header, packed, size)
            at += 46 + names + extras + comment

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed and has no ranges")
        head = self.source.read_at(30, m.header)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("damaged local header")
        return m.header + 30 + sum(struct.unpack_from("<HH", head, 26))

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        left = self.members[name].size - offset
        return self.source.read_at(left if length is None else min(length, left), self.start(name) + offset)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, so the payload's length stays known."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
             f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, and for a response its payload, of one WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ", 1)[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return {"fields": fields, "payload_bytes": size, "payload": payload}


def _urn(x: str | None):
    x = x and x.removeprefix("<urn:page:").removesuffix(">")
    return None if x in (None, "null") else int(x)


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, data, size, index = TaskContext.get().partitionId(), 0, [], 0, []

        def close():
            nonlocal number, data, size, index
            name = f"pages-{part:07d}-{number:07d}.zip"
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr(ARCHIVE, b"".join(data))
                z.writestr(INDEX, "".join(index))
            put(folder, name, out.getvalue())
            number, data, size, index = number + 1, [], 0, []
            return pa.record_batch({"name": pa.array([name])})

        for batch in batches:
            for page, url, html, digest, refers in zip(*batch.columns):
                page = page.as_py()
                raw = record(page, url.as_py(), (html.as_py() or "").encode(), digest.as_py(), refers.as_py())
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                data.append(pack.compress(raw) + pack.flush())
                index.append(json.dumps({"page_id": page, "offset": size, "length": len(data[-1])}) + "\n")
                size += len(data[-1])
                if size >= PACKAGE_BYTES:
                    yield close()
        if data:
            yield close()

    return write


def _read(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                with system.open_input_file(f"{path}/{name}") as source:
                    z = ZipReader(source)
                    at = z.start(ARCHIVE)
                    for line in z.read(INDEX).splitlines():
                        e = json.loads(line)
                        r = parse(zlib.decompress(source.read_at(e["length"], at + e["offset"]), 31))
                        f = r["fields"]
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if f["WARC-Type"] == "response" and (len(r["payload"]) != r["payload_bytes"] or hashlib.sha1(
                                r["payload"]).hexdigest() != digest):
                            raise ValueError(f"damaged payload of page {e['page_id']} in {name}")
                        out.append((_urn(f["WARC-Record-ID"]), r["payload_bytes"], digest, f["WARC-Type"],
                                    _urn(f.get("WARC-Refers-To"))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                      ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 1000) -> DataFrame:
    """Write a record per row of ``pages`` and return the package names.

    Of rows with equal payloads of at least ``least_bytes`` that with the largest key is a response
    and the others revisit it; smaller ones are responses. A null payload is empty, a null key can
    only revisit, rows with the same key and payload are alike. Payload groups are found on keys and
    digests alone and sent back by key, so a group of copies, however large, moves no payloads.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"),
                        body.alias("html"), F.sha1(body).alias("digest"))
    thin = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    first = (thin.groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n"))
             .where("n > 1 and leader is not null").select("digest", "leader"))
    again = (thin.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("leader")))
             .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "leader").distinct())
    whole = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return stored(whole.select("page_id", "url", "html", "digest", "leader").mapInArrow(_write(folder), "name string"),
                  "packages")


def read_packages(names: DataFrame, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every record in the packages."""
    width = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(width, "name").mapInArrow(
        _read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into packages in a new shared folder and read the records back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder), folder)


ROUND_TRIP_SQL = """
with p as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) b from pages),
m as (select h, max(page_id) top from p where b >= 1000 group by h)
select page_id, b::bigint payload_bytes, sha1(p.h) payload_digest,
       case when top is null or top = page_id then 'response' else 'revisit' end record_type,
       case when top <> page_id then top end refers_to
from p left join m on m.h = p.h and p.b >= 1000
"""
