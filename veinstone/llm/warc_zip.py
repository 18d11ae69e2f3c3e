"""WARC records in ZIP packages: a writer, and a reader that fetches records by byte range.

A package holds two stored (uncompressed) members: archive/data.warc.gz, one gzip member per record,
and indexes/index.cdxj with a line per record. The reader parses the end-of-directory records (ZIP64
included), the central directory and the local headers itself, then reads index and records by range;
nothing is extracted. Both sides work on any file system pyarrow knows, through the URI of the folder.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import new_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads below this many bytes are always stored as responses.
MIN_REVISIT = 1000
#: A package is closed once its record bytes reach this size; a read task fetches about READ_BYTES.
PACKAGE_BYTES, READ_BYTES = 256 << 20, 4 << 20
#: Ranges that one reading task fetches, about.
READ_TASK = 8
DATE = "2000-01-01T00:00:00Z"

_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


@dataclass(frozen=True)
class Member:
    """A ZIP member; data_at is the offset of its first data byte."""

    name: str
    method: int
    size: int
    data_at: int


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _read_at(f, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) != n:
        raise ValueError("the archive is cut short")
    return data


def zip_members(f, size: int) -> list[Member]:
    """The central directory of an open archive, ZIP64 records included. Broken input: ValueError."""
    tail_n = min(size, 65_557)
    tail = _read_at(f, size - tail_n, tail_n)
    end = tail.rfind(_EOCD)
    # the signature may also stand in the archive's comment: the true record's comment ends the file
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(_EOCD, 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<10xHII", tail, end)[0:3]
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        at = size - tail_n + end - 20
        sig, where = struct.unpack("<4s4xQ4x", _read_at(f, at, 20))
        if sig != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        sig, count, length, start = struct.unpack("<4s28xQQQ", _read_at(f, where, 56))
        if sig != _EOCD64:
            raise ValueError("no ZIP64 end of central directory")
    central, at, out = _read_at(f, start, length), 0, []
    for _ in range(count):
        sig, method, packed, full, n_name, n_extra, n_note, local = struct.unpack_from("<4s6xH8xIIHHH8xI", central, at)
        if sig != _CENTRAL:
            raise ValueError("bad central directory")
        name = central[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = central[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_note
        if 0xFFFFFFFF in (packed, full, local):
            full, packed, local = _zip64(extra, full, packed, local)
        head = _read_at(f, local, 30)
        if head[:4] != _LOCAL:
            raise ValueError("bad local header")
        a, b = struct.unpack_from("<HH", head, 26)
        out.append(Member(name, method, packed, local + 30 + a + b))
    return out


def _zip64(extra: bytes, full: int, packed: int, local: int) -> tuple[int, int, int]:
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            full, packed, local = (next(values) if x == 0xFFFFFFFF else x for x in (full, packed, local))
            return full, packed, local
        at += 4 + n
    raise ValueError("no ZIP64 sizes")


class PackageWriter:
    """Streams a package to a file: records as they come, then the index, then the directory."""

    def __init__(self, out) -> None:
        self.out, self.at, self.members, self.lines = out, 0, [], []
        self._begin(DATA)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)
        self.crc = zlib.crc32(data, self.crc)

    def _begin(self, name: str) -> None:
        self.name, self.local, self.crc = name.encode(), self.at, 0
        # sizes follow in a data descriptor (flag 3); the ZIP64 field marks them as 8 bytes wide
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4sHHHHHIIIHH", _LOCAL, 45, 0x808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name), len(extra)) + self.name + extra)
        self.start, self.crc = self.at, 0

    def _end(self) -> None:
        n, crc = self.at - self.start, self.crc
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", crc, n, n))
        self.members.append((self.name, crc, n, self.local))

    def record(self, key: object, head: dict[str, str], block: bytes) -> None:
        """One WARC record, a gzip member of its own, with an index line."""
        lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
        raw = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = z.compress(raw) + z.flush()
        self.lines.append(json.dumps({"key": key, "type": head["WARC-Type"], "offset": self.at - self.start, "length": len(data)}))
        self._put(data)

    def close(self) -> None:
        self._end()
        self._begin(INDEX)
        self._put("".join(x + "\n" for x in self.lines).encode())
        self._end()
        start = self.at
        for name, crc, n, local in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, n, n, local)
            big = 0xFFFFFFFF
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, big, big, len(name), len(extra), 0, 0, 0, 0, big) + name + extra)
        length, where = self.at - start, self.at
        self._put(struct.pack("<4sQHHIIQQQQ", _EOCD64, 44, 45, 45, 0, 0, len(self.members), len(self.members), length, start))
        self._put(struct.pack("<4sIQI", _LOCATOR, 0, where, 1))
        self._put(struct.pack("<4sHHHHIIH", _EOCD, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one inflated WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a WARC record per page into packages in folder; return the written manifest (uri, bytes, records).

    Of records with equal payloads of at least MIN_REVISIT bytes, the one with the largest key is the
    response and the others are revisits that name it. Rows that repeat the largest key too are responses.
    A null key or null URL is kept as such, a null payload is empty. A task writes files under fresh
    names and reports them in its rows; only what a committed task reports is ever read, so retried or
    duplicate attempts leave at most unread files. The join on digests is between a row per page and a
    row per repeated digest: Spark splits a hot digest.
    """
    ship_package(pages.sparkSession)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), payload.alias("p"))
    rows = rows.withColumn("n", F.octet_length("p")).withColumn("d", F.sha1("p"))
    same = rows.where(F.col("n") >= MIN_REVISIT).groupBy("d").agg(F.max("k").alias("first"), F.count("*").alias("c")).where("c > 1")
    # pages without a twin keep a null in first and are responses
    joined = rows.join(same.select("d", "first"), "d", "left").select("k", "u", "p", "d", F.when((F.col("n") >= MIN_REVISIT) & (F.col("k") < F.col("first")), F.col("first")).alias("ref"))
    schema = "uri string, bytes long, records long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_uri(folder)
        fs.create_dir(root, recursive=True)
        done, out, package = [], None, None
        for batch in batches:
            for k, u, p, d, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    name = f"part-{uuid.uuid4().hex}.wacz"
                    out = fs.open_output_stream(posixpath.join(root, name))
                    package, n = PackageWriter(out), 0
                head = {"WARC-Type": "response" if ref is None else "revisit", "WARC-Record-ID": f"<urn:page:{k}>", "WARC-Date": DATE, "Content-Type": "application/http;msgtype=response"}
                if u is not None:
                    head["WARC-Target-URI"] = "".join(x for x in u if x not in "\r\n")
                head["WARC-Payload-Digest"] = f"sha1:{d}"
                if ref is not None:
                    head |= {"WARC-Refers-To": f"<urn:page:{ref}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(p)}\r\n\r\n".encode()
                package.record(k, head, http + (p if ref is None else b""))
                n += 1
                if package.at >= PACKAGE_BYTES:
                    package.close()
                    out.close()
                    done.append((f"{folder}/{name}", package.at, n))
                    package = None
        if package is not None:
            package.close()
            out.close()
            done.append((f"{folder}/{name}", package.at, n))
        for uri, size, n in done:
            yield pa.RecordBatch.from_pydict({"uri": [uri], "bytes": [size], "records": [n]}, schema=pa.schema([("uri", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return written(joined.mapInArrow(write, schema), "packages")


def record_ranges(manifest: DataFrame) -> DataFrame:
    """Runs of neighbouring records (uri, start, lengths) of about READ_BYTES, from each package's index."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_uri(uri)
                with fs.open_input_file(path) as f:
                    members = {m.name: m for m in zip_members(f, f.size())}
                    data, index = members[DATA], members[INDEX]
                    if data.method or index.method:
                        raise ValueError(f"{uri}: members must be stored")
                    f.seek(index.data_at)
                    lines = io.BytesIO(f.read(index.size))
                starts: list[int] = []
                runs: list[list[int]] = []
                held = 0
                for line in lines:
                    x = json.loads(line)
                    if not runs or held + x["length"] > READ_BYTES:
                        starts.append(data.data_at + x["offset"])
                        runs.append([])
                        held = 0
                    runs[-1].append(x["length"])
                    held += x["length"]
                yield pa.RecordBatch.from_pydict({"uri": [uri] * len(runs), "start": pa.array(starts, pa.int64()), "lengths": pa.array(runs, pa.list_(pa.int64()))})

    return manifest.select("uri").mapInArrow(plan, "uri string, start long, lengths array<long>")


def read_records(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read all records of the packages: (page_id, record_type, refers_to, url, payload_digest, payload_bytes[, payload]).

    Digest and size of a response come from the payload as read, and must match the record's header;
    those of a revisit come from its headers. An empty manifest gives no rows.
    """
    fields = [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]
    ddl = "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long"
    if with_payload:
        fields.append(("payload", pa.binary()))
        ddl += ", payload binary"
    schema = pa.schema(fields)

    def number(urn: str | None) -> int | None:
        tail = (urn or "").rstrip(">").rpartition(":")[2]
        return None if tail in ("", "None") else int(tail)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = open_uri(uri)
                with fs.open_input_file(path) as f:
                    data = memoryview(_read_at(f, start, sum(lengths)))
                rows, at = [], 0
                for length in lengths:
                    head, block = parse_record(zlib.decompress(data[at : at + length], 31))
                    at += length
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                    if kind == "response":
                        size = len(body)
                        if hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{uri}: a payload does not match its digest")
                    else:
                        size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                    rows.append((number(head["warc-record-id"]), kind, number(head.get("warc-refers-to")), head.get("warc-target-uri"), digest, size) + ((body,) if with_payload else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    # ranges are tiny rows that stand for long reads: a given number of parts keeps Spark from merging them
    size = manifest.agg(F.sum("bytes")).first()[0] or 0
    parts = max(manifest.sparkSession.sparkContext.defaultParallelism, size // (READ_TASK * READ_BYTES))
    return record_ranges(manifest).repartition(parts, "uri", "start").mapInArrow(read, ddl)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write every page as a WARC record and read the archives back."""
    return read_records(write_packages(pages, new_path(spark, "warc")))
