"""WARC records in ZIP archives: writing them, and reading single records by range.

An archive holds a stored (uncompressed) member of WARC records, each a gzip member of its own,
and a stored index with each record's offset and length. Reading starts at the archive's end:
end-of-central-directory record, ZIP64 locator and record where there are such, central directory,
local header of a stored member; then the index; then the wanted ranges. Nothing is unpacked to
disk, and an archive of any size costs its directory and the records asked for.

Tasks write archives of their own, named at random, straight to the shared folder; only those in
the manifest count, so a task that is run twice leaves nothing behind but an unread file.

Defined results: a null payload is empty; of records with equal payloads (SHA-1 and length) that
with the smallest page_id is a response, repeated rows of it too, the others are revisits without
payload; a null page_id is a revisit if any other page has its payload, else a response; a null url
is replaced by the record's own name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: An archive is closed when its records take so many bytes.
ARCHIVE_BYTES = 128 << 20
#: Neighbouring records are read together up to so many bytes.
READ_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def page_of(name: str | None) -> int | None:
    tail = (name or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record. A revisit keeps the HTTP header of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_name(page_id)}>",
        f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127)))) if url is not None else record_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_name(refers_to)}>"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload); names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, _headers(http), payload


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


class Archive:
    """A ZIP archive that is being written."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        self.path = path
        self.stream = filesystem.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(DATA, "w", force_zip64=True)
        self.offset, self.index = 0, []

    def add(self, page_id: int | None, record: bytes) -> None:
        packed = gzip.compress(record, 5, mtime=0)
        self.member.write(packed)
        self.index.append(f"{'-' if page_id is None else page_id} {self.offset} {len(packed)}\n")
        self.offset += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as index:
            index.write("".join(self.index).encode())
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index), self.offset


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # where its local header begins


def central_directory(file) -> list[Member]:
    """The members of an archive, from its end; reads ZIP64 structures where fields overflow."""
    total = file.size()
    tail_at = max(0, total - 65_557)
    tail = file.read_at(total - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    locator = tail_at + at - 20
    if locator >= 0 and (mark := file.read_at(20, locator))[:4] == b"PK\x06\x07":
        (end64,) = struct.unpack("<Q", mark[8:16])
        record = file.read_at(56, end64)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack("<QQQ", record[32:56])
    raw, members, p = file.read_at(size, start), [], 0
    for _ in range(count):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method, packed, full, n, m, k, header = struct.unpack("<10xH8xIIHHH8xI", raw[p : p + 46])
        extra = raw[p + 46 + n : p + 46 + n + m]
        wide = _zip64(extra)
        if full == 0xFFFFFFFF:
            (full,), wide = struct.unpack("<Q", wide[:8]), wide[8:]
        if packed == 0xFFFFFFFF:
            (packed,), wide = struct.unpack("<Q", wide[:8]), wide[8:]
        if header == 0xFFFFFFFF:
            (header,) = struct.unpack("<Q", wide[:8])
        members.append(Member(raw[p + 46 : p + 46 + n].decode(), method, packed, header))
        p += 46 + n + m + k
    return members


def _zip64(extra: bytes) -> bytes:
    p = 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[p : p + 4])
        if kind == 1:
            return extra[p + 4 : p + 4 + n]
        p += 4 + n
    return b""


def stored_start(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    n, m = struct.unpack("<HH", file.read_at(30, member.header)[26:30])
    return member.header + 30 + n + m


def read_index(file) -> tuple[int, list[tuple[int, int]]]:
    """Where the records begin, and the (offset, length) of each."""
    members = {m.name: m for m in central_directory(file)}
    raw = file.read_at(members[INDEX].size, stored_start(file, members[INDEX])).decode()
    return stored_start(file, members[DATA]), [tuple(map(int, line.split(" ")[1:3])) for line in raw.splitlines()]


def read_records(file, start: int, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The records of these ranges; neighbours share a read."""
    i = 0
    while i < len(ranges):
        j = i + 1
        while j < len(ranges) and ranges[j][0] == sum(ranges[j - 1]) and sum(ranges[j]) - ranges[i][0] <= READ_BYTES:
            j += 1
        low = ranges[i][0]
        raw = file.read_at(sum(ranges[j - 1]) - low, start + low)
        for offset, length in ranges[i:j]:
            yield gzip.decompress(raw[offset - low : offset - low + length])
        i = j


def _write(root: str, archive_bytes: int, date: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = fs.FileSystem.from_uri(root)
        filesystem.create_dir(folder, recursive=True)
        archive, done = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "bytes", "refers_to", "revisit")]
            for i in range(batch.num_rows):  # one page's text at a time
                page, url, html, digest, n, refers, revisit = (c[i].as_py() for c in columns)
                archive = archive or Archive(filesystem, f"{folder}/{uuid.uuid4().hex}.zip")
                payload = (html or "").encode()
                archive.add(page, warc_record(page, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), n, refers, revisit, date))
                if archive.offset >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return run


def write_archives(spark: SparkSession, pages: DataFrame, root: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of `pages` (page_id, url, html) to archives under `root`, a folder
    that all executors reach; returns the manifest (path, records, bytes)."""
    scratch = Scratch(spark, "warc")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    # only payloads that repeat; partial minima go before the shuffle, html does not go at all
    shared = named.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = named.join(scratch.keep(shared, "shared"), ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = joined.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "bytes",
        F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"),
    )
    manifest = records.mapInArrow(_write(root, archive_bytes, date), "path string, records long, bytes long")
    return scratch.keep(manifest, "manifest")


def _read(root: str, with_payload: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = fs.FileSystem.from_uri(root)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 6 + with_payload]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with filesystem.open_input_file(path) as file:
                    start, ranges = read_index(file)
                    for i in range(0, len(ranges), 512):
                        rows = []
                        for raw in read_records(file, start, ranges[i : i + 512]):
                            warc, http, payload = parse_record(raw)
                            revisit = warc["warc-type"] == "revisit"
                            digest = warc["warc-payload-digest"].removeprefix("sha1:") if revisit else base32_sha1(payload)
                            n = int(http["content-length"]) if revisit else len(payload)
                            refers = page_of(warc.get("warc-refers-to"))
                            rows.append((page_of(warc["warc-record-id"]), n, digest, warc["warc-type"], refers, warc["warc-target-uri"], payload))
                        columns = list(zip(*rows, strict=True))[: len(names)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    return run


def read_archives(spark: SparkSession, manifest: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the manifest's archives: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url and, if asked for, the payload as stored. Response digests are taken
    anew from the payloads read."""
    number = max(1, manifest.count())
    paths = manifest.select("path").repartition(min(number, 10_000), "path")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    return paths.mapInArrow(_read(root, with_payload), schema)


def archive_pages(spark: SparkSession, pages: DataFrame, root: str | None = None) -> DataFrame:
    """Writes all pages and reads the archives back."""
    root = root or Scratch(spark, "archives").path("zip")
    return read_archives(spark, write_archives(spark, pages, root), root)
