"""WARC records in ZIP-packaged archives, written and read by ranges.

An archive is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (a gzip member for
each record) and ``indexes/index.cdx`` (a line for each record: offset, length, type, id). The reader finds the
central directory from the end of the file (ZIP64 where the sizes need it), locates the two members, reads the
index, and reads each record by its range; nothing is extracted.

Equal payloads: the record of the smallest page id is a response, others are revisits that name it and carry
no payload. Digests are grouped first, pre-aggregated before the shuffle; the pages are then joined with the
first page of their digest. The pages of a digest that many share are dealt to many tasks (``join_hot``); no pages are
gathered.

Tasks write archives of bounded size to the shared folder under names of their own; the list of archives is
written after them, so that archives of lost or repeated attempts are not read.

Defined results: null html is an empty payload; rows that repeat a page id with an equal payload are responses
if the id is the smallest of that payload, else revisits; null page ids come last (they are responses only if
all pages of the payload have none); null urls are written as empty; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import join_hot, materialise, new_path, pick, worker_state

#: Bytes of compressed records in an archive, at least one record.
ARCHIVE_BYTES = 32 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as pyarrow knows it (local, HDFS, S3, GCS), and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str, url: str, kind: str, payload: bytes, payload_digest: str, size: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class ArchiveWriter:
    """Stored ZIP members, one after the other, with ZIP64 sizes where ``zip64`` or the sizes ask for it."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def member(self, name: str, chunks: list[bytes]) -> None:
        size, crc = sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        start, raw = self.at, name.encode()
        big = self.zip64 or size >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        low = 0xFFFFFFFF if big else size
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 0x21, crc, low, low, len(raw), len(extra)) + raw + extra)
        for c in chunks:
            self._put(c)
        self.members.append((raw, crc, size, start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.members:
            big = self.zip64 or size >= 0xFFFFFFFF or at >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            low, place = (0xFFFFFFFF, 0xFFFFFFFF) if big else (size, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, low, low, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        length, n = self.at - start, len(self.members)
        if self.zip64 or start >= 0xFFFFFFFF or n >= 0xFFFF:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, length, start, 0))


class ArchiveReader:
    """Members of a ZIP file from its central directory; ``f`` can seek, and is read by ranges only."""

    def __init__(self, f):
        self.f = f
        f.seek(0, io.SEEK_END)
        total = f.tell()
        back = min(total, 22 + 65_535)
        tail = self._read(total - back, back)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):  # the mark may lie in a comment
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == n or 0xFFFFFFFF in (length, start):
            locator = self._read(total - back + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            place = struct.unpack_from("<Q", locator, 8)[0]
            end = self._read(place, 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, p = self._read(start, length), 0
        for _ in range(n):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            method, = struct.unpack_from("<H", directory, p + 10)
            packed, size = struct.unpack_from("<II", directory, p + 20)
            names, extras, comment = struct.unpack_from("<HHH", directory, p + 28)
            place, = struct.unpack_from("<I", directory, p + 42)
            name = directory[p + 46 : p + 46 + names].decode("utf-8")
            extra, e = directory[p + 46 + names : p + 46 + names + extras], 0
            while e + 4 <= len(extra):
                tag, width = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # ZIP64: only the fields that overflowed, in this order
                    q = e + 4
                    if size == 0xFFFFFFFF:
                        size, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                    if packed == 0xFFFFFFFF:
                        packed, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                    if place == 0xFFFFFFFF:
                        place = struct.unpack_from("<Q", extra, q)[0]
                e += 4 + width
            self.members[name] = (method, place, packed)
            p += 46 + names + extras + comment

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        method, place, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; its records cannot be read by range")
        head = self._read(place, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        names, extras = struct.unpack_from("<HH", head, 26)
        return place + 30 + names + extras, size

    def index(self) -> list[tuple[int, int]]:
        """Offset and length of each record in the data member."""
        at, size = self.locate(INDEX)
        return [tuple(map(int, line.split(b" ")[:2])) for line in self._read(at, size).splitlines()]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        start, size = self.locate(DATA)
        for at, n in self.index():
            if at + n > size:
                raise ValueError("index beyond the data member")
            yield parse_record(gzip.decompress(self._read(start + at, n)))


def firsts(pages: DataFrame) -> DataFrame:
    """Pages with the digest of their payload and the smallest page id that has it."""
    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    least = materialise(rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "digests")
    return join_hot(rows, least.select("sha1", "first"), ["sha1"], ["page_id"], least.select("sha1", "n")).select("page_id", "url", "html", "sha1", "first")


def write(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Write a record for each page; returns the written list of archives (archive, n_records)."""
    path = path or new_path(pages.sparkSession, "archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("warc")
        filesystem, folder = open_fs(path)
        chunks: list[bytes] = []
        lines: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal chunks, lines, size
            filesystem.create_dir(folder, recursive=True)
            name = f"{uuid.uuid4().hex}.wacz"
            with filesystem.open_output_stream(f"{folder}/{name}") as out:
                zipped = ArchiveWriter(out, zip64)
                zipped.member(DATA, chunks)
                zipped.member(INDEX, [b"".join(lines)])
                zipped.close()
            done = pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([len(lines)], pa.int64())], names=["archive", "n_records"])
            chunks, lines, size = [], [], 0
            return done

        for batch in batches:
            for page_id, url, html, sha1, first in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns))):
                payload = html.as_py().encode("utf-8", "replace")
                kind = "response" if page_id == first else "revisit"
                bare = base64.b32encode(binascii.unhexlify(sha1)).decode()
                name = "" if page_id is None else str(page_id)
                raw = gzip.compress(record(name, (url or "").replace("\r", "").replace("\n", ""), kind, payload, bare, len(payload), None if first is None else str(first)), 4, mtime=0)
                lines.append(b"%d %d %s %s\n" % (size, len(raw), kind.encode(), name.encode()))
                chunks.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield flush()
        if lines:
            yield flush()

    return materialise(firsts(pages).mapInArrow(run, "archive string, n_records bigint"), "archive-list")


def read(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The records of listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are of the payload that was read; a revisit's are what its headers say. Ids are text in
    the archives; ``id_type`` is the type that they had ("string" where they are no whole numbers, which would be null).
    """
    spark = archives.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def page(uri: str | None) -> str | None:
        name = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return name or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("warc")
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                filesystem, place = open_fs(archive)
                rows = []
                with filesystem.open_input_file(place) as f:
                    for headers, payload in ArchiveReader(f).records():
                        kind, said = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        found = digest(payload) if kind == "response" else said
                        if found != said:
                            raise ValueError(f"payload of {headers['warc-record-id']} in {archive} is damaged")
                        rows.append((page(headers["warc-record-id"]), len(payload) if kind == "response" else int(headers["x-payload-length"]), found, kind, page(headers.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(zip(*rows))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    out = archives.select("archive").repartition(n).mapInArrow(run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
