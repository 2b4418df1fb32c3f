"""WARC records in ZIP-packaged archives: writing, and reading without extraction.

An archive is a ZIP whose members are stored: ``archive/data.warc.gz`` (one
gzip member per record) and ``indexes/index.cdxj`` (a line per record: key,
then offset and length in that member). Archives are bounded in bytes and
written by Spark's own text writer, one row each, so they go to any store that
Spark can write and survive lost executors.

The reader parses the end-of-directory record, ZIP64 or not, and the central
directory, finds the stored members, reads the index, and then reads the byte
ranges of single records. It works on anything that gives (size, read(offset,
length)): an archive's content in memory or an open file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ship_by_value

#: Fixed names and values of the formats.
DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END_RECORD, END64_LOCATOR, END64_RECORD = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
CENTRAL_HEADER, LOCAL_HEADER, ZIP64_EXTRA = b"PK\x01\x02", b"PK\x03\x04", 0x0001
#: The text writer ends a row with this; an archive counts it as its comment.
LINE_END = b"\n"
#: Compressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 8 << 20


# ---- records -----------------------------------------------------------------------

def payload_digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def warc_record(key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record: the payload in an HTTP response, or a revisit of another's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{key}>",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http_headers: dict[str, str]
    payload: bytes


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_record(data: bytes) -> Record:
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not mark:
        raise ValueError("not a WARC record")
    headers = _headers(head)
    block = rest[:int(headers["content-length"])]
    if len(block) < int(headers["content-length"]):
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, _headers(http), payload)


# ---- archives ----------------------------------------------------------------------

class ArchiveWriter:
    """Collects records; ``close`` gives the archive's bytes."""

    def __init__(self):
        self.data, self.index = io.BytesIO(), []

    def add(self, key: str, record: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.index.append(f"{key} {json.dumps({'offset': self.data.tell(), 'length': len(packed)})}\n")
        self.data.write(packed)

    def close(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for name, data in ((DATA_MEMBER, self.data.getvalue()), (INDEX_MEMBER, "".join(self.index).encode())):
                z.writestr(zipfile.ZipInfo(name), data)
            z.comment = LINE_END
        return out.getvalue()


class Content:
    """Ranges of bytes in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = memoryview(data), len(data)

    def read(self, offset: int, length: int) -> bytes:
        return bytes(self.data[offset:offset + length])


class OpenFile:
    """Ranges of a file in a store that pyarrow can open."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)


@dataclass
class Member:
    name: str
    method: int
    offset: int  # of its local header
    length: int  # as stored


class ZipDirectory:
    """Members of a ZIP, read from its end; nothing is extracted."""

    def __init__(self, source):
        self.source = source
        at, entries, size, offset = self._end()
        self.members = self._central(source.read(offset, size), entries)

    def _end(self) -> tuple[int, int, int, int]:
        tail_at = max(0, self.source.size - 22 - 0xFFFF)
        tail = self.source.read(tail_at, self.source.size - tail_at)
        at = len(tail)
        while True:
            at = tail.rfind(END_RECORD, 0, at)
            if at < 0:
                raise ValueError("not a ZIP archive: no end record")
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break  # its comment ends with the file
        disk, first_disk, _, entries, size, offset, _ = struct.unpack_from("<4H2LH", tail, at + 4)
        end = tail_at + at
        locator = self.source.read(end - 20, 20) if end >= 20 else b""
        if locator[:4] == END64_LOCATOR:
            record_disk, record_at, _ = struct.unpack_from("<LQL", locator, 4)
            record = self.source.read(record_at, 56)
            if record[:4] != END64_RECORD:
                raise ValueError("the ZIP64 end record is not where its locator says")
            disk, first_disk, _, entries, size, offset = struct.unpack_from("<2L4Q", record, 16)
        if disk or first_disk:
            raise ValueError("ZIP archives of several disks are not read")
        return end, entries, size, offset

    def _central(self, data: bytes, entries: int) -> dict[str, Member]:
        members, at = {}, 0
        for _ in range(entries):
            if data[at:at + 4] != CENTRAL_HEADER:
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<2H", data, at + 8)
            length, full, name_n, extra_n, comment_n = struct.unpack_from("<2L3H", data, at + 20)
            offset, = struct.unpack_from("<L", data, at + 42)
            name = data[at + 46:at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, x = data[at + 46 + name_n:at + 46 + name_n + extra_n], 0
            while x + 4 <= len(extra):
                kind, n = struct.unpack_from("<2H", extra, x)
                if kind == ZIP64_EXTRA:  # holds those of the fields that are full of ones, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    length = next(wide) if length == 0xFFFFFFFF else length
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                x += 4 + n
            members[name] = Member(name, -1 if flags & 1 else method, offset, length)
            at += 46 + name_n + extra_n + comment_n
        return members

    def stored_range(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes in the archive."""
        member = self.members[name]
        if member.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is not stored, so its ranges can't be read")
        header = self.source.read(member.offset, 30)
        if header[:4] != LOCAL_HEADER:
            raise ValueError(f"no local header where the directory has {name}")
        name_n, extra_n = struct.unpack_from("<2H", header, 26)
        return member.offset + 30 + name_n + extra_n, member.length


class ArchiveReader:
    """Records of one archive by their ranges."""

    def __init__(self, source):
        self.source = source
        directory = ZipDirectory(source)
        self.data_at, self.data_n = directory.stored_range(DATA_MEMBER)
        at, n = directory.stored_range(INDEX_MEMBER)
        self.index = []
        for line in source.read(at, n).decode().splitlines():
            key, _, place = line.partition(" ")
            place = json.loads(place)
            self.index.append((key, place["offset"], place["length"]))

    def record(self, offset: int, length: int) -> Record:
        if offset < 0 or length < 0 or offset + length > self.data_n:
            raise ValueError("the index points outside the archive's data")
        return parse_record(zlib.decompress(self.source.read(self.data_at + offset, length), 31))

    def records(self, keys: frozenset[str] | None = None) -> Iterator[tuple[str, Record]]:
        for key, offset, length in self.index:
            if keys is None or key in keys:
                yield key, self.record(offset, length)


# ---- operators ---------------------------------------------------------------------

def with_revisits(df: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``df`` with ``sha1`` (hex), ``refers_to`` (null for responses): of rows
    with equal payloads of at least ``min_bytes`` that with the smallest id is
    the response. Rows that repeat that id are responses as well; null ids
    are no one's response unless there is no other id."""
    own = df.withColumns({"sha1": F.sha1(payload_col), "__sha2": F.sha2(payload_col, 256)})
    groups = (own.where(F.octet_length(payload_col) >= min_bytes).groupBy("__sha2")
              .agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    both = own.join(groups, "__sha2", "left")
    revisit = F.col("__first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__first")) & (F.octet_length(payload_col) >= min_bytes)
    return both.withColumn("refers_to", F.when(revisit, F.col("__first"))).drop("__sha2", "__first")


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *,
                   min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per row of ``df`` to ZIP archives in folder ``path``.
    Null html is an empty payload, a null url has no header. Other columns are
    not read. An archive ends with the record that takes it over
    ``archive_bytes``."""
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order"), F.col(url_col).alias("url"),
                    F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = with_revisits(src, "order", "payload", min_bytes).select(
        F.coalesce("id", F.lit("null")).alias("id"), "url", "payload", "sha1", F.col("refers_to").cast("string").alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(archive):
            return pa.RecordBatch.from_arrays([pa.array([archive.close()[:-len(LINE_END)]], pa.binary())], ["archive"])

        archive = ArchiveWriter()
        for batch in batches:
            for key, url, payload, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive.add(key, warc_record(key, url, payload, payload_digest(sha1), refers_to))
                if archive.data.tell() >= archive_bytes:
                    yield closed(archive)
                    archive = ArchiveWriter()
        if archive.index:
            yield closed(archive)

    packed = rows.mapInArrow(pack, "archive binary").select(F.col("archive").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", 1).option("lineSep", LINE_END.decode()).option("compression", "none").text(path)


def opens_by_range(spark: SparkSession, path: str) -> bool:
    """Whether pyarrow opens the store of ``path`` and finds it there."""
    from pyarrow import fs

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    try:
        store, place = fs.FileSystem.from_uri(uri)
        return store.get_file_info(place).type != fs.FileType.NotFound
    except (pa.ArrowException, OSError):
        return False


def read_archives(spark: SparkSession, path: str, *, keys: frozenset[str] | None = None, by_range: bool | None = None) -> DataFrame:
    """(key, record_type, payload_bytes, payload_digest, refers_to, url,
    payload) of the records in a folder's archives.

    payload is null for revisits. A payload that does not have its record's
    digest raises. Archives are opened where they are and only ranges of them
    are read (``by_range``; by default wherever pyarrow opens the store); in
    other stores Spark reads their content. No archives: no rows.
    """
    if by_range is None:
        by_range = opens_by_range(spark, path)
    files = spark.read.format("binaryFile").load(path)
    files = files.select("path", F.lit(None).cast("binary").alias("content") if by_range else "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for uri, content in zip(batch.column(0), batch.column(1), strict=True):
                reader = ArchiveReader(OpenFile(uri.as_py()) if content.as_py() is None else Content(content.as_py()))
                rows, size = [], 0
                for key, record in reader.records(keys):
                    kind, digest = record.headers["warc-type"], record.headers["warc-payload-digest"].removeprefix("sha1:")
                    whole = kind == "response"
                    if whole and payload_digest(hashlib.sha1(record.payload).hexdigest()) != digest:
                        raise ValueError(f"the payload of record {key} does not have its digest")
                    refers = record.headers.get("warc-refers-to")
                    rows.append((key, kind, int(record.http_headers["content-length"]), digest,
                                 refers and refers.removeprefix("<urn:page:").removesuffix(">"), record.headers.get("warc-target-uri"),
                                 record.payload if whole else None))
                    size += len(record.payload)
                    if size >= 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "key string, record_type string, payload_bytes long, payload_digest string, refers_to string, url string, payload binary"
    return files.mapInArrow(unpack, schema)


ship_by_value(__name__)
