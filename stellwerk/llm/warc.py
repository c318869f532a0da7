"""WARC archives as a Spark data source, written and read with ``format("warc")``.

Writing: every task writes archives of its own (``.warc.gz``, one gzip member a record, closed at a target
size) under names no other attempt uses; the commit then lists the files of the attempts that counted in
``_files.json``, so archives of lost or repeated tasks are never read.

Reading: the listed files (or, without a list, all ``.warc`` and ``.warc.gz`` files of the folder) are planned
as partitions of about ``partition_bytes``. Equality and IN predicates on ``type`` and on header columns, and
prefixes of ``target_uri``, are pushed down: a record's headers are parsed first, and the rest of a record that
fails is skipped. Members carry their compressed length in the gzip extra field ``sl``, so that skipping costs
one seek; members without it are inflated without being kept. The payload is only decoded if the schema asked
for has it: ``spark.read.format("warc").schema("record_id string, type string").load(path)``.

Files are opened through pyarrow's file systems, so the path may be any address they know, or a plain one.

Null payloads count as empty, null header values are left out. Line breaks in header values become blanks.
A record whose digest is not given gets none. An empty table makes an empty list of files.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

LIST = "_files.json"
FILE_BYTES = 128 << 20
LEAST_REVISIT_BYTES = 100

SCHEMA = (
    "record_id string, type string, date string, target_uri string, refers_to string, payload_digest string, "
    "payload_length bigint, payload binary"
)
# Header of each column; X-Payload-Length keeps the length of a payload that a revisit does not repeat.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "type": "WARC-Type",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
}
_COLUMNS = {header.lower(): name for name, header in HEADERS.items()}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# ---- records -----------------------------------------------------------------------------------


def record_bytes(row: dict) -> bytes:
    """An uncompressed record: WARC headers, then an HTTP response with the payload, or its head for a revisit."""
    payload = row.get("payload") or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (row.get("payload_length") or len(payload))
    block = http if row["type"] == "revisit" else http + payload
    lines = ["WARC/1.1"]
    for name, header in HEADERS.items():
        if row.get(name) is not None:
            lines.append(f"{header}: {' '.join(str(row[name]).splitlines())}")
    lines.append("Content-Type: application/http;msgtype=response")
    if row["type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """One gzip member with its length in the extra field ``sl``."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Member:
    """One record of an archive: headers at once, the rest only when asked for."""

    def __init__(self, file, start: int):
        self._file, self.start = file, start
        file.seek(start)
        head = file.read(24)
        self._gzip = head[:2] == b"\x1f\x8b"
        self._length = None
        if self._gzip:
            if len(head) == 24 and head[3] == 4 and head[12:14] == b"sl":
                self._length = struct.unpack("<I", head[16:20])[0]
            self._inflate = zlib.decompressobj(31)
        file.seek(start)
        self._raw, self._data = start, b""
        self.headers = None
        while (cut := self._data.find(b"\r\n\r\n")) < 0:
            if not self._more(4096):
                return
        self.version, *lines = self._data[:cut].decode("utf-8", "replace").split("\r\n")
        names = (line.partition(":") for line in lines)
        self.headers = {name.strip().lower(): value.strip() for name, _, value in names}
        self._block = cut + 4

    def _more(self, size: int) -> bool:
        if self._gzip and self._inflate.eof:
            return False
        raw = self._file.read(size)
        if not raw:
            return False
        self._raw += len(raw)
        if self._gzip:
            self._data += self._inflate.decompress(raw)
            if self._inflate.eof:
                self._raw -= len(self._inflate.unused_data)
        else:
            self._data += raw
        return True

    def payload(self) -> bytes:
        """The entity of the HTTP message."""
        size = int(self.headers.get("content-length", 0))
        parts, have = [self._data], len(self._data)
        while have < self._block + size:
            self._data = b""
            if not self._more(1 << 16):
                break
            parts.append(self._data)
            have += len(self._data)
        self._data = b"".join(parts)
        block = self._data[self._block : self._block + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {self.start} has {len(block)} of {size} bytes")
        return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block

    def end(self) -> int:
        """Where the next record starts."""
        if self._length:
            return self.start + self._length
        if self._gzip:
            while not self._inflate.eof:
                self._data = b""
                if not self._more(1 << 16):
                    break
            return self._raw
        return self.start + self._block + int(self.headers.get("content-length", 0)) + 4


def records(file, size: int, wanted, payload: bool) -> Iterator[dict]:
    """The records of an open archive whose header columns pass ``wanted``. A damaged one is an error: what follows it
    could not be found, and must not be missing unnoticed."""
    at = 0
    while at < size:
        member = _Member(file, at)
        if member.headers is None or not member.version.startswith("WARC/"):
            raise ValueError(f"no record of an archive at byte {at} of {size}")
        row = {_COLUMNS[h]: v for h, v in member.headers.items() if h in _COLUMNS}
        if "payload_length" in row:
            row["payload_length"] = int(row["payload_length"])
        if wanted(row):
            if payload:
                row["payload"] = member.payload()
            yield row
        at = member.end()


# ---- data source -------------------------------------------------------------------------------


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self._path, self._names = options["path"], schema.fieldNames()
        self._partition_bytes = int(options.get("partition_bytes", FILE_BYTES))
        self._tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self._tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self._tests.append((column, "in", tuple(f.value)))
            elif column == "target_uri" and isinstance(f, StringStartsWith):
                self._tests.append((column, "prefix", f.value))
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self._tests:
            have = row.get(column)
            if have is None or not (have in value if kind == "in" else have.startswith(value)):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        system, root = _place(self._path)
        listed = system.get_file_info(f"{root}/{LIST}")
        if listed.type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{LIST}") as stream:
                files = [(f"{root}/{name}", size) for name, size in json.loads(stream.read())]
        else:
            found = system.get_file_info(fs.FileSelector(root)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
            files = [(i.path, i.size) for i in found if i.path.endswith((".warc", ".warc.gz"))]
        plan: list[_Files] = []
        room = 0
        for name, size in sorted(files):
            if not plan or size > room:
                plan.append(_Files([]))
                room = self._partition_bytes
            plan[-1].files.append((name, size))
            room -= size
        return plan or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _place(self._path)
        for name, size in partition.files:
            with system.open_input_file(name) as file:
                for row in records(file, size, self._wanted, "payload" in self._names):
                    yield tuple(row.get(n) for n in self._names)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self._path = options["path"]
        self._file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self._level = int(options.get("compression_level", 1))
        if overwrite:
            raise ValueError("archives are never overwritten; write to a new folder")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _place(self._path)
        system.create_dir(root, recursive=True)
        task, files, out, name, size = TaskContext.get().partitionId(), [], None, "", 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"part-{task:05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                data = gzip_member(record_bytes(row), self._level)
                out.write(data)
                size += len(data)
                if size >= self._file_bytes:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _place(self._path)
        system.create_dir(root, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        with system.open_output_stream(f"{root}/{LIST}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _place(self._path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                system.delete_file(f"{root}/{name}")


# ---- pages -------------------------------------------------------------------------------------

_ID = "<urn:page:"


def page_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive records of ``page_id, url, html``: of equal payloads of 100 bytes or more the one with the
    smallest page_id is a response, the others revisit it; all smaller ones are responses.

    Digests are grouped without payloads, and minima are taken before the shuffle. Pages without a page_id
    are responses. Rows that share page_id and payload are all of the same type.
    """
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    full = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    full = full.withColumns({"digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("bigint")})
    narrow = full.where(F.col("payload_length") >= LEAST_REVISIT_BYTES).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    again = narrow.join(first.select("digest", "first").hint("shuffle_hash"), "digest").where("page_id <> first").distinct()
    marked = full.join(again, ["page_id", "digest"], "left")

    def record_id(page_id):
        return F.concat(F.lit(_ID), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))

    revisit = F.col("first").isNotNull()
    return marked.select(
        record_id(F.col("page_id")).alias("record_id"),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("type"),
        F.lit(date).alias("date"),
        F.col("url").alias("target_uri"),
        F.when(revisit, record_id(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def use_warc(spark) -> None:
    """Make the format known to a session, with predicates pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_of(record_id: str) -> Column:
    """The page_id of a record id column written by ``page_records``."""
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
