"""WARC archives as a Spark data source with a splittable reader.

Writing: each task writes its rows as one archive of gzip members, one member
per record; an archive counts only when the job commits.  Reading: archives
are dealt out in byte ranges.  A task scans its range for the gzip magic,
takes the first place at which a member decodes to WARC headers, and then
follows the members; it owns the records that start inside its range and
reads the last of them beyond the range's end.

    spark.dataSource.register(WarcDataSource)
    df.write.format("warc").mode("append").save(folder)
    spark.read.format("warc").option("splitBytes", 1 << 26).load(folder)

Files are reached through the file system that the folder's address names, so
the folder must be on storage that all executors share.

Defined results: a null payload is empty; a null url or target leaves the
header out; a revisit record has no payload of its own, but carries length
and digest of the full payload; members that are not WARC records are passed
over while the reader looks for its first record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from ..functions.materialize import table_folder
from ..session import ship_package

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = ("record_id string, record_type string, target string, refers_to string, "
                 "payload_length long, payload_digest string, payload binary")
READ_SCHEMA = RECORD_SCHEMA + ", file string, position long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        fs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """Header values must not break lines."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(row: dict) -> bytes:
    """One record as a gzip member."""
    payload = row["payload"] or b""
    block = HTTP_HEAD + (payload if row["record_type"] == "response" else b"")
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", DATE),
            ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
            ("X-Payload-Length", str(row["payload_length"]))]
    if row["target"] is not None:
        head.append(("WARC-Target-URI", _clean(row["target"])))
    if row["refers_to"] is not None:
        head += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", PROFILE)]
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + press.flush()


def _headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """Headers and the length of the header block, or None if ``data`` does not start a record."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    pairs = [line.partition(":") for line in data[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]]
    found = {k.strip().lower(): v.strip() for k, _, v in pairs}
    return (found, end + 4) if found.get("content-length", "").isdigit() and "warc-type" in found else None


def decode_record(data: bytes) -> dict | None:
    """Columns of RECORD_SCHEMA of a member's bytes; digest and length of a payload are its own."""
    parsed = _headers(data)
    if parsed is None:
        return None
    head, at = parsed
    block = data[at:at + int(head["content-length"])]
    bare = lambda k: head[k].strip("<>") if k in head else None
    payload = block[block.find(b"\r\n\r\n") + 4:] if head["warc-type"] == "response" else None
    digest, length = head.get("warc-payload-digest", "").removeprefix("sha1:"), head.get("x-payload-length")
    if payload is not None:
        digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
    return {"record_id": bare("warc-record-id"), "record_type": head["warc-type"], "target": head.get("warc-target-uri"),
            "refers_to": bare("warc-refers-to"), "payload_length": None if length is None else int(length),
            "payload_digest": digest, "payload": payload}


class _Bytes:
    """Forward reading with one buffer of what has not been passed yet."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.buffer, self.at = stream, size, b"", 0

    def view(self, position: int, least: int) -> bytes:
        """Bytes from ``position`` on, ``least`` of them if the file has as many."""
        if not self.at <= position <= self.at + len(self.buffer):
            self.buffer, self.at = b"", position
        self.buffer, self.at = self.buffer[position - self.at:], position
        if len(self.buffer) < least:
            want = min(self.size - position, max(least, READ_BYTES)) - len(self.buffer)
            if want > 0:
                self.buffer += self.stream.read_at(want, position + len(self.buffer))
        return self.buffer


def _starts_record(source: _Bytes, position: int) -> bool:
    """Whether a gzip member at ``position`` decodes to the headers of a record, however long they are."""
    decoder, out, used, searched = zlib.decompressobj(31), bytearray(), 0, 0
    try:
        while not decoder.eof:
            size = max(4096, used)
            chunk = source.view(position, used + size)[used:used + size]
            if not chunk:
                break
            used += len(chunk)
            out += decoder.decompress(chunk)
            if not b"WARC/1."[:len(out)] == out[:7]:
                return False
            if out.find(b"\r\n\r\n", searched) >= 0:
                break
            searched = max(0, len(out) - 3)
    except zlib.error:
        return False
    return _headers(bytes(out)) is not None


def read_range(path: str, start: int, stop: int) -> Iterator[dict]:
    """Records of one archive that start in [start, stop)."""
    system, name = _open(path)
    size = system.get_file_info(name).size
    with system.open_input_file(name) as stream:
        source, position = _Bytes(stream, size), start
        synced = start == 0
        while position < min(stop, size):
            if not synced:
                window = source.view(position, READ_BYTES)
                hit = window.find(MAGIC)
                if hit < 0:
                    if position + len(window) >= size:
                        return
                    position += max(1, len(window) - len(MAGIC) + 1)
                    continue
                position += hit
                if position >= stop:
                    return
                if not _starts_record(source, position):
                    position += 1
                    continue
                synced = True
            decoder, parts, used = zlib.decompressobj(31), [], 0
            while not decoder.eof:
                chunk = source.view(position + used, 1)
                if not chunk:
                    raise ValueError(f"{path}: the record at {position} is cut off")
                parts.append(decoder.decompress(chunk))
                used += len(chunk) - len(decoder.unused_data)
            record = decode_record(b"".join(parts))
            if record is not None:
                yield record | {"file": path, "position": position}
            position += used


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Archive(WriterCommitMessage):
    path: str | None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[ByteRange]:
        system, name = _open(self.folder)
        prefix = self.folder[:len(self.folder) - len(name)] if self.folder.endswith(name) else ""
        files = [f for f in system.get_file_info(fs.FileSelector(name)) if f.path.endswith(".warc.gz")]
        if self.folder.startswith("file:"):
            prefix = "file://"
        ranges = [ByteRange(prefix + f.path, at, min(at + self.split, f.size))
                  for f in files for at in range(0, f.size, self.split)]
        return ranges or [ByteRange("", 0, 0)]  # an empty folder is read as one empty range

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target", pa.string()),
                            ("refers_to", pa.string()), ("payload_length", pa.int64()),
                            ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()),
                            ("position", pa.int64())])
        rows, held = [], 0
        if partition.start == partition.stop:
            return
        for record in read_range(partition.path, partition.start, partition.stop):
            rows.append(record)
            held += len(record["payload"] or b"") + 500
            if held > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    """One archive per task under a name of its own; those of failed attempts are removed."""

    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archive:
        system, name = _open(self.folder)
        path, out = f"{name}/{uuid.uuid4().hex}.part", None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        system.create_dir(name, recursive=True)
                        out = system.open_output_stream(path)
                    out.write(encode_record(row))
        finally:
            if out is not None:
                out.close()
        return Archive(path if out is not None else None)

    def commit(self, messages: list[Archive]) -> None:
        system, name = _open(self.folder)
        system.create_dir(name, recursive=True)
        for m in messages:
            if m is not None and m.path:
                system.move(m.path, m.path.removesuffix(".part") + ".warc.gz")

    def abort(self, messages: list[Archive]) -> None:
        system, _ = _open(self.folder)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def page_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Records of ``pages`` (page_id, url, html): of equal payloads of at least ``least_bytes``
    the one with the largest page_id is the response that the others revisit.

    Payloads are compared by length, SHA-1 and a second hash.  Rows that share
    that largest id are responses; rows without id revisit like the others.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    marks = pages.select("page_id", F.octet_length(body).cast("long").alias("n"), F.sha1(body).alias("digest"),
                         F.xxhash64(body).alias("h"))
    groups = (marks.where(F.col("n") >= least_bytes).groupBy("n", "digest", "h")
              .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
              .where((F.col("copies") > 1) & F.col("first").isNotNull())
              .select("digest", "h", F.col("n").alias("gn"), "first"))
    # The marks of copies are joined without their payloads; only copies are looked up by page below.
    copies = (marks.join(groups, ["digest", "h"]).where(F.col("n") == F.col("gn"))
              .where(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
              .select(F.col("page_id").alias("copy_id"), F.col("digest").alias("copy_digest"), "first").distinct())
    rows = pages.select("page_id", "url", F.sha1(body).alias("digest"), body.alias("payload"))
    rows = rows.join(copies, F.col("page_id").eqNullSafe(F.col("copy_id")) & (
        F.col("digest") == F.col("copy_digest")), "left")
    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return rows.select(
        F.coalesce(urn(F.col("page_id")), F.lit("urn:page:")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target"),
        urn(F.col("first")).alias("refers_to"), F.octet_length("payload").cast("long").alias("payload_length"),
        F.col("digest").alias("payload_digest"), F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, folder: str) -> None:
    spark = records.sparkSession
    ship_package(spark)
    spark.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").save(folder)


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("splitBytes", str(split_bytes)).load(folder)


def round_trip(pages: DataFrame, least_bytes: int = 1000, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pages written as archives into the shared folder and read back."""
    records = page_records(pages, least_bytes)
    folder = table_folder(records)
    write_warc(records, folder)
    return read_warc(pages.sparkSession, folder, split_bytes)
