"""Operator 1: WARC archives as a PySpark data source.

Writing makes one gzip member per record, one file per task; the commit writes a list of the files
of successful tasks, so a repeated or speculative task leaves nothing that is read. Reading plans
whole files into partitions of about equal size. Filters on headers are pushed into the reader:
header blocks are parsed first, and the block of a record that a filter rejects, or whose payload is
not asked for, is stepped over without being decoded. Paths are opened with ``pyarrow.fs``, which
reaches local, HDFS and object-store folders.

Options of the reader: ``payload`` (``true``: the payload as binary; ``false``: null, blocks are
stepped over). Pushed filters: ``=``, ``IN`` and ``IS [NOT] NULL`` on ``record_type``, ``record_id``, ``refers_to``, ``target_uri`` and
``payload_digest``, and string prefixes on the last four.

A null payload is the empty payload; a null page id or uri leaves the header out and reads back as
null; control characters in a uri are percent-encoded. A record without an id is always a response.
Records that share an id and a payload are the same record type: responses if that id is the
smallest of its payload. An empty table gives an archive without records.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

from cohortspark.llm.common import ship, skew_safe_join
from cohortspark.session import new_folder, stage

SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, "
    "payload_bytes bigint, payload binary"
)
HEADERS = {  # columns that are header fields as they stand
    "record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to",
    "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest",
}
FILES = "files.json"
DATE = "2000-01-01T00:00:00Z"  # pages have no capture time
BLOCK = 1 << 20


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        path = re.sub("^file:/*", "file:///", path)
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def record(kind: str, rid: str | None, uri: str | None, digest: str, size: int, refers_to: str | None, payload: bytes) -> bytes:
    """One record as it stands in the archive, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", rid and f"<urn:page:{rid}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", uri and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(size)),
        ("WARC-Refers-To", refers_to and f"<urn:page:{refers_to}>"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = open_folder(self.path)
        fs.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        size = records = 0
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    made = record(
                        row["record_type"], row["record_id"], row["target_uri"], row["payload_digest"],
                        row["payload_bytes"], row["refers_to"], row["payload"] or b"",
                    )
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = packer.compress(made) + packer.flush()
                    out.write(member)
                    size += len(member)
                    records += 1
        return Written(name, size, records)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = open_folder(self.path)
        fs.create_dir(folder, recursive=True)
        listed = [{"name": m.name, "size": m.size} for m in messages if m and m.records]
        if not self.overwrite:
            listed += listed_files(fs, folder)
        with fs.open_output_stream(f"{folder}/{FILES}", compression=None) as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = open_folder(self.path)
        for m in messages:
            if m and fs.get_file_info(f"{folder}/{m.name}").type == pafs.FileType.File:
                fs.delete_file(f"{folder}/{m.name}")


def listed_files(fs: pafs.FileSystem, folder: str) -> list[dict]:
    """The committed files of an archive folder; without a list, all its WARC files."""
    if fs.get_file_info(f"{folder}/{FILES}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{folder}/{FILES}", compression=None) as f:
            return json.loads(f.read())
    if fs.get_file_info(folder).type != pafs.FileType.Directory:
        return []
    found = fs.get_file_info(pafs.FileSelector(folder))
    return [{"name": x.base_name, "size": x.size} for x in found if re.search(r"\.warc(\.gz)?$", x.base_name)]


class Stream:
    """Bytes of a WARC file, gzip members inflated one after the other as they are needed."""

    def __init__(self, raw, packed: bool):
        self.raw, self.packed, self.buffer, self.at = raw, packed, b"", 0
        self.left, self.unpacker = b"", None

    def more(self) -> bool:
        if not self.packed:
            data = self.raw.read(BLOCK)
        else:
            data = b""
            while not data:
                if not self.left:
                    self.left = self.raw.read(BLOCK)
                    if not self.left:
                        break
                if self.unpacker is None or self.unpacker.eof:
                    self.unpacker = zlib.decompressobj(31)
                data = self.unpacker.decompress(self.left, BLOCK)
                self.left = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
        self.buffer, self.at = self.buffer[self.at :] + data, 0
        return bool(data)

    def until(self, mark: bytes) -> bytes | None:
        start = self.at
        while (end := self.buffer.find(mark, start)) < 0:
            if not self.more():
                return None
            start = 0
        out, self.at = self.buffer[self.at : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            if not self.more():
                raise EOFError("a record ends early")
        out, self.at = self.buffer[self.at : self.at + n], self.at + n
        return out

    def skip(self, n: int) -> None:
        """Step over ``n`` bytes without keeping them; in a plain file without reading them."""
        have = min(n, len(self.buffer) - self.at)
        self.at, n = self.at + have, n - have
        if n and not self.packed:
            self.raw.seek(self.raw.tell() + n)
            return
        while n:
            self.buffer, self.at = b"", 0
            if not self.more():
                raise EOFError("a record ends early")
            self.at = min(n, len(self.buffer))
            n -= self.at


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if k}


def row_of(fields: dict[str, str]) -> dict[str, str | None]:
    row = {column: fields.get(name) for column, name in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c] and re.sub("^<(urn:page:)?|>$", "", row[c])
    row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha256:")
    return row


@dataclass
class Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, partition_bytes: int):
        self.path, self.payload, self.partition_bytes = path, payload, partition_bytes
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith)) and not (
                name == "record_type" and isinstance(f, StringStartsWith)
            ):
                self.wanted.append((name, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def rejects(self, row: dict[str, str | None]) -> bool:
        for name, kind, value in self.wanted:
            have = row[name]
            if not {
                "EqualTo": have is not None and have == value, "EqualNullSafe": have == value, "IsNull": have is None,
                "IsNotNull": have is not None, "In": have is not None and kind == "In" and have in value,
                "StringStartsWith": have is not None and kind == "StringStartsWith" and have.startswith(value),
            }[kind]:
                return True
        return False

    def partitions(self) -> list[Files]:
        fs, folder = open_folder(self.path)
        parts: list[Files] = []
        size = self.partition_bytes
        for f in sorted(listed_files(fs, folder), key=lambda f: -f["size"]):
            if size + f["size"] > self.partition_bytes:
                parts.append(Files([]))
                size = 0
            parts[-1].names.append(f["name"])
            size += f["size"]
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, folder = open_folder(self.path)
        rows: list[dict] = []
        held = 0
        for name in partition.names:
            with fs.open_input_file(f"{folder}/{name}") as raw:
                for row in self.records(Stream(raw, name.endswith(".gz"))):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held > 8 * BLOCK:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def records(self, stream: Stream) -> Iterator[dict]:
        while (head := stream.until(b"\r\n\r\n")) is not None:
            fields = parse_headers(head.lstrip(b"\r\n"))
            length, row = int(fields["content-length"]), row_of(fields)
            if self.rejects(row):
                stream.skip(length + 4)
                continue
            size = fields.get("warc-payload-length")
            row |= {"payload": None, "payload_bytes": int(size) if size else None}
            if row["record_type"] == "revisit" or not self.payload:
                stream.skip(length)
            else:
                block = stream.take(length)
                if "application/http" in fields.get("content-type", ""):
                    block = block.partition(b"\r\n\r\n")[2]
                row["payload"] = block
            stream.skip(4)
            yield row

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = [("payload_bytes", pa.int64()), ("payload", pa.binary())]
        schema = pa.schema([(n, pa.string()) for n in HEADERS] + kinds)
        return pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """``format("warc")`` with the folder as ``path``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        payload = self.options.get("payload", "true").lower() == "true"
        return WarcReader(self.options["path"], payload, int(self.options.get("partition_bytes", 32 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known and let Spark hand filters to Python sources."""
    ship(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of(pages: DataFrame, least: int = 100) -> DataFrame:
    """The records of ``pages`` (page_id, url, html): repeated payloads of ``least`` bytes or more become revisits.

    The html is not shuffled by its payload: digests are grouped, and only ids that become revisits are joined back.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        "page_id", F.col("url").alias("target_uri"), html.alias("html"),
        F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("bigint").alias("payload_bytes"),
    )
    keys = stage(
        rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_digest"), "digests"
    )
    groups = stage(
        keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies"
    )
    again = skew_safe_join(keys, groups, ["payload_digest"], "n").where("page_id <> first")
    again = again.select("page_id", "payload_digest", F.col("first").alias("refers_to")).distinct()
    joined = rows.join(again, ["page_id", "payload_digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("page_id").cast("string").alias("record_id"), F.col("refers_to").cast("string").alias("refers_to"), "target_uri",
        "payload_digest", "payload_bytes", F.when(~revisit, F.col("html").cast("binary")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, least: int = 100) -> None:
    """Write ``pages`` as WARC files into the folder ``path``."""
    register(pages.sparkSession)
    records_of(pages, least).write.format("warc").mode("overwrite").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive folder, see the module's options and pushed filters."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back: what each record says of its page.

    Digest and size of a response are taken from the payload that was read, those of a revisit from its headers.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    archive(pages, path, least)
    kind = pages.schema["page_id"].dataType
    got = read(spark, path)
    response = F.col("record_type") == "response"
    return got.select(
        F.col("record_id").cast(kind).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )
