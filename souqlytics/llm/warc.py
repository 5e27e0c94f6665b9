"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``."""

from __future__ import annotations

import datetime
import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from souqlytics.session import scratch_path

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20
# Column of a record -> its header. The payload is the HTTP body; the rest is header text.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "url": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_bytes": "X-Payload-Length",
}
SCHEMA = "record_type string, record_id string, url string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def _clean(value: object) -> str:
    """A header value on one line: percent marks, CR and LF are escaped."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def encode(row: Row) -> bytes:
    """One record. A response holds its payload gzip-coded in an HTTP message; a revisit holds none."""
    fields = row.asDict()
    head = [VERSION]
    for name, header in HEADERS.items():
        if fields.get(name) is not None:
            head.append(f"{header}: {_clean(fields[name])}".encode("utf-8", "surrogatepass"))
    block = _HTTP
    if fields["record_type"] == "revisit":
        head.append(f"WARC-Profile: {PROFILE}".encode())
        block += b"\r\n"
    else:
        body = gzip.compress(bytes(fields["payload"] or b""), 6, mtime=0)
        block += f"Content-Encoding: gzip\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    head += [b"Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Records:
    """Records of one file from ``start`` on; a payload is read only if it is asked for."""

    def __init__(self, stream, start: int = 0):
        self.stream, self.at = stream, start

    def _line(self, buffer: bytearray) -> bytes | None:
        while (i := buffer.find(b"\r\n")) < 0:
            more = self.stream.read(4096)
            if not more:
                return None
            buffer += more
        line = bytes(buffer[:i])
        del buffer[: i + 2]
        self.at += i + 2
        return line

    def __iter__(self) -> Iterator[tuple[dict[str, str], int, int]]:
        """Headers, and where the block starts and how long it is."""
        while True:
            self.stream.seek(self.at)
            buffer = bytearray()
            first = self._line(buffer)
            if first is None:
                return
            if not first.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {self.at}")
            headers = {}
            while line := self._line(buffer):
                name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
                headers[name.strip().lower()] = value.strip()
            size, start = int(headers.get("content-length", 0)), self.at
            self.at = start + size + 4
            yield headers, start, size

    def block(self, start: int, size: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(size)


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return gzip.decompress(body) if b"content-encoding: gzip" in head.lower() and body else body


@dataclass
class FilePart(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """One partition per file; files are bounded when written, so partitions are too."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.names, self.wanted = options["path"], schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on header columns are met here, before a payload is touched."""
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.attribute[0] != "payload_bytes":
                self.wanted.append((f.attribute[0], None if isinstance(f, IsNotNull) else list(f.value) if isinstance(f, In) else [f.value]))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = _open(self.path)
        found = system.get_file_info(pafs.FileSelector(path, recursive=True))
        return [FilePart(f.path) for f in found if f.is_file and f.path.endswith(".warc")]

    def _takes(self, values: dict) -> bool:
        for name, wanted in self.wanted:
            if wanted is None:
                if values[name] is None:
                    return False
            elif values[name] not in wanted:
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # no file was written
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as stream:
            records = _Records(stream)
            for headers, start, size in records:
                values = {n: _plain(v) if (v := headers.get(h.lower())) is not None else None for n, h in HEADERS.items()}
                if not self._takes(values):
                    continue
                values["payload_bytes"] = int(values["payload_bytes"]) if values["payload_bytes"] is not None else None
                if "payload" in self.names:
                    values["payload"] = payload_of(records.block(start, size)) if values["record_type"] != "revisit" else None
                yield tuple(values[n] for n in self.names)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    """Each task writes files of about FILE_BYTES; names are final only once the job commits."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        files, stream, size = [], None, 0
        for row in rows:
            if stream is None or size >= FILE_BYTES:
                if stream is not None:
                    stream.close()
                files.append(f"{path}/{self.run}-{uuid.uuid4().hex}.tmp")  # every attempt has its own names
                stream, size = system.open_output_stream(files[-1]), 0
            record = encode(row)
            stream.write(record)
            size += len(record)
        if stream is not None:
            stream.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, _ = _open(self.path)
        for m in messages:
            for f in m.files if m else []:
                system.move(f, f.removesuffix(".tmp") + ".warc")

    def abort(self, messages: list) -> None:
        system, _ = _open(self.path)
        for m in messages:
            for f in m.files if m else []:
                system.delete_file(f)


class WarcSource(DataSource):
    """Options: ``path`` (a folder). Read columns as in SCHEMA, or fewer by ``.schema(...)``.

    The reader takes what it needs from a record's headers first. Without the ``payload``
    column, and for records that a pushed condition turns away, blocks are skipped unread.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """The records to write for a table of pages, with the columns of SCHEMA.

    Of equal payloads of ``least`` bytes or more the one with the largest id is a response and
    the others revisit it. Equal means equal SHA-256 and length. Groups are found on narrow
    rows; only the ids of pages that revisit another are joined to the payloads.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("key"), F.octet_length(payload).cast("long").alias("size"))
    last = rows.filter(F.col("size") >= least).groupBy("key", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    old = (
        rows.drop("payload", "url").join(last, ["key", "size"]).filter("page_id <> last")
        .select(F.col("page_id").alias("old_id"), F.col("key").alias("old_key"), F.col("size").alias("old_size"), "last").distinct()
    )
    # by payload too: an id may stand at several
    joined = rows.join(old, (F.col("page_id") == F.col("old_id")) & (F.col("key") == F.col("old_key")) & (F.col("size") == F.col("old_size")), "left")
    revisit = F.col("last").isNotNull()
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), _record_id(F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        "url", F.lit(datetime.datetime(2024, 1, 1).strftime("%Y-%m-%dT%H:%M:%SZ")).alias("date"),
        F.concat(F.lit("sha1:"), F.sha1("payload")).alias("payload_digest"),
        F.when(revisit, _record_id(F.col("last"))).alias("refers_to"), F.col("size").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """Write pages as archives, read them back: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.

    Responses are read with their payload, and its length and SHA-1 are taken from the bytes
    read; revisits carry both in their headers. Null html is an empty payload; a null url
    stays null and a null id comes back null. Pages that repeat an id with one payload are
    all responses if the id is the largest of the group, else all revisits. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    register(spark)
    path = scratch_path(spark, "warc")
    records_of(pages, id_col, url_col, html_col, least).write.format("warc").mode("append").option("path", path).save()
    kind = pages.schema[id_col].dataType
    read = spark.read.format("warc").option("path", path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast(kind)
    headers = "record_type string, record_id string, url string, payload_digest string, refers_to string, payload_bytes long"
    full = read.load().filter(F.col("record_type") == "response").select(
        number(F.col("record_id")).alias("page_id"), "url", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"),
    )
    again = read.schema(headers).load().filter(F.col("record_type") == "revisit").select(
        number(F.col("record_id")).alias("page_id"), "url", "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type", number(F.col("refers_to")).alias("refers_to"),
    )
    return full.unionByName(again)
