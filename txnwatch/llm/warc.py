"""WARC archives as a PySpark data source, with revisit records for repeated payloads.

Writing: each task writes one archive of plain records, whose HTTP bodies are
gzip-coded; the driver's commit lists the archives, and where they may be split, in
a manifest, so files of lost or repeated task attempts are never read.

Reading: the manifest plans the partitions.  Filters on ``record_type`` and on
the other header columns are pushed down: a record's headers are parsed first,
and the block of a record that they reject, or whose payload isn't asked for, is
skipped by its length and never decoded.

Options: ``path`` (a URI that pyarrow's file systems open, shared by all
executors), ``payload`` (false: the column stays null), ``verify`` (true: digest and
length of responses are taken from the decoded payload).
"""

from __future__ import annotations

import base64
import dataclasses
import gzip
import hashlib
import io
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)

#: Bytes after which a reading task's share of an archive ends.
SPLIT_BYTES = 64 << 20
#: Bytes of payload that a reader hands on at once.
BATCH_BYTES = 8 << 20
#: Fixed value: the profile of revisits of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, record_type string, url string, refers_to long, payload_digest string, payload_bytes long, record_id string, payload string"
_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_id", pa.string()), ("payload", pa.string())])


def file_system(uri: str):
    """(file system, path) of a URI or a plain local path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(text: str) -> str:
    """A header value on one line: controls and per cent signs are escaped."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in text)


def _unheader(text: str) -> str:
    import re
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text)


def record(page_id, record_type: str, url, refers_to, payload: bytes, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP headers only."""
    digest = payload_digest(payload)
    head = [("WARC-Type", record_type), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{record_type}/{url}/{digest}')}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _header(url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    head += [("X-Page-ID", str(page_id))] * (page_id is not None)
    body = b""
    if record_type == "revisit":
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    else:
        body = gzip.compress(payload, 1, mtime=0)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(body)))]
    return b"".join([b"WARC/1.1\r\n", "".join(f"{k}: {v}\r\n" for k, v in head).encode(), b"\r\n", http, body, b"\r\n\r\n"])


@dataclasses.dataclass
class Archive(WriterCommitMessage):
    """A written file, its records and the offsets where a reader may begin."""

    file: str
    records: int
    splits: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")
        if overwrite:
            raise ValueError("an archive folder is written once or appended to, not overwritten")

    def write(self, iterator):
        fs, folder = file_system(self.uri)
        fs.create_dir(folder, recursive=True)
        name, n, at, splits = f"part-{uuid.uuid4().hex}.warc", 0, 0, [0]
        with fs.open_output_stream(f"{folder}/{name}", buffer_size=1 << 20) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = record(row["page_id"], row["record_type"], row["url"], row["refers_to"], (row["payload"] or "").encode(), self.date)
                    if at - splits[-1] >= SPLIT_BYTES:
                        splits.append(at)
                    out.write(data)
                    n, at = n + 1, at + len(data)
        return Archive(name, n, [*splits, at])

    def commit(self, messages):
        fs, folder = file_system(self.uri)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([dataclasses.asdict(m) for m in messages if m is not None and m.records]).encode())

    def abort(self, messages):
        fs, folder = file_system(self.uri)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{folder}/{m.file}")


@dataclasses.dataclass
class Share(InputPartition):
    """Bytes [start, end) of an archive; end -1: to its end."""

    file: str
    start: int
    end: int


_TESTS = {
    EqualTo: lambda f, x: x is not None and x == f.value, In: lambda f, x: x is not None and x in f.value,
    IsNull: lambda f, x: x is None, IsNotNull: lambda f, x: x is not None,
    GreaterThan: lambda f, x: x is not None and x > f.value, GreaterThanOrEqual: lambda f, x: x is not None and x >= f.value,
    LessThan: lambda f, x: x is not None and x < f.value, LessThanOrEqual: lambda f, x: x is not None and x <= f.value,
    StringStartsWith: lambda f, x: x is not None and x.startswith(f.value), StringEndsWith: lambda f, x: x is not None and x.endswith(f.value),
    StringContains: lambda f, x: x is not None and f.value in x,
}


def parse_headers(stream, end: int = -1) -> dict[str, str] | None:
    """Headers by lower-cased name of the next record that begins before ``end``; None if there is none."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        if 0 <= end <= stream.tell():
            return None
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins here: {line[:40]!r}")
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _columns(head: dict[str, str]) -> dict:
    """What the header columns of a record hold."""
    number = lambda k: int(head[k]) if head.get(k, "").lstrip("-").isdigit() else None
    digest, url = head.get("warc-payload-digest"), head.get("warc-target-uri")
    return {"page_id": number("x-page-id"), "record_type": head.get("warc-type"), "url": None if url is None else _unheader(url),
            "refers_to": number("x-refers-to-page-id"), "payload_digest": digest and digest.partition(":")[2] or None,
            "payload_bytes": number("x-payload-length"), "record_id": head.get("warc-record-id")}


def http_body(block: bytes) -> bytes:
    """The payload of an HTTP response, decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"content-encoding: gzip" in head.lower():
        return zlib.decompress(body, 47)
    return body


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            settled = self.verify and f.attribute[0] in ("payload_digest", "payload_bytes") if type(f) in _TESTS else True
            if settled or len(f.attribute) != 1 or f.attribute[0] == "payload":
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        fs, folder = file_system(self.uri)
        from pyarrow.fs import FileSelector
        names = sorted(x.base_name for x in fs.get_file_info(FileSelector(folder)))
        listed = [json.loads(fs.open_input_stream(f"{folder}/{n}").read()) for n in names if n.startswith("_manifest-")]
        if listed:
            return [Share(a["file"], p, q) for part in listed for a in part for p, q in zip(a["splits"][:-1], a["splits"][1:], strict=True)]
        return [Share(n, 0, -1) for n in names if n.endswith((".warc", ".warc.gz"))]

    def read(self, partition):
        if partition is None:  # of an empty archive
            return
        fs, folder = file_system(self.uri)
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_pylist(rows, schema=_ARROW)
        raw = fs.open_input_file(f"{folder}/{partition.file}")
        packed = partition.file.endswith(".gz")
        with io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 18) as stream:
            stream.seek(partition.start)
            while (head := parse_headers(stream, partition.end)) is not None:
                size, row = int(head["content-length"]), _columns(head)
                if not all(_TESTS[type(f)](f, row[f.attribute[0]]) for f in self.filters):
                    stream.seek(size, io.SEEK_CUR)
                    continue
                row["payload"] = None
                if row["record_type"] == "response" and (self.payload or self.verify):
                    body = http_body(stream.read(size))
                    if self.payload:
                        row["payload"] = body.decode("utf-8", "replace")
                        held += len(body)
                    if self.verify:
                        row["payload_digest"], row["payload_bytes"] = payload_digest(body), len(body)
                else:
                    stream.seek(size, io.SEEK_CUR)
                rows.append(row)
                held += 500
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("warc") known to the session, with filters pushed down."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to) of each row of ``pages``.

    Of rows with equal payloads of at least ``least_bytes`` bytes in UTF-8 those with the
    least id are responses, the others revisits that refer to it.  A null
    payload is the empty one.  A null id is never the least: such a row
    is a revisit where its payload has an id, and a response elsewhere.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    p = p.withColumn("key", F.sha2("payload", 256))
    shared = p.filter(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("of"), F.count(F.lit(1)).alias("n")).filter("n > 1 and of is not null").drop("n")
    again = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("of"))
    return p.join(shared, "key", "left").select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"),
                                                F.when(again, F.col("of")).alias("refers_to"))


def write_archive(records: DataFrame, path: str) -> None:
    """Append records (page_id, url, payload, record_type, refers_to) to the archives in ``path``."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)
