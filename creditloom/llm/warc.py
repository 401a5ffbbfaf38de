"""WARC archives as a Python data source.

``spark.read.format("warc").load(folder)`` gives one row per record, ``df.write.format("warc")``
writes records. The reader plans partitions over files, so that each has about the same size; takes
over equality, membership and order filters on the record type and on header fields; parses a
record's header first; and steps over the block of a record that the filters reject, or whose payload
is not asked for, without reading it. Payloads are stored compressed where that is shorter.

Records are not compressed as a whole, so that a block can be stepped over by its length. A writing
task closes a file when it is full. Each commit adds a manifest of its own that names its files, so
appends add up; an overwrite's manifest also says which manifests it replaces, and only then are
their files removed. Files that a failed attempt leaves are in no manifest, and the reader follows
the manifests where there are any.
"""

from __future__ import annotations

import base64
import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from creditloom.llm.common import column_bytes, kept_in_store
from creditloom.session import scratch_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_length long, payload binary"
)
FILE_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
MANIFEST = "_manifest-"
DATE = "2024-01-01T00:00:00Z"
#: Payloads below this are never stored as revisits.
LEAST_REVISIT_BYTES = 1000
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "payload_length": "warc-payload-length",
}


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


@dataclass
class _Files(InputPartition):
    paths: list[str]


def record_bytes(
    record_id: str, record_type: str, uri: str, digest: str, length: int, refers_to: str | None, payload: bytes | None
) -> bytes:
    """One record. ``digest``: lower-case hex SHA-1 of the payload; ``payload`` None: a revisit's."""
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    body = b""
    if payload is not None:
        packed = gzip.compress(payload, 6, mtime=0)
        body = packed if len(packed) < len(payload) else payload
        if body is packed:
            http.append("Content-Encoding: gzip")
        http.append(f"Content-Length: {len(body)}")
    block = "\r\n".join([*http, "", ""]).encode() + body
    head = [
        "WARC/1.0",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(uri, safe='!#$%&()*+,/:;=?@[]~-._')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Payload-Length: {length}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def manifests(system, folder: str) -> dict[str, list[str]]:
    """Files by the name of the manifest that holds them; replaced manifests are left out."""
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    read = {}
    for info in found:
        if info.base_name.startswith(MANIFEST):
            with system.open_input_stream(info.path) as file:
                read[info.base_name] = json.loads(file.read())
    replaced = {name for m in read.values() for name in m["replaces"]}
    return {name: m["files"] for name, m in read.items() if name not in replaced}


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, out, filled = [], None, 0
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        for batch in iterator:
            names = ("record_id", "record_type", "target_uri", "payload_digest", "payload_length", "refers_to")
            columns = [batch.column(n).to_pylist() for n in names]
            for row in zip(*columns, column_bytes(batch.column("payload")), strict=True):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc"
                    out, filled = system.open_output_stream(f"{folder}/{name}"), 0
                    files.append(name)
                record = record_bytes(*row)
                out.write(record)
                filled += len(record)
                if filled >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        old: dict[str, list[str]] = {}
        gone: list[str] = []
        if self.overwrite:
            old = manifests(system, folder)
            there = {x.base_name for x in system.get_file_info(fs.FileSelector(folder)) if x.base_name.endswith(".warc")}
            # Without a manifest every archive of the folder is an old one.
            gone = sorted(there & {f for m in old.values() for f in m} if old else there - set(files))
        with system.open_output_stream(f"{folder}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"files": files, "replaces": sorted(old)}).encode())
        for name in gone:  # readers see the new files only from here on
            system.delete_file(f"{folder}/{name}")

    def abort(self, messages) -> None:
        system, folder = _opened(self.path)
        for message in messages:
            for name in message.files if message is not None else ():
                system.delete_file(f"{folder}/{name}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str):
        if payload not in ("decode", "skip"):
            raise ValueError("option payload must be decode or skip")
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        kinds = {
            EqualTo: "==",
            In: "in",
            GreaterThan: ">",
            GreaterThanOrEqual: ">=",
            LessThan: "<",
            LessThanOrEqual: "<=",
            StringStartsWith: "starts",
            IsNotNull: "there",
        }
        for f in filters:
            kind = kinds.get(type(f))
            if kind is None or len(f.attribute) != 1 or f.attribute[0] not in _FIELDS:
                yield f
            else:
                self.tests.append((f.attribute[0], kind, getattr(f, "value", None)))

    def partitions(self):
        from pyarrow import fs

        system, folder = _opened(self.path)
        found = {x.base_name: x for x in system.get_file_info(fs.FileSelector(folder)) if x.base_name.endswith(".warc")}
        listed = manifests(system, folder)
        names = sorted(f for files in listed.values() for f in files) if listed else sorted(found)
        groups: list[list[str]] = []
        filled = PARTITION_BYTES
        for name in names:
            if filled >= PARTITION_BYTES:
                groups.append([])
                filled = 0
            groups[-1].append(name)
            filled += found[name].size
        return [_Files(g) for g in groups] or [_Files([])]

    def _wanted(self, values: dict) -> bool:
        for column, kind, other in self.tests:
            value = values[column]
            if kind == "in":
                other = [x for x in other if x is not None]
            if value is None or not (
                kind == "there"
                or (kind == "==" and value == other)
                or (kind == "in" and value in other)
                or (kind == ">" and value > other)
                or (kind == ">=" and value >= other)
                or (kind == "<" and value < other)
                or (kind == "<=" and value <= other)
                or (kind == "starts" and value.startswith(other))
            ):
                return False
        return True

    def read(self, partition):
        system, folder = _opened(self.path)
        schema = pa.schema(
            [(n, pa.string()) for n in list(_FIELDS)[:-1]] + [("payload_length", pa.int64()), ("payload", pa.binary())]
        )
        rows, held = [], 0
        for name in partition.paths:
            with system.open_input_file(f"{folder}/{name}") as file:
                for values, payload in records(file, self._wanted, self.payload == "decode"):
                    rows.append({**values, "payload": payload})
                    held += len(payload or b"") + 200
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class _Stream:
    """Lines and stretches of a seekable file; a stretch that nobody wants is not read."""

    def __init__(self, file):
        self.file, self.held, self.at = file, b"", 0

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\n", self.at)) < 0:
            more = self.file.read(1 << 15)
            self.held, self.at = self.held[self.at :] + more, 0
            if not more:
                rest, self.held = self.held, b""
                return rest or None
        line = self.held[self.at : end + 1]
        self.at = end + 1
        return line

    def take(self, size: int) -> bytes:
        part = self.held[self.at : self.at + size]
        self.at += len(part)
        while len(part) < size:
            more = self.file.read(size - len(part))
            if not more:
                raise ValueError("an archive ends inside a record")
            part += more
        return part

    def skip(self, size: int) -> None:
        inside = min(size, len(self.held) - self.at)
        self.at += inside
        if inside < size:
            self.file.seek(size - inside, 1)


def records(file, wanted=lambda values: True, decode: bool = True) -> Iterator[tuple[dict, bytes | None]]:
    """(header values, payload) of an archive's records that are wanted by their header."""
    stream = _Stream(file)
    while True:
        first = stream.line()
        if first is None:
            return
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        values = {column: head.get(field) for column, field in _FIELDS.items()}
        for column in ("record_id", "refers_to"):
            values[column] = values[column] and values[column].strip("<>")
        digest = values["payload_digest"]
        if digest and digest.lower().startswith("sha1:"):
            values["payload_digest"] = base64.b32decode(digest[5:].upper()).hex()
        values["payload_length"] = int(values["payload_length"]) if values["payload_length"] else None
        if not wanted(values):
            stream.skip(size)
            continue
        if not decode or values["record_type"] != "response":
            stream.skip(size)
            yield values, None
            continue
        http, _, body = stream.take(size).partition(b"\r\n\r\n")
        packed = any(h.lower().replace(b" ", b"") == b"content-encoding:gzip" for h in http.split(b"\r\n"))
        yield values, gzip.decompress(body) if packed else body


class WarcSource(DataSource):
    """Options: path; payload = decode (the default) or skip. Modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "decode"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame) -> DataFrame:
    """Records of pages: of equal payloads of LEAST_REVISIT_BYTES or more, all but one are revisits.

    The record with the largest page_id is the response. Rows that share that page_id are all
    responses; a missing page_id is smaller than any. A null html is an empty payload, a null url an
    empty address. Columns other than page_id, url and html are not read.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_length": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    # The repeated payloads as a small table of their own: pages without repeats are not shuffled
    # where Spark finds it small, and a digest that very many pages share is an ordinary skewed join.
    repeated = (
        rows.where(F.col("payload_length") >= LEAST_REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and _first is not null")
        .drop("_n")
    )
    repeated = kept_in_store(repeated, "warc-repeated")
    joined = rows.join(repeated, "payload_digest", "left")
    long = F.col("payload_length") >= LEAST_REVISIT_BYTES
    revisit = F.coalesce(long & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.lit(False))
    return joined.select(
        page_urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.when(revisit, page_urn(F.col("_first"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_urn(page_id):
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives to the shared folder, reads them back, and tells what is there.

    Responses are read with their payloads decoded, and length and digest are those of the bytes;
    revisits, which have none, are read by their headers only, every block stepped over. Both scans
    push their record type down, so each skips the blocks of the other's records.
    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty
    payload, a null page_id stays null, repeated rows are records each, an empty table gives none. A
    payload of any length is one record. Columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    register(spark)
    path = scratch_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(path)

    def found(record_type: str, payload: str, length, digest) -> DataFrame:
        read = spark.read.format("warc").option("payload", payload).load(path)
        return read.where(F.col("record_type") == record_type).select(
            F.expr("try_cast(substring(record_id, 10) as bigint)").alias("page_id"),
            length.cast("long").alias("payload_bytes"),
            digest.alias("payload_digest"),
            "record_type",
            F.expr("try_cast(substring(refers_to, 10) as bigint)").alias("refers_to"),
        )

    responses = found("response", "decode", F.octet_length("payload"), F.sha1("payload"))
    return responses.unionByName(found("revisit", "skip", F.col("payload_length"), F.col("payload_digest")))
