"""WARC archives as a PySpark data source (operator 6): spark.read / df.write .format("warc").

Writing: each task writes files of one gzip member a record, rolled at a size, and a committed list
makes only files of successful tasks count. A member's extra field ("sl": compressed and plain length)
lets a reader jump over it. Reading: files are packed into partitions of about a size; of each record the
header is decoded first, predicates on the record type and other headers are tested there, and the payload
of a record that fails them, or that nobody wants, is never decompressed.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = T.StructType([
    T.StructField("record_type", T.StringType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_length", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])
#: Header names of the format; the last is ours, as a revisit does not hold its payload.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length",
}
END = b"\r\n\r\n"


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def member(record: bytes) -> bytes:
    """A gzip member that tells its own lengths."""
    z = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 4 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(values: dict, payload: bytes | None) -> bytes:
    """One record; a response or revisit block is an HTTP head and, for a response, the payload."""
    kind = values["record_type"] or "resource"
    if kind in ("response", "revisit"):
        n = len(payload) if payload is not None else values.get("payload_length") or 0
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % n + END
        block += payload or b"" if kind == "response" else b""
        media = "application/http; msgtype=response"
    else:
        block, media = payload or b"", "application/octet-stream"
    lines = ["WARC/1.1"]
    for name, header in HEADERS.items():
        value = values.get(name)
        if value is not None:
            lines.append(f"{header}: {' '.join(str(value).split(chr(13) + chr(10))).replace(chr(10), ' ')}")
    lines += [f"Content-Type: {media}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.roll = options["path"], int(options.get("rollbytes", 64 << 20))
        self.names, self.overwrite = schema.names, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, top = _files(self.path)
        fs.create_dir(top, recursive=True)
        files, out, size = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or size >= self.roll:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(f"{top}/{files[-1]}", compression=None)
                    info = {"record_type": "warcinfo", "record_id": f"<urn:uuid:{uuid.uuid4()}>", "date": row.get("date")}
                    size = out.write(member(record(info, b"format: WARC File Format 1.1\r\n"))) or 0
                got = member(record(row, row.get("payload")))
                out.write(got)
                size += len(got)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, top = _files(self.path)
        fs.create_dir(top, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(top)):
                if old.base_name.startswith("_committed-"):
                    fs.delete_file(old.path)
        with fs.open_output_stream(f"{top}/_committed-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list) -> None:
        """Files without a commit are never read."""


@dataclass
class Files(InputPartition):
    paths: list


#: Tests of pushed predicates on header values, by the names of PySpark's filter classes.
TESTS = {
    "EqualTo": lambda a, f: a is not None and a == f.value,
    "In": lambda a, f: a is not None and a in f.value,
    "IsNotNull": lambda a, f: a is not None,
    "IsNull": lambda a, f: a is None,
    "StringStartsWith": lambda a, f: a is not None and a.startswith(f.value),
    "StringEndsWith": lambda a, f: a is not None and a.endswith(f.value),
    "StringContains": lambda a, f: a is not None and f.value in a,
    "GreaterThan": lambda a, f: a is not None and a > f.value,
    "GreaterThanOrEqual": lambda a, f: a is not None and a >= f.value,
    "LessThan": lambda a, f: a is not None and a < f.value,
    "LessThanOrEqual": lambda a, f: a is not None and a <= f.value,
}


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.split = options["path"], int(options.get("splitbytes", 32 << 20))
        self.names = schema.names
        self.types = set(filter(None, options.get("recordtypes", "").split(",")))
        self.payload = options.get("payload", "true").lower() != "false" and "payload" in self.names
        self.tests: list = []

    def pushFilters(self, filters: list) -> Iterator:
        """Take the predicates that headers decide; Spark applies the others."""
        for f in filters:
            if type(f).__name__ in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], type(f).__name__, f))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, top = _files(self.path)
        found = fs.get_file_info(pafs.FileSelector(top, recursive=False))
        lists = [f for f in found if f.base_name.startswith("_committed-")]
        listed = None
        if lists:
            listed = set()
            for f in lists:
                with fs.open_input_stream(f.path) as s:
                    listed |= set(json.loads(s.read()))
        parts, size = [[]], 0
        for f in sorted(found, key=lambda f: f.base_name):
            if f.is_file and (f.base_name in listed if listed is not None else f.base_name.endswith((".warc.gz", ".warc"))):
                if parts[-1] and size + f.size > self.split:
                    parts.append([])
                    size = 0
                parts[-1].append(f.path)
                size += f.size
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _files(self.path)
        schema = pa.schema([(n, pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string()) for n in self.names])
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
                for row in self.records(f):
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def wanted(self, row: dict) -> bool:
        return (not self.types or row["record_type"] in self.types) and all(TESTS[kind](row[name], f) for name, kind, f in self.tests)

    def records(self, f) -> Iterator[dict]:
        """Header first; a record whose payload is not needed is passed over by its stored length."""
        rest = b""
        while True:
            if len(rest) < 24:
                rest += f.read(1 << 16)
            if not rest:
                return
            if rest[:2] == b"\x1f\x8b" and rest[3] == 4 and rest[12:14] == b"sl":
                size = struct.unpack_from("<I", rest, 16)[0]
                while len(rest) < size:
                    more = f.read(max(1 << 16, size - len(rest)))
                    if not more:
                        raise ValueError("the archive ends inside a record")
                    rest += more
                one, rest = memoryview(rest)[24 : size - 8], rest[size:]
                z = zlib.decompressobj(-15)
                head = z.decompress(one, 2048)
                while (end := head.find(END)) < 0:
                    more = z.decompress(z.unconsumed_tail, 2048)
                    if not more:
                        raise ValueError("a record without a header")
                    head += more
                row, length = self._header(head[:end])
                if self.wanted(row):
                    if self.payload:
                        block = (head + z.decompress(z.unconsumed_tail) + z.flush())[end + 4 :][:length]
                        self._payload(row, block)
                    yield {n: row.get(n) for n in self.names}
                continue
            # any other gzip or plain archive: read in order
            plain = _Plain(f, rest)
            while (got := plain.header()) is not None:
                row, length = self._header(got)
                keep = self.wanted(row)
                block = plain.take(length + 4, keep and self.payload)
                if keep:
                    if self.payload:
                        self._payload(row, block[:length])
                    yield {n: row.get(n) for n in self.names}
            return

    @staticmethod
    def _header(head: bytes) -> tuple[dict, int]:
        at = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            at[name.strip().lower()] = value.strip()
        row = {n: at.get(h.lower()) for n, h in HEADERS.items()}
        row["payload_length"] = int(row["payload_length"]) if (row["payload_length"] or "").isdigit() else None
        row["_http"] = at.get("content-type", "").startswith("application/http")
        return row, int(at.get("content-length") or 0)

    @staticmethod
    def _payload(row: dict, block: bytes) -> None:
        if row["_http"]:
            block = block[block.find(END) + 4 :] if END in block else b""
        row["payload"] = None if row["record_type"] == "revisit" else bytes(block)


class _Plain:
    """Bytes of an archive without stored lengths, decompressed as they are read."""

    def __init__(self, f, rest: bytes):
        self.f, self.raw = f, rest
        self.gz = zlib.decompressobj(31) if rest[:2] == b"\x1f\x8b" else None
        self.have = b""

    def more(self) -> bool:
        while True:
            raw, self.raw = self.raw or self.f.read(1 << 18), b""
            if not raw:
                return False
            if self.gz is None:
                self.have += raw
                return True
            got = self.gz.decompress(raw)
            if self.gz.eof:
                self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            self.have += got
            if got:
                return True

    def header(self) -> bytes | None:
        while (end := self.have.find(END)) < 0:
            if not self.more():
                return None
        head, self.have = self.have[:end], self.have[end + 4 :]
        return head.lstrip(b"\r\n")

    def take(self, n: int, keep: bool) -> bytes:
        out = []
        while n > 0:
            if not self.have and not self.more():
                break
            part, self.have = self.have[:n], self.have[n:]
            n -= len(part)
            if keep:
                out.append(part)
        return b"".join(out)


class WarcSource(DataSource):
    """Options: path; reading: recordtypes (comma list), payload (false: headers only), splitbytes; writing: rollbytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """WARC records of a page table: payloads of least_bytes or more that are equal keep one response, at the largest key; the others revisit it.

    A null html is an empty payload. Rows that share both key and payload are all responses. A row with a
    null key refers to the response if there is another, and has no record id. The groups are counted
    before the join, so only one row a payload meets the pages; Spark splits a hot payload's pages.
    """
    p = pages.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").alias("target_uri"), F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    # small payloads get keys of their own: they find no group and do not meet in one partition
    p = p.withColumn("g", F.when(F.col("payload_length") >= least_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("k").cast("string"), F.lit("")))))
    groups = p.where(F.col("payload_length") >= least_bytes).groupBy("g").agg(F.max("k").alias("first"), F.count("*").alias("n")).where("n > 1").select("g", "first")
    j = p.join(groups, "g", "left")
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("k") == F.col("first"), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return j.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("k")).alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
