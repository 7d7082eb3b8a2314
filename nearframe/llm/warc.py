"""WARC archives as a PySpark Python data source, and archiving pages without repeated payloads.

Every record is a gzip member of its own. The member's extra field ``sl`` holds
its compressed and its plain length, so a reader inflates the headers, judges
them, and steps over the rest of a record that nobody wants. Large files are
read in ranges; a range owns the members that start in it. Members without the
field (archives of other writers) are read one after the other, plain ``.warc``
files too.

A job's files count only once its manifest is written, after all tasks have
ended; what a lost or repeated task leaves behind is never read.

Defined results of :func:`archive_pages`
----------------------------------------
* A null html is the empty payload; a null url is written as an empty target.
* Of equal payloads of ``min_bytes`` or more, rows with the smallest ``page_id``
  are responses and the others revisit them. A null id is above every number; if
  all ids of a payload are null, all rows are responses. Rows that repeat the
  smallest id are all responses.
* An empty table makes an archive without records, which reads as an empty table.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = "record_type string, record_id string, target_uri string, headers map<string,string>, payload binary"
# Size of a file before a task starts another, and of a range that one task reads.
FILE_BYTES, RANGE_BYTES = 64 << 20, 32 << 20
# Payload bytes handed to Spark at a time.
BATCH_BYTES = 8 << 20
_HEAD_BYTES = 2048
_MAGIC = b"\x1f\x8b\x08\x04"
_EXTRA = "<H2sHII"  # length of the extra field, "sl", 8, compressed and plain length
_FIXED = 10 + struct.calcsize(_EXTRA)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def gzip_member(plain: bytes, level: int = 6) -> bytes:
    """One gzip member that tells its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    size = _FIXED + len(body) + 8
    if max(size, len(plain)) >> 32:
        raise ValueError("a record of 4 GiB or more does not fit the length field of its member")
    return (_MAGIC + b"\0\0\0\0\0\xff" + struct.pack(_EXTRA, 12, b"sl", 8, size & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
            + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF))


def record(record_type: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"WARC-Type: {record_type}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k.strip()}


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP message, or the block itself."""
    if headers.get("Content-Type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class Wanted:
    """Predicates on the record type and on headers, judged before a payload is inflated."""

    def __init__(self, types: set[str] | None = None, headers: dict[str, set[str]] | None = None):
        self.types, self.headers = types, headers or {}

    def accepts(self, headers: dict[str, str]) -> bool:
        return ((self.types is None or headers.get("WARC-Type") in self.types)
                and all(headers.get(k) in values for k, values in self.headers.items()))


def read_members(source, start: int, end: int, wanted: Wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Records whose member starts in ``start``..``end`` of a gzip file with lengths.

    A header that does not end, and a block that is cut off, broken or shorter
    than its ``Content-Length``, raise a ValueError.
    """
    at = _first_member(source, start, end)
    while at is not None and at < end:
        source.seek(at)
        head = source.read(_FIXED + _HEAD_BYTES)
        if not head:
            return
        length = _length(head)
        inflate = zlib.decompressobj(31)
        plain, fed = inflate.decompress(head[:length], 4 * _HEAD_BYTES), min(length, len(head))
        while b"\r\n\r\n" not in plain:
            more = inflate.unconsumed_tail or source.read(min(_HEAD_BYTES, max(length - fed, 0)))
            if not more or inflate.eof:
                raise ValueError(f"the header of the record at byte {at} does not end")
            fed += 0 if inflate.unconsumed_tail else len(more)
            plain += inflate.decompress(more, 4 * _HEAD_BYTES)
        top, _, block = plain.partition(b"\r\n\r\n")
        headers = parse_headers(top)
        if wanted.accepts(headers):
            if payload:
                rest = inflate.unconsumed_tail + source.read(length - fed)
                block += inflate.decompress(rest) + inflate.flush()
                declared = int(headers.get("Content-Length", 0))
                if not inflate.eof or len(block) < declared:
                    raise ValueError(f"the record at byte {at} has {len(block)} of {declared} bytes of its block")
                yield headers, payload_of(headers, block[:declared])
            else:
                yield headers, None
        at += length


def _length(head: bytes) -> int:
    if head[:4] == _MAGIC and head[12:14] == b"sl":
        return struct.unpack_from(_EXTRA, head, 10)[3]
    raise ValueError("not a gzip member with a length field")


def _first_member(source, start: int, end: int) -> int | None:
    """The first member at or after ``start``; a candidate has to inflate to a WARC header."""
    if start == 0:
        return 0
    source.seek(start)
    window, base = b"", start
    while base < end:
        chunk = source.read(1 << 20)
        if not chunk:
            return None
        window += chunk
        at = window.find(_MAGIC)
        while at >= 0:
            if window[at + 12:at + 14] == b"sl" or at + 14 > len(window):
                source.seek(base + at)
                try:
                    if zlib.decompressobj(31).decompress(source.read(512), 5) == b"WARC/":
                        return base + at
                except zlib.error:
                    pass
                source.seek(base + len(window))
            at = window.find(_MAGIC, at + 1)
        keep = min(len(window), 32)
        base, window = base + len(window) - keep, window[-keep:]
    return None


def read_stream(source, wanted: Wanted, payload: bool, gz: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Records of any WARC file, front to back; unwanted blocks are passed over."""
    stream = _Inflated(source) if gz else source
    buffer = b""
    while True:
        while b"\r\n\r\n" not in buffer.lstrip(b"\r\n") and (more := stream.read(1 << 16)):
            buffer += more
        buffer = buffer.lstrip(b"\r\n")
        if not buffer:
            return
        top, _, buffer = buffer.partition(b"\r\n\r\n")
        headers = parse_headers(top)
        left, keep = int(headers.get("Content-Length", 0)), wanted.accepts(headers)
        parts = []
        while left:
            if not buffer and not (buffer := stream.read(1 << 16)):
                raise ValueError("the archive ends inside a record")
            piece, buffer = buffer[:left], buffer[left:]
            left -= len(piece)
            if keep and payload:
                parts.append(piece)
        if keep:
            yield headers, payload_of(headers, b"".join(parts)) if payload else None


class _Inflated:
    """Concatenated gzip members as one stream."""

    def __init__(self, source):
        self.source, self.inflate, self.raw = source, zlib.decompressobj(31), b""

    def read(self, n: int) -> bytes:
        while True:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            raw = self.inflate.unconsumed_tail or self.raw or self.source.read(1 << 16)
            self.raw = b""
            if not raw:
                return b""
            if plain := self.inflate.decompress(raw, n):
                return plain


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None  # None: the whole file, front to back


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        types = options.get("recordtypes")
        self.wanted = Wanted(set(types.split(",")) if types else None,
                             {k: set(v) for k, v in json.loads(options.get("headerfilter", "{}")).items()})

    def pushFilters(self, filters):
        """Take equality and membership on the columns that are WARC headers; give back the rest."""
        for one in filters:
            values = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            header = {("record_id",): "WARC-Record-ID", ("target_uri",): "WARC-Target-URI"}.get(
                getattr(one, "attribute", None))
            if values is not None and one.attribute == ("record_type",):
                self.wanted.types = values if self.wanted.types is None else self.wanted.types & values
            elif values is not None and header:
                self.wanted.headers[header] = self.wanted.headers.get(header, values) & values
            else:
                yield one

    def partitions(self):
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        manifests = [f for f in found if f.base_name.startswith("_manifest-")]
        if manifests:
            names = set()
            for m in manifests:
                with fs.open_input_stream(m.path) as source:
                    names |= set(json.loads(source.read()))
            found = [f for f in found if f.base_name in names]
        out = []
        for f in found:
            if not re.search(r"\.warc(\.gz)?$", f.base_name):
                continue
            with fs.open_input_file(f.path) as source:
                head = source.read(_FIXED)
            if head[:4] == _MAGIC and head[12:14] == b"sl":
                out += [Range(f.path, at, min(at + self.range_bytes, f.size))
                        for at in range(0, f.size, self.range_bytes)]
            else:
                out.append(Range(f.path, 0, None))
        return out or [Range("", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(part.path) as source:
            if part.end is None:
                found = read_stream(source, self.wanted, self.payload, part.path.endswith(".gz"))
            else:
                found = read_members(source, part.start, part.end, self.wanted, self.payload)
            rows, held = [], 0
            for headers, payload in found:
                rows.append((headers, payload))
                held += len(payload or b"") + 500
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple[dict, bytes | None]]) -> pa.RecordBatch:
    heads = [h for h, _ in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([h.get("WARC-Type") for h in heads], pa.string()),
         pa.array([h.get("WARC-Record-ID") for h in heads], pa.string()),
         pa.array([h.get("WARC-Target-URI") for h in heads], pa.string()),
         pa.array([list(h.items()) for h in heads], pa.map_(pa.string(), pa.string())),
         pa.array([p for _, p in rows], pa.binary())],
        names=["record_type", "record_id", "target_uri", "headers", "payload"])


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of (record_type, headers, payload); each task its own files."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator) -> Files:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        names, sink, size = [], None, 0
        for batch in iterator:
            for row in zip(*(batch.column(n).to_pylist() for n in ("record_type", "headers", "payload"))):
                if sink is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    sink, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                kind, headers, payload = row
                http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n".encode()
                block = http + (payload or b"")
                member = gzip_member(record(kind, dict(headers), block))
                sink.write(member)
                size += len(member)
                if size >= self.file_bytes:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        return Files(names)

    def commit(self, messages) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as sink:
            sink.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages) -> None:
        fs, root = _open(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` with options path, recordTypes, headerFilter, payload, rangeBytes.

    Plain ``spark.read`` needs ``spark.sql.python.filterPushdown.enabled``; :func:`read_warc` sets it.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def _register(spark: SparkSession) -> None:
    """Make the format known. Spark looks it up in the session of the calling thread, which a new thread has none of."""
    spark.dataSource.register(WarcDataSource)
    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)


def read_warc(spark: SparkSession, path: str, record_types: list[str] | None = None,
              headers: dict[str, list[str]] | None = None, payload: bool = True) -> DataFrame:
    """Records of a file or folder.

    ``where`` on record_type, record_id and target_uri reaches the reader; for
    that the session's push-down to Python sources is switched on. Values of any
    other header are given as ``headers``, since a map column is not pushed down.
    """
    _register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("warc").option("payload", str(payload).lower())
    if record_types is not None:
        read = read.option("recordTypes", ",".join(record_types))
    if headers:
        read = read.option("headerFilter", json.dumps(headers))
    return read.load(path)


def page_records(pages: DataFrame, min_bytes: int = 100, salts: int = 16) -> DataFrame:
    """Record type, headers and payload per page; repeated payloads become revisits."""
    page = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    page = (page.withColumn("bytes", F.octet_length("payload").cast("long"))
            .withColumn("digest", F.sha2("payload", 256)))
    # One row per payload that repeats, copied once per salt, so that a payload of many pages meets it in many tasks.
    repeated = (page.where(F.col("bytes") >= min_bytes).groupBy("digest")
                .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
                .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    page = (page.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
            .join(repeated, ["digest", "salt"], "left")
            .withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")),
                                            F.col("first"))))

    def urn(page_id):
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"),
                        F.col("digest"), F.lit(">"))

    headers = F.map_concat(
        F.create_map(F.lit("WARC-Record-ID"), urn(F.col("page_id")),
                     F.lit("WARC-Target-URI"), F.regexp_replace("url", r"[\r\n]", ""),
                     F.lit("WARC-Date"), F.lit("1970-01-01T00:00:00Z"),
                     F.lit("Content-Type"), F.lit("application/http; msgtype=response"),
                     F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha256:"), F.col("digest")),
                     F.lit("X-Page-Id"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                     F.lit("X-Payload-Bytes"), F.col("bytes").cast("string")),
        F.when(F.col("refers_to").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(
            F.lit("WARC-Profile"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.lit("WARC-Refers-To"), urn(F.col("refers_to")),
            F.lit("X-Refers-To-Page-Id"), F.col("refers_to").cast("string"))))
    revisit = F.col("refers_to").isNotNull()
    return page.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), headers.alias("headers"),
                       F.when(~revisit, F.col("payload")).alias("payload"))


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 100) -> None:
    """Write one record per page below ``path``."""
    _register(pages.sparkSession)
    page_records(pages, min_bytes).write.format("warc").mode("append").save(path)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages as the archives have them. Payloads are inflated, hashed and held against their header for
    responses only; revisits are read without their block."""
    whole = read_warc(spark, path).where("record_type = 'response'").withColumn("hash", F.sha2("payload", 256))
    bare = (read_warc(spark, path, payload=False).where("record_type = 'revisit'")
            .withColumn("hash", F.lit(None).cast("string")))
    rows = whole.unionByName(bare)
    head = F.col("headers")
    declared = F.regexp_replace(head["WARC-Payload-Digest"], "^sha256:", "")
    checked = F.when((F.col("record_type") == "revisit") | (F.col("hash") == declared), declared).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("record_id"))))
    return rows.select(
        F.when(head["X-Page-Id"] != "", head["X-Page-Id"].cast("long")).alias("page_id"),
        F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long"))
        .otherwise(head["X-Payload-Bytes"].cast("long")).alias("payload_bytes"),
        checked.alias("payload_digest"), "record_type", head["X-Refers-To-Page-Id"].cast("long").alias("refers_to"))
