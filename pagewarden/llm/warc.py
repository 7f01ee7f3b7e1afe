"""WARC archives as a data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: each task writes one or more files of gzipped records (one gzip member per
record, its compressed length in the member's extra field) and the commit
publishes the names of its files in a manifest of its own, so files of lost or repeated attempts are never
read and appending keeps what was there. An overwrite hides all manifests before it. A loaded data frame
keeps the files that it saw first, as with other files; load anew to see later ones.

Reading: one partition per file, streamed in chunks; only one record is held at a time. Of each record
only the start is inflated, for its
headers; pushed predicates on record type and the other header columns are checked then, and the
rest of an unwanted record (or of any, with option payload=false) is skipped by its
compressed length without being read. Files of other writers, without that length,
are inflated through, whether their gzip members hold one record or many; time is linear in the file.

Predicates are pushed down with option pushdown=true. Spark 4.1 keeps what was pushed with the loaded
table, not with the query: a data frame of one such load that is used again with other predicates, or none, reads
by the last ones and loses rows. So ``pushed`` loads anew for each predicate; without the option any
reuse is right and Spark filters the rows.

A header that cannot be read, a missing or bad length and a file that ends inside a record are errors
that name the file: nothing after them could be found. An empty file has no records.
"""

import io
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
    StringStartsWith, WriterCommitMessage,
)

from pagewarden.llm.common import materialize
from pagewarden.operators.scale import run_dir

SCHEMA = ("page_id bigint, warc_type string, record_id string, target_uri string, warc_date string, "
          "payload_digest string, payload_length bigint, refers_to bigint, "
          "headers map<string,string>, payload binary")
ARROW = pa.schema([
    ("page_id", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()),
    ("target_uri", pa.string()), ("warc_date", pa.string()), ("payload_digest", pa.string()),
    ("payload_length", pa.int64()), ("refers_to", pa.int64()),
    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
# Header behind each column that predicates can be pushed to.
HEADER_OF = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
             "warc_date": "warc-date"}
DATE = "1970-01-01T00:00:00Z"  # archives carry no clock: equal input, equal archive
LEVEL = 3
ROLL_BYTES = 64 << 20
HEAD_BYTES = 4096
MAX_HEAD_BYTES = 1 << 20  # a longer header is taken for a broken file
CHUNK_BYTES, PIECE_BYTES = 1 << 20, 1 << 14  # read at once, inflated at once
BATCH_BYTES, BATCH_RECORDS = 8 << 20, 1000
MANIFEST = "_manifest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def file_system(path: str) -> tuple:
    """(file system, path in it) of a URI or local path."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def _line(value: str) -> str:
    return quote(value, safe="".join(chr(c) for c in range(33, 127))) if not value.isascii() \
        or any(c < " " or c == "\x7f" for c in value) else value


def record(page_id, url, kind: str, digest: str, length: int, refers_to, payload: bytes) -> bytes:
    """One uncompressed record."""
    head = [f"WARC-Type: {kind}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if page_id is None:
        head.append(f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}>")
    else:
        head += [f"WARC-Record-ID: <urn:page:{page_id}>", f"X-Page-ID: {page_id}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = HTTP % length + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member that carries its own compressed length."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 10 + 2 + 8 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHI", 8, b"SL", 4, size)
            + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF))


def parse_head(raw: bytes):
    """(headers, offset of the block), or None if the header does not end in ``raw``."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    first, *lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record header: {first[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not re.fullmatch("[0-9]+", headers.get("content-length", "")):
        raise ValueError(f"record without a length: {headers.get('warc-record-id')}")
    return headers, end + 4


class Bytes:
    """The bytes that ``more()`` gives chunk by chunk; it gives none at the end."""

    def __init__(self, more):
        self.more, self.held, self.at = more, b"", 0

    def peek(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        while len(self.held) - self.at < n and (chunk := self.more()):
            self.held, self.at = self.held[self.at:] + chunk, 0
        return self.held[self.at: self.at + n]

    def some(self, n: int) -> bytes:
        """At least one and at most ``n`` bytes; none at the end."""
        if self.at == len(self.held):
            self.held, self.at = self.more(), 0
        piece = self.held[self.at: self.at + n]
        self.at += len(piece)
        return piece

    def pieces(self, n: int):
        while n:
            piece = self.some(n)
            if not piece:
                raise ValueError("file ends inside a record")
            n -= len(piece)
            yield piece

    def take(self, n: int) -> bytes:
        return b"".join(self.pieces(n))

    def skip(self, n: int) -> None:
        for _ in self.pieces(n):
            pass

    def back(self, n: int) -> None:
        """Gives back the last ``n`` bytes of the last piece."""
        self.at -= n


class FileBytes(Bytes):
    """Bytes of an open file; what is skipped beyond the chunk is not read."""

    def __init__(self, file):
        super().__init__(lambda: file.read(CHUNK_BYTES))
        self.file, self.size = file, file.seek(0, 2)
        file.seek(0)

    def skip(self, n: int) -> None:
        beyond = n - (len(self.held) - self.at)
        if beyond <= 0:
            self.at += n
            return
        self.held, self.at = b"", 0
        if self.file.tell() + beyond > self.size:
            raise ValueError("file ends inside a record")
        self.file.seek(beyond, 1)


def inflated(packed: Bytes):
    """``more`` of the contents of all gzip members from here on."""
    unpack, tail = None, b""

    def more():
        nonlocal unpack, tail
        while True:
            if unpack is None:
                if not packed.peek(1):
                    return b""
                unpack = zlib.decompressobj(31)
            piece = tail or packed.some(PIECE_BYTES)
            if not piece:
                raise ValueError("file ends inside a gzip member")
            out = unpack.decompress(piece, CHUNK_BYTES)
            tail = unpack.unconsumed_tail
            if unpack.eof:
                packed.back(len(unpack.unused_data))
                unpack, tail = None, b""
            if out:
                return out
    return more


def _plain_records(source: Bytes, wanted, with_payload: bool):
    while source.peek(1):
        if source.peek(2) == b"\r\n":  # records end with two empty lines, some writers add more
            source.skip(2)
            continue
        size = HEAD_BYTES
        while (parsed := parse_head(head := source.peek(size))) is None:
            if len(head) < size or size >= MAX_HEAD_BYTES:
                raise ValueError(f"record header without an end: {head[:40]!r}")
            size *= 2
        headers, start = parsed
        source.skip(start)
        length = int(headers["content-length"])
        if not wanted(headers):
            source.skip(length)
        elif with_payload:
            yield headers, payload_of(headers, source.take(length))
        else:
            source.skip(length)
            yield headers, None


def _own_record(source: Bytes, size: int, wanted, with_payload: bool):
    """The record of a member that carries its compressed length, if it is wanted."""
    unpack, raw, parsed = zlib.decompressobj(31), b"", None
    while parsed is None:
        piece = unpack.unconsumed_tail
        if not piece:
            if not size or len(raw) > MAX_HEAD_BYTES:
                raise ValueError(f"record header without an end: {raw[:40]!r}")
            piece = source.take(min(size, HEAD_BYTES))
            size -= len(piece)
        raw += unpack.decompress(piece, HEAD_BYTES)
        parsed = parse_head(raw)
    headers, start = parsed
    if not wanted(headers):
        source.skip(size)
    elif not with_payload:
        source.skip(size)
        yield headers, None
    else:
        end = start + int(headers["content-length"])
        raw += unpack.decompress(unpack.unconsumed_tail + source.take(size))
        if not unpack.eof or len(raw) < end:
            raise ValueError(f"record is cut off: {headers.get('warc-record-id')}")
        yield headers, payload_of(headers, raw[start:end])


def _compressed_length(start: bytes):
    if len(start) >= 20 and start[:4] == b"\x1f\x8b\x08\x04" and start[12:16] == b"SL\x04\0":
        return struct.unpack_from("<I", start, 16)[0]
    return None


def records(file, wanted, with_payload: bool):
    """(headers, payload or None) of the wanted records of an archive, an open file or its bytes."""
    source = FileBytes(io.BytesIO(file) if isinstance(file, bytes) else file)
    if source.peek(2) != b"\x1f\x8b":
        yield from _plain_records(source, wanted, with_payload)
        return
    while start := source.peek(20):
        length = _compressed_length(start)
        if not length:  # of another writer: where its records begin is known only from its contents
            yield from _plain_records(Bytes(inflated(source)), wanted, with_payload)
            return
        yield from _own_record(source, length, wanted, with_payload)


def payload_of(headers: dict, block: bytes):
    if headers.get("warc-type") == "revisit":
        return None
    if block.startswith(b"HTTP/"):
        return block[block.find(b"\r\n\r\n") + 4:]
    return block


def _number(text: str):
    return int(text) if text.lstrip("-").isdigit() else None


def _row(headers: dict, payload) -> tuple:
    refers = headers.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
    return (_number(headers.get("x-page-id", "")), headers.get("warc-type"), headers.get("warc-record-id"),
            headers.get("warc-target-uri"), headers.get("warc-date"),
            headers.get("warc-payload-digest", "").removeprefix("sha256:") or None,
            _number(headers.get("x-payload-length", "")), _number(refers), list(headers.items()), payload)


@dataclass
class FilePart(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list


def _manifests(system, base: str) -> list:
    """(number, kind, path) of the manifests of a folder."""
    names = [i.path for i in system.get_file_info(pafs.FileSelector(base, allow_not_found=True))]
    found = [(re.search(rf"/{MANIFEST}-(\d+)-(append|overwrite)-[0-9a-f]+$", n), n) for n in names]
    return sorted((int(m.group(1)), m.group(2), n) for m, n in found if m)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true") != "false"
        self.tests = []  # (header, kind, values)

    def wanted(self, headers: dict) -> bool:
        for name, kind, value in self.tests:
            have = headers.get(name)
            if have is None or (have not in value if kind == "in" else not have.startswith(value)):
                return False
        return True

    def partitions(self):
        system, base = file_system(self.path)
        if system.get_file_info(base).type == pafs.FileType.File:
            return [FilePart(base)]
        manifests = _manifests(system, base)
        if manifests:
            since = max((n for n, kind, _ in manifests if kind == "overwrite"), default=0)
            names = []
            for number, _, path in manifests:
                if number >= since:
                    with system.open_input_stream(path) as file:
                        names += [f"{base}/{n}" for n in file.read().decode().split("\n") if n]
        else:
            names = [i.path for i in system.get_file_info(pafs.FileSelector(base, recursive=True))
                     if re.search(r"\.warc(\.gz)?$", i.path)]
        return [FilePart(n) for n in sorted(names)]

    def read(self, partition):
        if partition is None:  # no file at all
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as file:
            try:
                yield from self._batches(file)
            except (ValueError, zlib.error) as error:
                raise ValueError(f"{partition.path}: {error}") from error

    def _batches(self, file):
        rows, size = [], 0
        for headers, payload in records(file, self.wanted, self.with_payload):
            rows.append(_row(headers, payload))
            size += len(payload or b"") + 500
            if size >= BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class PushingReader(WarcReader):
    def pushFilters(self, filters):
        for f in filters:
            name = HEADER_OF.get(f.attribute[0]) if getattr(f, "attribute", None) else None
            if name and isinstance(f, EqualTo):
                self.tests.append((name, "in", [f.value]))
            elif name and isinstance(f, In):
                self.tests.append((name, "in", list(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            else:
                yield f  # left to Spark


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite=False):
        self.path, self.kind = options["path"], "overwrite" if overwrite else "append"

    def write(self, iterator):
        system, base = file_system(self.path)
        system.create_dir(base, recursive=True)
        names, file, size = [], None, 0
        for batch in iterator:
            columns = {f: batch.column(i).to_pylist() for i, f in enumerate(batch.schema.names)}
            for row in zip(*[columns[c] for c in ("page_id", "target_uri", "warc_type", "payload_digest",
                                                  "payload_length", "refers_to", "payload")]):
                if file is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    file, size = system.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                packed = member(record(*row[:6], row[6] or b""))
                file.write(packed)
                size += len(packed)
                if size >= ROLL_BYTES:
                    file.close()
                    file = None
        if file is not None:
            file.close()
        return Written(names)

    def commit(self, messages):
        """Of two writers at once that take one number both are kept, unless a later number overwrites them."""
        system, base = file_system(self.path)
        system.create_dir(base, recursive=True)
        number = 1 + max((n for n, _, _ in _manifests(system, base)), default=0)
        name = f"{MANIFEST}-{number}-{self.kind}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{base}/.{name}") as file:
            file.write("\n".join(n for m in messages if m for n in m.files).encode())
        system.move(f"{base}/.{name}", f"{base}/{name}")  # never seen half written

    def abort(self, messages):
        """Unpublished files are never read: nothing to undo."""


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushingReader if self.options.get("pushdown") == "true" else WarcReader)(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def pushed(spark: SparkSession, path: str, predicate: str, payload=True) -> DataFrame:
    """The records for which a predicate on header columns holds, checked before payloads are read.

    For one use in one query, see above.
    """
    register(spark)
    return spark.read.format("warc").option("pushdown", "true").option(
        "payload", str(payload).lower()).load(path).where(predicate)


def records_of(pages: DataFrame, min_bytes=100, id_column="page_id", url="url", html="html") -> DataFrame:
    """Rows to write: of equal payloads of ``min_bytes`` or more the smallest id is the
    response, the others revisit it.

    Null html is an empty payload. Rows without an id are always responses and are never referred
    to; rows that share the smallest id are all responses.
    """
    rows = pages.select(
        F.col(id_column).cast("bigint").alias("page_id"), F.col(url).alias("target_uri"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_length", F.octet_length("payload").cast("bigint")).withColumn(
        "payload_digest", F.sha2("payload", 256))
    groups = materialize(
        rows.where(F.col("payload_length") >= min_bytes).groupBy("payload_digest").agg(
            F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "warc-groups")
    revisit = F.col("page_id") > F.col("first")
    rows = rows.join(groups, "payload_digest", "left")
    return rows.select(
        "page_id", "target_uri", F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        "payload_digest", "payload_length", F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"))


def archive(pages: DataFrame, path: str = None, **columns) -> str:
    """Writes one record per row; returns the folder, by default one that ``scale.close`` removes."""
    spark = pages.sparkSession
    register(spark)
    path = path or f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    records_of(pages, **columns).write.format("warc").mode("append").save(path)
    return path
