"""WARC archives through a chunked record table (operator 5).

Payloads become rows (record, chunk number, data) of bounded size, cut while a
digest runs along; the digest and the length stand on a record's last chunk.
Which record is a revisit is decided on those slim rows. Writing and reading
stream chunk by chunk, so no step after the input row holds a whole record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_path

CHUNK = 1 << 20
_FLUSH = 8 << 20
_DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs

_CHUNK_ROWS = pa.schema([("row_id", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()),
                         ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def b32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def chunk_table(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK) -> DataFrame:
    """``row_id, page_id, url, chunk_no, data, last, payload_bytes, payload_digest``.

    One row for each ``chunk`` bytes of a payload, at least one a page; a null
    payload is empty. Length and SHA-1 (base 32) so far stand in each row's
    count, the digest on the last one. Written to the shared folder.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("row_id"), F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row, page, link = (batch.column(k)[i].as_py() for k in range(3))
                payload = memoryview(batch.column(3)[i].as_buffer())
                digest = hashlib.sha1()
                for n, at in enumerate(range(0, max(1, len(payload)), chunk)):
                    part = bytes(payload[at:at + chunk])
                    digest.update(part)
                    end = at + len(part)
                    last = end == len(payload)
                    out.append((row, page, link if n == 0 else None, n, part, last, end, b32(digest) if last else None))
                    held += len(part) + 100
                    if held >= _FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CHUNK_ROWS)], schema=_CHUNK_ROWS)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CHUNK_ROWS)], schema=_CHUNK_ROWS)

    return materialize(rows.mapInArrow(cut, "row_id long, page_id long, url string, chunk_no long, data binary, last boolean, payload_bytes long, payload_digest string"), "warc-chunks")


def decide(chunks: DataFrame, least: int = 0) -> DataFrame:
    """``row_id, page_id, payload_bytes, payload_digest, record_type, refers_to, refers_row``.

    Of records with equal payloads (digest and length) of at least ``least``
    bytes the one with the smallest page id is the response, null ids last and
    one of them if rows repeat; the others revisit it. Only last chunks' slim
    columns are read, and summed before the shuffle.
    """
    ends = chunks.filter("last").select("row_id", "page_id", "payload_bytes", "payload_digest")
    first = (ends.groupBy("payload_digest", "payload_bytes")
             .agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row_id")).alias("first")))
    revisit = (F.col("payload_bytes") >= least) & (F.col("row_id") != F.col("first.row_id"))
    return ends.join(first, ["payload_digest", "payload_bytes"]).select(
        "row_id", "page_id", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.row_id")).alias("refers_row"))


def _urn(page: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page}:{row}')}>"


def _head(page, row, size, digest, kind, refers, refers_row, url) -> bytes:
    """WARC header and the HTTP header that starts the block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    length = len(http) + (size if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page, row)}", f"WARC-Date: {_DATE}",
             f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers, refers_row)}"]
        if refers is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
          chunk: int = CHUNK, archives: int | None = None) -> DataFrame:
    """Write a record per row to ``path``/archive-*.warc.gz; returns ``archive, records``.

    ``path`` is a folder all executors reach (a mounted one, or a store that
    pyarrow's file systems open). Each task streams one archive, a gzip member
    per record, under a name of its attempt and renames it when it is complete,
    so a lost or repeated attempt leaves no partial archive behind its name.

    A null html is an empty payload; a null url or id leaves its header line
    out; rows that repeat an id are records of their own. Payloads go chunk by
    chunk, however long. An empty table gives no archive; other columns are
    ignored.
    """
    spark = pages.sparkSession
    chunks = chunk_table(pages, page_id, url, html, chunk)
    decided = decide(chunks, least).withColumnRenamed("payload_digest", "digest")
    heads = decided.join(chunks.filter("chunk_no = 0").select("row_id", "url"), "row_id").select(
        "row_id", F.lit(-1).cast("long").alias("chunk_no"), F.lit(None).cast("binary").alias("data"), "page_id", "url",
        F.col("payload_bytes").alias("size"), "digest", "record_type", "refers_to", "refers_row")
    none = {"page_id": "long", "url": "string", "size": "long", "digest": "string", "record_type": "string", "refers_to": "long", "refers_row": "long"}
    body = chunks.filter("payload_bytes > 0").select("row_id", "chunk_no", "data", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    n = archives or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/archive-{context.partitionId():05d}.warc.gz"
        draft = f"{name}.{context.taskAttemptId()}"
        records, skip, pack = 0, True, None
        with store.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    row, number = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    if number < 0:
                        if pack:
                            out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                        page, link, size, digest, kind, refers, refers_row = (batch.column(k)[i].as_py() for k in range(3, 10))
                        pack, skip, records = zlib.compressobj(6, zlib.DEFLATED, 31), kind == "revisit", records + 1
                        out.write(pack.compress(_head(page, row, size, digest, kind, refers, refers_row, link)))
                    elif not skip:
                        out.write(pack.compress(memoryview(batch.column(2)[i].as_buffer())))
            if pack:
                out.write(pack.compress(b"\r\n\r\n") + pack.flush())
        store.move(draft, name)
        yield pa.RecordBatch.from_pydict({"archive": [f"{path}/{name.rsplit('/', 1)[-1]}"], "records": pa.array([records], pa.int64())})

    ordered = heads.unionByName(body).repartition(n, F.xxhash64("row_id")).sortWithinPartitions("row_id", "chunk_no")
    return materialize(ordered.mapInArrow(stream, "archive string, records long"), "warc-archives")


class _Stream:
    """Bytes of a gzip file of many members, in pieces of bounded size."""

    def __init__(self, file):
        self.file, self.unpack, self.raw, self.buffer = file, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        """Add at most ``CHUNK`` bytes to the buffer; False at the end."""
        while True:
            self.raw = self.raw or self.file.read(1 << 18)
            if not self.raw:
                return False
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            found = self.unpack.decompress(self.raw, CHUNK)
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if found:
                self.buffer += found
                return True

    def head(self) -> list[str] | None:
        """The lines up to an empty line, None at the end of the file."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.buffer.strip(b"\r\n"):
                    raise ValueError("archive ends inside a header")
                return None
        text, self.buffer = self.buffer[:at], self.buffer[at + 4:]
        return text.decode("utf-8").split("\r\n")

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.buffer and not self.more():
                raise ValueError("archive ends inside a record")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


READ = ("record_id string, page_id long, url string, chunk_no long, data binary, last boolean, payload_bytes long, "
        "payload_digest string, record_type string, refers_to long")
_READ_ROWS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("last", pa.bool_()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_chunks(archives: DataFrame, data: bool = True) -> DataFrame:
    """Chunk rows of all records in ``archives`` (column archive), see ``READ``.

    A payload's length and SHA-1 are counted along its chunks; the last row of
    a record has both. A digest that differs from the header's fails the job.
    A revisit has one row with its header's length and digest and no data.
    Without ``data`` only last rows come back.
    """

    def records(location: str) -> Iterator[tuple]:
        store, name = fs.FileSystem.from_uri(location)
        with store.open_input_stream(name, compression=None) as file:
            stream = _Stream(file)
            while (lines := stream.head()) is not None:
                f = _fields([x for x in lines if x])
                kind, length = f["warc-type"], int(f["content-length"])
                stated = f["warc-payload-digest"].removeprefix("sha1:")
                http = stream.head()
                size = int(_fields(http)["content-length"])
                rest = length - sum(len(x.encode()) + 2 for x in http) - 2
                same = (f["warc-record-id"], int(f["x-page-id"]) if "x-page-id" in f else None, f.get("warc-target-uri"))
                ends = (kind, int(f["x-refers-to-page-id"]) if "x-refers-to-page-id" in f else None)
                if kind == "revisit":
                    yield (*same, 0, None, True, size, stated, *ends)
                else:
                    digest, done, n = hashlib.sha1(), 0, 0
                    for part in stream.take(rest):
                        digest.update(part)
                        done += len(part)
                        if data or done == rest:
                            yield (*same, n, part if data else None, done == rest, done, b32(digest) if done == rest else None, *ends)
                        n += 1
                    if not rest:
                        yield (*same, 0, b"" if data else None, True, 0, b32(digest), *ends)
                    if b32(digest) != stated:
                        raise ValueError(f"payload of {same[0]} in {location} does not match its digest")
                if b"".join(stream.take(4)) != b"\r\n\r\n":
                    raise ValueError(f"record {same[0]} in {location} does not end where its length says")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for location in batch.column(0).to_pylist():
                for row in records(location):
                    out.append(row)
                    held += len(row[4] or b"") + 300
                    if held >= _FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _READ_ROWS)], schema=_READ_ROWS)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _READ_ROWS)], schema=_READ_ROWS)

    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("archive").repartition(n, "archive").mapInArrow(scan, READ)


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` and read the archives back: one row per record, see ``READ`` (without data)."""
    path = path or shared_path(pages.sparkSession, "warc")
    return read_chunks(write(pages, path, **options), data=False)
