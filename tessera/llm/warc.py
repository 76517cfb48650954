"""WARC archives: writing with revisit records, and a sequential reader.

Each record is one gzip member. The reader streams a file in chunks, inflates member by member with
incremental zlib, takes a record's block by its content length and verifies the block's and the
payload's SHA-256 on the way, so memory holds one chunk (and one payload, where payloads are asked for).
Archives live in the shared folder and are opened through pyarrow.fs, so any store it reaches will do.
Tasks write under names of their own attempt; only what a finished task reports is read.

Of equal payloads of at least ``least`` bytes the record with the smallest id is the response, the others
revisit it. Edge cases: a null payload is empty; a payload's bytes are kept as they are, valid UTF-8 or not; a null id is kept, and revisits if a numbered page has the
payload; rows that repeat the smallest id are responses each; extra columns are ignored; no rows give no rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import shared_dir, stash
from tessera.llm.tasks import lean

CHUNK = 1 << 16
ARCHIVE = 64 << 20  # uncompressed bytes after which a task begins a new file
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(page_id, url, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record, not compressed."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str):
    def run(batches):
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        out, number, size, count, paths = None, 0, 0, 0, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, number, size, count = store.open_output_stream(f"{base}/{name}", compression=None), number + 1, 0, 0
                raw = record(page_id, url, payload or b"", refers_to)
                gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                out.write(gz.compress(raw) + gz.flush())
                size, count = size + len(raw), count + 1
                if size >= ARCHIVE:
                    out.close()
                    paths.append((f"{folder}/{name}", count))
                    out = None
        if out is not None:
            out.close()
            paths.append((f"{folder}/{name}", count))
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in paths]), pa.array([n for _, n in paths], pa.int64())], ["path", "records"])

    return run


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """Writes one record a row; returns (path, records) of the archives."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark) + "-warc"
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.make_valid_utf8(F.col(url_col).cast("string")).alias("url"), F.col(payload_col).cast("string").cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    # who revisits whom is settled on ids and digests alone, so that payloads never meet by a digest that many share
    named = rows.where("digest is not null").select("page_id", "digest")
    dups = stash(named.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n"), "dups")
    again = stash(named.join(dups, "digest").where("page_id is null or page_id <> refers_to").distinct().withColumnRenamed("page_id", "again_id").withColumnRenamed("digest", "again_digest"), "again")
    told = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").select("page_id", "url", "payload", "refers_to")
    return stash(told.mapInArrow(lean(_write(folder)), "path string, records long"), "archives")


def _inflate(stream) -> Iterator[tuple[bytes, bool]]:
    """(bytes, end of member): an archive's content, never across a member's end."""
    inflater = zlib.decompressobj(31)
    while chunk := stream.read(CHUNK):
        while chunk:
            data = inflater.decompress(chunk, CHUNK)
            chunk = inflater.unconsumed_tail
            if inflater.eof:
                chunk = inflater.unused_data
                inflater = zlib.decompressobj(31)
                yield data, True
            elif data:
                yield data, False
    # a member that was cut off leaves the inflater inside its stream
    if inflater.flush():
        raise ValueError("the archive ends inside a gzip member")


def _fields(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


class Member:
    """One record as its bytes arrive: header, then the block by content length, then the end mark."""

    def __init__(self, keep_payload: bool):
        self.keep, self.head, self.fields, self.http, self.left, self.tail = keep_payload, b"", None, b"", 0, b""
        self.block, self.content, self.size, self.in_payload, self.parts = hashlib.sha256(), hashlib.sha256(), 0, False, []

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            head, mark, data = self.head.partition(b"\r\n\r\n")
            if not mark:
                return
            if not head.startswith(b"WARC/"):
                raise ValueError("no WARC record begins here")
            self.fields, self.head = _fields(head), b""
            self.left = int(self.fields["content-length"])
        body, rest = data[: self.left], data[self.left :]
        self.left -= len(body)
        self.tail += rest
        self.block.update(body)
        if not self.in_payload:
            self.http += body
            http, mark, body = self.http.partition(b"\r\n\r\n")
            if not mark:
                return
            self.http, self.in_payload = http, True
        self.content.update(body)
        self.size += len(body)
        if self.keep:
            self.parts.append(body)

    def close(self) -> tuple:
        if self.fields is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("a record's block and its content length differ")
        f = self.fields
        if f["warc-block-digest"] != f"sha256:{self.block.hexdigest()}":
            raise ValueError(f"block digest of {f['warc-record-id']} differs")
        kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha256:")
        full = int(_fields(self.http).get("content-length", self.size))
        if kind == "response" and (digest != self.content.hexdigest() or full != self.size):
            raise ValueError(f"payload digest of {f['warc-record-id']} differs")
        return _page(f["warc-record-id"]), f.get("warc-target-uri"), kind, _page(f.get("warc-refers-to")), full, digest, b"".join(self.parts) if self.keep and kind == "response" else None


def records(stream, keep_payload: bool = False) -> Iterator[tuple]:
    member = None
    for data, ends in _inflate(stream):
        member = member or Member(keep_payload)
        member.feed(data)
        if ends:
            yield member.close()
            member = None
    if member is not None:
        raise ValueError("the archive ends inside a record")


def _read(keep_payload: bool):
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORD.split(", ")]

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for r in records(stream, keep_payload):
                        rows.append(r)
                        held += len(r[6] or b"")
                        if len(rows) >= 5000 or held > 4 << 20:
                            yield emit(rows)
                            rows, held = [], 0
                if rows:
                    yield emit(rows)

    return run


def read_warc(spark: SparkSession, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in column ``path``, one task a few files."""
    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(lean(_read(payloads)), RECORD)
