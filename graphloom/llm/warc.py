"""WARC archives and their chunked record table.

`write` puts one record per page into gzipped WARC files, a member for each
record; `read` streams the files back as rows (record, chunk number, bytes),
each with the number of bytes and the SHA-1 of the payload so far.  Neither side
holds more than a chunk of a record beside the cell that Spark itself hands over.

Equal payloads of at least `min_bytes` bytes are stored once: the record with the
smallest page_id is a response, the others are revisits, which keep their HTTP
headers (so the payload's length) and the payload's digest, but not the payload.

Defined cases: null html is the empty payload; a null page_id comes after every
other and is written without an id; rows that repeat the smallest page_id of
their payload are all responses; null urls are written as about:blank; an
empty table gives an empty archive.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, small_enough

CHUNK = 1 << 20
RECORDS = "page_id long, url string, record_type string, refers_to long, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, payload_bytes long, payload_digest string, last boolean"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five bytes at a time are eight digits."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_verdicts(pages: DataFrame, min_bytes: int = 0, broadcast_groups: int = 100_000, salts: int = 32) -> DataFrame:
    """page_id, url, payload, digest and first (the smallest page_id of the payload where it is shared)."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    shared = rows.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1").drop("n")
    shared = cut(shared)
    if small_enough(shared, broadcast_groups):
        return rows.join(F.broadcast(shared), "digest", "left")
    spread = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(spread, ["digest", "salt"], "left").drop("salt")


def _record(row: dict, payload: memoryview) -> Iterator[bytes]:
    revisit = row["first"] is not None and row["first"] != row["page_id"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "about:blank")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{row['page_id']} {url} {row['digest']}")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{row['digest']}"]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {row['first']}"]
    body = 0 if revisit else len(payload)
    head.append(f"Content-Length: {len(http) + body}")
    yield "\r\n".join(head).encode() + b"\r\n\r\n" + http
    for i in range(0, body, CHUNK):
        yield payload[i : i + CHUNK]
    yield b"\r\n\r\n"


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives; the (path, records) of each file.  A file has the name of its partition and is moved
    into place when it is whole, so a task that runs again leaves the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        store.create_dir(at, recursive=True)
        path = f"{at}/part-{task.partitionId():06d}.warc.gz"
        part, n = f"{at}/.{task.taskAttemptId()}-{os.path.basename(path)}", 0
        with store.open_output_stream(part, compression=None) as f:
            for b in batches:
                payloads, rows = b.column("payload"), b.drop_columns("payload").to_pylist()
                for k, row in enumerate(rows):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    for piece in _record(row, memoryview(payloads[k].as_buffer())):
                        f.write(z.compress(piece))
                    f.write(z.flush())
                n += len(rows)
        store.move(part, path)
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return with_verdicts(pages, min_bytes).select("page_id", "url", "first", "digest", "payload").mapInArrow(run, "path string, records long")


class _Member:
    """The plain bytes of the gzip members of a file, one member at a time."""

    def __init__(self, f) -> None:
        self.f, self.rest, self.have = f, b"", bytearray()

    def begin(self) -> bool:
        self.z, self.have = zlib.decompressobj(31), bytearray()
        self.rest = self.rest or self.f.read(CHUNK)
        return bool(self.rest)

    def _more(self) -> bool:
        if self.z.eof:
            return False
        if not self.rest:
            self.rest = self.f.read(CHUNK)
            if not self.rest:
                raise EOFError("the archive ends within a record")
        self.have += self.z.decompress(self.rest, CHUNK)
        self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def head(self) -> list[str]:
        while (end := self.have.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise ValueError("a header without an end")
        lines = self.have[:end].decode().split("\r\n")
        del self.have[: end + 4]
        return lines

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self._more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        return out

    def end(self) -> None:
        while self._more():
            self.have.clear()


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def chunks(f, keep_payload: bool = True) -> Iterator[dict]:
    """The rows of one archive."""
    m = _Member(f)
    while m.begin():
        lines = m.head()
        w, size = _fields(lines), 0
        first = m.head()
        h = _fields(first)
        size = int(w["content-length"]) - len("\r\n".join(first).encode()) - 4
        told = w["warc-payload-digest"].removeprefix("sha1:")
        row = {"page_id": int(w["x-page-id"]) if "x-page-id" in w else None, "url": w["warc-target-uri"], "record_type": w["warc-type"], "refers_to": int(w["x-refers-to-page-id"]) if "x-refers-to-page-id" in w else None, "payload_bytes": int(h["content-length"]), "payload_digest": told}
        sha, done, k = hashlib.sha1(), 0, 0
        while True:
            piece = m.take(min(CHUNK, size - done))
            if len(piece) < min(CHUNK, size - done):
                raise EOFError("a payload is cut short")
            sha.update(piece)
            done += len(piece)
            digest = base64.b32encode(sha.digest()).decode()
            if done == size and row["record_type"] == "response" and digest != told:
                raise ValueError(f"the payload of page {row['page_id']} has changed")
            yield row | {"chunk_no": k, "chunk": piece if keep_payload else None, "bytes_so_far": done, "digest_so_far": digest, "last": done == size}
            k += 1
            if done == size:
                break
        m.end()


def read(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """The chunked record table of the archives in folder (columns RECORDS)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(store.from_uri(path)[1] if "://" in path else re.sub(r"^file:", "", path), compression=None) as f:
                    for row in chunks(f, keep_payload):
                        rows.append(row)
                        held += len(row["chunk"] or b"") + 200
                        if held > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    n = max(1, spark.sparkContext.defaultParallelism)
    return found.repartition(4 * n).mapInArrow(run, RECORDS)
