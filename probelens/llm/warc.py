"""Web archives through a chunked record table.

A payload is rows of (record, chunk number, bytes), each with the size and SHA-256 of the payload so far, so no row and
no buffer is larger than a chunk. The last chunk of a record tells its digest; records with equal digests are found by
a grouped minimum over these small rows. The writer streams chunks, sorted by record, into gzip members of archives in
the shared folder and returns a manifest; the reader streams archives back into the same kind of rows.

A task that runs again writes to files of new names, and only files in the manifest are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.llm.store import new_dir, small_batches, written

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 30
#: Smaller payloads are always stored.
LEAST_REVISITED = 100

CHUNKS = "record BIGINT, page_id BIGINT, url STRING, chunk INT, data BINARY, bytes BIGINT, digest STRING, total BIGINT, last BOOLEAN"
_CHUNKS_ARROW = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()),
                           ("bytes", pa.int64()), ("digest", pa.string()), ("total", pa.int64()), ("last", pa.bool_())])


def chunk_table(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """Payloads (text as UTF-8, null as empty) in chunks; an empty one has one chunk without bytes. Without `data`
    only the last chunk's row of each record comes, and no bytes."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("payload"), "").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            buffer, out, held = memoryview(texts.buffers()[2] or b""), [], 0
            for i, (record, page, address) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("record", "page_id", "url")))):
                low, high, sha = int(offsets[i]), int(offsets[i + 1]), hashlib.sha256()
                for number, at in enumerate(range(low, max(high, low + 1), chunk_bytes)):
                    to = min(at + chunk_bytes, high)
                    sha.update(buffer[at:to])
                    if data or to == high:
                        out.append((record, page, address, number, bytes(buffer[at:to]) if data else None, to - low, sha.hexdigest(), high - low, to == high))
                        held += to - at if data else 0
                    if held > 8 << 20:
                        yield _batch(out)
                        out, held = [], 0
            if out:
                yield _batch(out)

    return rows.mapInArrow(run, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNKS_ARROW)], schema=_CHUNKS_ARROW)


def with_originals(chunks: DataFrame, lasts: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """Chunks with what their record needs in its header: its full digest, and the smallest id of a record with
    the same payload, if the payload has `least` bytes and that id is not its own."""
    small = lasts.select("record", "page_id", "digest", "total")
    first = small.where(F.col("total") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    known = small.join(first, "digest", "left").select("record", F.col("digest").alias("full"), F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))
    return chunks.join(known, "record")


# WARC records


def _name(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}/{digest}')}>"


def header(chunk: dict, date: str) -> bytes:
    """Headers of a record: WARC's, and the HTTP response's that come before the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {chunk['total']}\r\n\r\n".encode()
    revisit = chunk["refers_to"] is not None
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(chunk['page_id'], chunk['full'])}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(chunk['url'] or '', safe=':/?#[]@!$&()*+,;=%~')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{chunk['full']}", f"Content-Length: {len(http) + (0 if revisit else chunk['total'])}",
    ]
    if chunk["page_id"] is not None:
        lines.append(f"X-Page-ID: {chunk['page_id']}")
    if revisit:
        lines += [f"WARC-Refers-To: {_name(chunk['refers_to'], chunk['full'])}", f"X-Refers-To-Page-ID: {chunk['refers_to']}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


class ArchiveWriter:
    """Archives of one task, each of about `most` bytes; a record is a gzip member."""

    def __init__(self, folder: str, most: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.most, self.out, self.done = most, None, []
        self.files.create_dir(self.folder)

    def begin(self, head: bytes) -> None:
        if self.out is None:
            self.path = f"{self.folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
            self.out, self.written, self.records = self.files.open_output_stream(self.path, compression=None), 0, 0
        self.packer = zlib.compressobj(wbits=31)
        self.records += 1
        self.add(head)

    def add(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.written += self.out.write(packed) if packed else 0

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self.written += self.out.write(self.packer.flush())
        if self.written >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.records, self.written))
            self.out = None


MANIFEST = "path STRING, records BIGINT, bytes BIGINT"


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST_REVISITED, date: str | None = None) -> DataFrame:
    """Write a record for every row into archives below `folder` (a place that all tasks can write to); the
    manifest of archives.

    Of rows with equal payloads of at least `least` bytes the one with the smallest id is a response, others
    revisit it without payload; rows that repeat that id are responses too. Null payloads are empty, null ids come
    back as null. No rows give no archives. Other columns are ignored.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    args = (page_id, url, payload, chunk_bytes)
    ready = with_originals(chunk_table(pages, *args), chunk_table(pages, *args, data=False), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, archive_bytes)
        for batch in batches:
            for chunk in batch.to_pylist():
                if chunk["chunk"] == 0:
                    writer.begin(header(chunk, date))
                if chunk["refers_to"] is None:
                    writer.add(chunk["data"])
                if chunk["last"]:
                    writer.end()
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*writer.done)], names=["path", "records", "bytes"])

    return written(ready.sortWithinPartitions("record", "chunk").mapInArrow(run, MANIFEST), "manifest")


class ArchiveReader:
    """The unpacked bytes of an archive as a stream with little memory."""

    def __init__(self, stream, block: int = 1 << 18):
        self.stream, self.block, self.buffer, self.rest = stream, block, bytearray(), b""
        self.unpacker = zlib.decompressobj(wbits=31)

    def more(self) -> bool:
        while True:
            if self.unpacker.eof:
                self.rest, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(wbits=31)
            data = self.unpacker.unconsumed_tail or self.rest or self.stream.read(self.block)
            self.rest = b""
            if not data:
                return False
            if unpacked := self.unpacker.decompress(data, self.block):
                self.buffer += unpacked
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to a mark, which is dropped; None at the end."""
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("an archive ends inside a record")
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.buffer and not self.more():
                raise ValueError("an archive ends inside a record")
            piece = bytes(self.buffer[:n])
            del self.buffer[: len(piece)]
            n -= len(piece)
            yield piece


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, v in pairs}


def records_of(reader: ArchiveReader, chunk_bytes: int) -> Iterator[dict]:
    """Chunks of every record: of a response with its bytes, of a revisit one without."""
    while (head := reader.until(b"\r\n\r\n")) is not None:
        warc = _fields(head.lstrip())
        http_lines = reader.until(b"\r\n\r\n")
        total = int(_fields(http_lines)["content-length"])
        page, refers = warc.get("x-page-id"), warc.get("x-refers-to-page-id")
        record = {"page_id": None if page is None else int(page), "url": warc["warc-target-uri"], "record_type": warc["warc-type"], "refers_to": None if refers is None else int(refers), "total": total}
        stated = warc["warc-payload-digest"].removeprefix("sha256:")
        if warc["warc-type"] == "revisit":
            yield record | {"chunk": 0, "data": None, "bytes": total, "digest": stated, "last": True}
        else:
            if int(warc["content-length"]) != len(http_lines) + 4 + total:
                raise ValueError("a record's lengths disagree")
            sha, data, done, number = hashlib.sha256(), bytearray(), 0, 0
            for piece in reader.take(total):
                data += piece
                while len(data) > chunk_bytes:
                    sha.update(some := bytes(data[:chunk_bytes]))
                    done += chunk_bytes
                    yield record | {"chunk": number, "data": some, "bytes": done, "digest": sha.hexdigest(), "last": False}
                    del data[:chunk_bytes]
                    number += 1
            sha.update(data)
            if sha.hexdigest() != stated:
                raise ValueError("a payload differs from its digest")
            yield record | {"chunk": number, "data": bytes(data), "bytes": total, "digest": stated, "last": True}
        reader.until(b"\r\n\r\n")


READ = "page_id BIGINT, url STRING, record_type STRING, refers_to BIGINT, total BIGINT, chunk INT, data BINARY, bytes BIGINT, digest STRING, last BOOLEAN"
_READ_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("total", pa.int64()),
                         ("chunk", pa.int32()), ("data", pa.binary()), ("bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())])


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """Chunks of all records of the archives in a manifest, checked against lengths and digests while they stream by.
    Without `data`, the last chunk of each record alone, without its bytes."""
    archives = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with files.open_input_stream(place, compression=None) as stream:
                    for chunk in records_of(ArchiveReader(stream), chunk_bytes):
                        if data:
                            held += len(chunk["data"] or b"")
                        elif chunk["last"]:
                            chunk["data"] = None
                        else:
                            continue
                        rows.append(chunk)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)

    return manifest.select("path").repartition(max(archives, 1)).mapInArrow(run, READ)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_dir(spark, "warc"))
    found = read_archives(manifest, data=False)
    return found.select("page_id", F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {LEAST_REVISITED} GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
