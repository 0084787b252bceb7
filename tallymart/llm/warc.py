"""WARC archives through a chunked record table.

Both ways a record is rows of (record, chunk_no, data), chunks of at most ``chunk`` bytes: a payload of any size passes as
pieces, its SHA-1 carried along from piece to piece. Writing cuts payloads into chunk rows in the JVM and gives each task's
rows to a writer that holds one chunk; reading gives the chunk table (record_id, chunk_no, data, ...) of the archives.
Spark itself holds an html value whole, as every reader of a string column does; nothing after that does.

Archives are WARC/1.1, each record a gzip member of its own, packed and unpacked a chunk at a time. A payload equal to
that of a page with a larger id is written as a revisit record
(identical-payload-digest): the HTTP header with the payload's length, and the digest, but no payload. Equal payloads are
found on digests alone; the repeated ones are a table of their own, so that joining them back splits hot digests, and
where that table is small payloads aren't shuffled at all.

Files are opened with pyarrow's file systems on the executors, in the folder that all share. Each attempt of a task
writes files of its own names and returns an index row per file; only files in the committed index are read, so that a
lost executor leaves an unread file at worst. Reading deals the files over a task each.

Null html is an empty payload; null urls are written as urn:page:<id>. Rows with equal page_id and payload are alike:
both are the response, or both revisit it. A null page_id counts below any other and is kept; ids may be numbers or
strings. An empty table writes no archive and gives no rows. Signs that can't be encoded don't occur: Spark's strings
are UTF-8. Further columns of pages are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, small, table, written

CHUNK = 1 << 16
LEAST = 1000
ARCHIVE_BYTES = 64 << 20
INDEX = "path string, records long, bytes long"
RECORDS = "record_id string, page_id string, record_type string, refers_to string, chunk_no int, data binary, last boolean, payload_bytes long, payload_digest string"


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload binary, digest, record_type, refers_to."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    size = F.octet_length("payload")
    group = written(
        rows.filter(size >= least).select("digest", size.alias("n"), "page_id").groupBy("digest", "n")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
        .select(F.col("digest").alias("_digest"), F.col("n").alias("_n"), "first")
    )
    out = rows.join(group, (F.col("digest") == F.col("_digest")) & (size == F.col("_n")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select(
        "page_id", "url", "payload", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def in_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of with_revisits -> page_id, url, n, digest, record_type, refers_to, chunk_no, data: a record's chunks in order, one without
    data for revisits and empty payloads."""
    size = F.octet_length("payload")
    last = F.when(F.col("record_type") == "revisit", 0).otherwise(F.greatest(F.ceil(size / chunk) - 1, F.lit(0))).cast("int")
    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "url")]
    rows = records.select(*ids, "payload", size.alias("n"), "digest", "record_type", F.col("refers_to").cast("string").alias("refers_to"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    data = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})"))
    return rows.select("page_id", "url", "n", "digest", "record_type", "refers_to", "chunk_no", data.alias("data"))


def named(page_id: str | None) -> str:
    """An id as a header's value: null is empty, an id in quotes, percent-encoded."""
    return "" if page_id is None else f'"{quote(page_id, safe="")}"'


def unnamed(value: str) -> str | None:
    return unquote(value[1:-1]) if value else None


def record_head(page_id: str | None, url: str | None, n: int, digest: str, kind: str, refers_to: str | None) -> tuple[bytes, bytes]:
    """WARC and HTTP header of a record; the payload follows, but for revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    name = "".join(c for c in (url or f"urn:page:{page_id}") if c >= " ")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {name} {digest}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {name}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (n if kind == 'response' else 0)}",
        f"X-Page-ID: {named(page_id)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {named(refers_to)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Writes records (from with_revisits) as archives in the folder; the index of the archives, a written table."""

    def run(parts):
        fs, root = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(f"{root}/archives")
        out = path = member = sha = None
        done, records, size, left = [], 0, 0, 0

        def put(data) -> int:
            packed = member.compress(data)
            out.write(packed)
            return len(packed)

        for part in small(parts, 64):
            for page_id, url, n, digest, kind, refers_to, no, data in zip(*(part.column(i) for i in range(8))):
                if out is None:
                    path, records, size = f"archives/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{path}", compression=None)
                if not no.as_py():  # a record begins
                    left = n.as_py() if kind.as_py() == "response" else 0
                    member, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    for piece in record_head(page_id.as_py(), url.as_py(), n.as_py(), digest.as_py(), kind.as_py(), refers_to.as_py()):
                        size += put(piece)
                piece = data.as_buffer()
                sha.update(piece)
                size += put(piece)
                left -= piece.size
                if left > 0:
                    continue
                if kind.as_py() == "response" and sha.hexdigest() != digest.as_py():
                    raise ValueError(f"the chunks of page {page_id.as_py()} have another digest than its payload")
                size += put(b"\r\n\r\n")
                packed = member.flush()
                out.write(packed)
                size += len(packed)
                records += 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((path, records, size))
        if out is not None:
            out.close()
            done.append((path, records, size))
        columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["path", "records", "bytes"])

    return written(in_chunks(records, chunk).mapInArrow(run, INDEX), f"{folder}/index")


class Unpacked:
    """The bytes of gzip members in a row, read like a file."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk, self.rest, self.member = stream, chunk, b"", None

    def read(self, n: int) -> bytes:
        while True:
            data = self.rest or self.stream.read(self.chunk)
            if self.member is None:
                if not data:
                    return b""
                self.member = zlib.decompressobj(31)
            out = self.member.decompress(data, n)
            self.rest = self.member.unconsumed_tail
            if self.member.eof:
                self.rest, self.member = self.member.unused_data, None
            elif not data and not out:
                raise ValueError("the archive ends within a record")
            if out:
                return out


def chunks_of(stream, chunk: int = CHUNK):
    """Rows of RECORDS from an open archive, front to back, never holding more than a chunk and a header."""

    def header():
        fields = {}
        while line := read_line():
            if line == b"\r\n":
                break
            key, colon, value = line.decode("utf-8").partition(":")
            if colon:
                fields[key.strip().lower()] = value.strip()
        return fields

    rest = bytearray()

    def fill() -> bool:
        more = stream.read(chunk)
        rest.extend(more)
        return bool(more)

    def read_line() -> bytes:
        at = 0
        while (end := rest.find(b"\n", at)) < 0:
            at = len(rest)
            if not fill():
                break
        end = len(rest) if end < 0 else end + 1
        line = bytes(rest[:end])
        del rest[:end]
        return line

    def take(n: int) -> bytes:
        if not rest:
            fill()
        out = bytes(rest[: min(n, chunk)])
        del rest[: len(out)]
        return out

    while line := read_line():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = header()
        block = int(head["content-length"])
        before = len(rest)
        http_head = bytearray()
        while (line := read_line()) and line != b"\r\n":
            http_head += line
        block -= len(http_head) + 2
        full = int(next(x.split(b":")[1] for x in http_head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        ids = head["warc-record-id"], unnamed(head["x-page-id"]), head["warc-type"]
        told = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "revisit":
            yield *ids, unnamed(head["x-refers-to-page-id"]), 0, b"", True, full, told
            continue
        sha, left, no = hashlib.sha1(), block, 0
        while left or not no:
            data = take(left) if left else b""
            if left and not data:
                raise ValueError("the archive ends within a record")
            sha.update(data)
            left -= len(data)
            if not left and sha.hexdigest() != told:
                raise ValueError(f"the payload of {ids[0]} has another digest than its header")
            yield *ids, None, no, data, not left, full if not left else None, sha.hexdigest() if not left else None
            no += 1


def read(index: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives in the index, ids as strings."""

    def run(parts):
        fs, root = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.string()]
        names = [c.split(" ")[0] for c in RECORDS.split(", ")]
        for part in parts:
            for path in part.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for row in chunks_of(Unpacked(stream, chunk), chunk):
                        rows.append(row)
                        size += len(row[5])
                        if size >= 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    # A number of its own: without one, adaptive execution would put the few short rows of the index into one task.
    files = index.select("path").repartition(max(index.count(), 1))
    return files.mapInArrow(run, RECORDS)


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes pages as archives; their index and folder."""
    folder = folder or shared_folder(pages.sparkSession)
    return write(with_revisits(pages), folder), folder


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index, folder = archive(pages)
    kind = pages.schema["page_id"].dataType
    of_kind = lambda c: F.col(c).cast(kind).alias(c)
    return read(index, folder).filter("last").select(of_kind("page_id"), "payload_bytes", "payload_digest", "record_type", of_kind("refers_to"))


ORACLE = r"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, coalesce(strlen(html), 0)::BIGINT AS payload_bytes FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""
