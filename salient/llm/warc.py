"""WARC archives written and read as a chunked record table.

Records are written as one gzip member each.  Reading streams an archive's
records as rows of record id and chunk number with at most ``CHUNK`` bytes of
payload each; every row carries the digest and the length of the payload up to
its end, so neither a record nor its digest ever needs the whole payload in
memory.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.llm.common import filesystem, prepare
from salient.session import scratch_path

#: Payload bytes of a chunk row.
CHUNK = 256 << 10
#: Compressed bytes after which a writer begins the next archive.
ARCHIVE_BYTES = 128 << 20
DATE = "2000-01-01T00:00:00Z"

CHUNKS = ("page_id long, record_type string, refers_to long, url string, chunk int, offset long, data binary, "
          "digest_so_far string, bytes_so_far long, is_last boolean, payload_digest string, payload_bytes long")


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_head(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """Header of a record.  A revisit has no body; its full payload's length is in an extension field."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) for b in url.encode()).encode("latin-1").decode("utf-8"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>",
                  f"X-Payload-Length: {size}"]
    lines.append(f"Content-Length: {0 if kind == 'revisit' else size}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record_kinds(payloads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, resp) of the records that may revisit another one.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the
    largest ``page_id`` is the response.  Only ids and digests are shuffled;
    the many payloads seen once drop out before the join.
    """
    ids = payloads.where(F.col("size") >= min_bytes).select("page_id", "digest", "size")
    first = ids.groupBy("digest", "size").agg(F.max("page_id").alias("resp"), F.count("*").alias("n")).where("n > 1").drop("n")
    return ids.distinct().join(first, ["digest", "size"]).where("page_id < resp").select("page_id", "digest", "resp")


def write_archives(pages: DataFrame, folder: str, payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for every row; returns the list of archives (path string, n_records long).

    The payload is the column's text in UTF-8 (null: empty).  Rows equal in
    ``page_id`` and payload are one record written as often as they occur, all
    of one type.  A null id is never the record referred to unless all ids of
    that payload are null.  An empty table gives no archive.  A task run again
    writes a file of a new name; only files in the list count.
    """
    spark = pages.sparkSession
    prepare(spark)
    body = F.encode(F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    base = base.withColumn("digest", F.sha1("body")).withColumn("size", F.octet_length("body").cast("long"))
    kinds = record_kinds(base, min_bytes)
    rows = base.join(kinds.withColumnRenamed("digest", "d2").withColumnRenamed("page_id", "p2"),
                     (F.col("page_id") == F.col("p2")) & (F.col("digest") == F.col("d2")), "left").select("page_id", "url", "body", "resp")

    def write(batches):
        fs, root = filesystem(folder)
        out, path, n = None, None, 0
        for batch in batches:
            for page_id, url, data, resp in zip(*(batch.column(c) for c in ("page_id", "url", "body", "resp"))):
                if out is None:
                    path, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path)
                view = memoryview(data.as_buffer())
                digest = base32_sha1(hashlib.sha1(view).digest())
                resp = resp.as_py()
                kind = "response" if resp is None else "revisit"
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(member.compress(record_head(kind, page_id.as_py(), url.as_py(), digest, len(view), resp)))
                if resp is None:
                    for a in range(0, len(view), CHUNK):
                        out.write(member.compress(view[a:a + CHUNK]))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    yield listed(path, n)
                    out = None
        if out is not None:
            out.close()
            yield listed(path, n)

    def listed(path, n):
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows.mapInArrow(write, "path string, n_records long").write.parquet(f"{folder}/list")
    return spark.read.schema("path string, n_records long").parquet(f"{folder}/list")


class _Stream:
    """Decompressed bytes of an archive's members, read a little at a time."""

    def __init__(self, file, step: int = CHUNK):
        self.file, self.step = file, step
        self.zip = zlib.decompressobj(31)
        self.raw = b""
        self.ready = b""

    def more(self) -> bool:
        while True:
            if self.zip.eof:
                self.raw = self.zip.unused_data or self.raw
                self.zip = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(self.step)
                if not self.raw:
                    return False
            got = self.zip.decompress(self.raw, self.step)
            self.raw = self.zip.unconsumed_tail if not self.zip.eof else b""
            if got:
                self.ready += got
                return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.ready:
            if not self.more():
                return None
        line, _, self.ready = self.ready.partition(b"\r\n")
        return line

    def some(self, n: int) -> bytes:
        if not self.ready and not self.more():
            raise ValueError("archive cut short")
        got, self.ready = self.ready[:n], self.ready[n:]
        return got


def chunks_of(file) -> Iterator[tuple]:
    """Rows of ``CHUNKS`` of one archive, in order; a record without body has one row with empty data."""
    stream = _Stream(file)
    while True:
        line = stream.line()
        while line == b"":
            line = stream.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a record")
        head = {}
        while line := stream.line():
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode()
        ident = lambda v: int(v[10:-1]) if v and v[10:-1] else None
        kind, page_id, refers = head[b"warc-type"], ident(head.get(b"warc-record-id")), ident(head.get(b"warc-refers-to"))
        url, said = head.get(b"warc-target-uri"), head[b"warc-payload-digest"].removeprefix("sha1:")
        left, sha, at, n = int(head[b"content-length"]), hashlib.sha1(), 0, 0
        total = int(head.get(b"x-payload-length", left))
        while True:
            parts, got = [], 0
            while left and got < CHUNK:
                part = stream.some(min(left, CHUNK - got))
                parts.append(part)
                got += len(part)
                left -= len(part)
            data = b"".join(parts)
            sha.update(data)
            last = left == 0
            digest = base32_sha1(sha.copy().digest())
            if last and kind != "revisit" and digest != said:
                raise ValueError(f"payload of record {page_id} differs from its digest")
            yield page_id, kind, refers, url, n, at, data, digest, at + len(data), last, said, total
            at, n = at + len(data), n + 1
            if last:
                break


def read_chunks(archives: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """The archives' records as chunk rows (``CHUNKS``), a task for each archive; without data, ``data`` is null."""
    n = max(1, archives.count())

    def read(batches):
        fs, _ = filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("offset", pa.int64()),
                            ("data", pa.binary()), ("digest_so_far", pa.string()), ("bytes_so_far", pa.int64()), ("is_last", pa.bool_()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])

        def block(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_stream(path) as f:
                    rows, size = [], 0
                    for row in chunks_of(f):
                        size += len(row[6]) if with_data else 0
                        rows.append(row if with_data else (*row[:6], None, *row[7:]))
                        if size >= 4 << 20 or len(rows) >= 5000:
                            yield block(rows)
                            rows, size = [], 0
                    if rows:
                        yield block(rows)

    return archives.select("path").repartition(n).mapInArrow(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record from the chunk table: the last chunk carries the whole payload's length and digest."""
    body = F.col("record_type") != "revisit"
    return chunks.where("is_last").select(
        "page_id", F.when(body, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(body, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page written to archives and read back as chunks."""
    prepare(spark)
    folder = scratch_path(spark, "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return records(read_chunks(archives, folder, with_data=False))


# DuckDB has no base32: the SQL cuts the 32 five-bit groups of the digest out of its hex digits.
_GROUPS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {i * 5 // 4 + 1}, 2))::INT >> {3 - (i * 5) % 4}) & 31), 1)"
    for i in range(32))

OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) || '0' AS h FROM pages),
r AS (SELECT t, max(page_id) AS resp FROM p GROUP BY t)
SELECT p.page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, {_GROUPS} AS payload_digest,
       CASE WHEN p.page_id = r.resp THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = r.resp THEN NULL ELSE r.resp END AS refers_to
FROM p JOIN r USING (t)
"""
