"""Token ids in bit-plane or byte-plane files with a chunk index.

Documents are encoded with a byte-level BPE vocabulary and their ids written in
ascending document order, one file for each range of ids.  A file holds blocks
of a fixed number of ids; each block is transposed into planes (all lowest
bytes, then the next ..., or all lowest bits, ...), each plane compressed with
zstandard on its own, all-zero planes taking no space.  The index at the end of
the file gives each block's place and each document's range of ids, so that a
reader fetches only the blocks it needs.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.llm.common import (StretchCache, arrow_bytes, bucket_of, filesystem, is_plain, prepare, range_starts,
                                stretches, text_or_empty)
from salient.session import scratch_path

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
#: Text bytes of a file.
FILE_BYTES = 16 << 20
#: Words whose ids an encoder keeps before it starts anew.
CACHE = 200_000
#: Text bytes worked on at once.
PART_BYTES = 2 << 20


# ---------------------------------------------------------------------------
# the format

def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """A block's planes, lowest first; each is empty if all zero."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = []
    for byte in range(4):
        column = np.ascontiguousarray(raw[:, byte])
        for plane in ([column] if mode == "byte" else [np.packbits((column >> bit) & 1) for bit in range(8)]):
            planes.append(plane.tobytes() if plane.any() else b"")
    return planes


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    """The ids of a block from its planes."""
    raw = np.zeros((n, 4), np.uint8)
    for i, plane in enumerate(planes):
        if plane:
            got = np.frombuffer(plane, np.uint8)
            if mode == "byte":
                raw[:, i] = got
            else:
                raw[:, i // 8] |= np.unpackbits(got, count=n) << np.uint8(i % 8)
    return raw.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes ids of documents one after the other, a block at a time."""

    def __init__(self, out, mode: str = "byte", block: int = BLOCK, level: int = 3):
        self.out, self.mode, self.block = out, mode, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.chunks: list[list] = []
        self.docs: list[list] = []
        self.at = out.write(MAGIC) or len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append([doc_id, self.total, len(ids)])
        self.total += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) - len(ids) % self.block
            for a in range(0, whole, self.block):
                self._flush(ids[a:a + self.block])
            self.waiting, self.held = [ids[whole:].copy()], len(ids) - whole

    def _flush(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) if p else b"" for p in to_planes(ids, self.mode)]
        self.chunks.append([self.at, len(ids), [len(p) for p in packed]])
        for p in packed:
            if p:
                self.out.write(p)
                self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._flush(np.concatenate(self.waiting))
        index = self.zip.compress(json.dumps({"mode": self.mode, "block": self.block, "chunks": self.chunks, "docs": self.docs}).encode())
        self.out.write(index)
        self.out.write(struct.pack("<QQ", self.at, len(index)) + MAGIC)


class PlaneReader:
    """Reads the index of a file, and blocks on demand."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        tail = file.read_at(16 + len(MAGIC), end - 16 - len(MAGIC))
        if tail[16:] != MAGIC:
            raise ValueError("not an id-plane file, or cut short")
        at, size = struct.unpack("<QQ", tail[:16])
        self.unzip = zstandard.ZstdDecompressor()
        index = json.loads(self.unzip.decompress(file.read_at(size, at)))
        self.mode, self.block, self.chunks, self.docs = index["mode"], index["block"], index["chunks"], index["docs"]
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def chunk(self, i: int) -> np.ndarray:
        """Ids of block ``i``."""
        if self.last[0] != i:
            at, n, sizes = self.chunks[i]
            data, planes, a = self.file.read_at(sum(sizes), at), [], 0
            for size in sizes:
                planes.append(self.unzip.decompress(data[a:a + size]) if size else b"")
                a += size
            self.last = (i, from_planes(planes, n, self.mode))
        return self.last[1]

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, in parts that lie in one block."""
        while n > 0:
            i, a = divmod(start, self.block)
            part = self.chunk(i)[a:a + n]
            yield part
            start, n = start + len(part), n - len(part)


# ---------------------------------------------------------------------------
# encoding

class ByteBpe:
    """The tokenizers library's ids of whole texts, with the ids of repeated stretches kept.

    Byte-level pre-tokenisation never joins what lies before a single space or
    line feed between two other characters with what follows.  Plain texts (see
    ``is_plain``: Latin letters, no other white space) are cut there, and the
    library's model encodes each distinct stretch once.  All other texts, texts
    that hold a special token's string, and all texts under another
    pre-tokeniser go to the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}  # bytes that stand for themselves
        self.table = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in keep)}
        self.words: dict[str, bytes] = {}
        self.kept = StretchCache(lambda text: (b"".join(map(self._word, self.split(text))),))

    def _library(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            plain = word.encode().decode("latin-1").translate(self.table)
            got = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = got
        return got

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column."""
        data, offsets = arrow_bytes(texts)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART_BYTES, "right")) - 1)
            yield from self._part(data, offsets[a:b + 1])
            a = b

    def _part(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        plain = is_plain(data, offsets, latin=True) & self.cuts
        if self.special:
            whole = data[offsets[0]:offsets[-1]].tobytes()
            if any(s in whole for s in self.special):
                for i in np.flatnonzero(plain):
                    if any(s in data[offsets[i]:offsets[i + 1]].tobytes() for s in self.special):
                        plain[i] = False
        hashes, starts, ends, bounds = stretches(data, offsets)
        use = np.repeat(plain, np.diff(bounds))
        (ids,), length = self.kept.numbers(data, hashes[use], starts[use], ends[use])
        stop = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(np.where(plain, np.diff(bounds), 0))])]
        for i in range(len(plain)):
            if plain[i]:
                yield ids[stop[i]:stop[i + 1]]
            else:
                yield self._library(data[offsets[i]:offsets[i + 1]].tobytes().decode())


_ENCODERS: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------------------
# the operators

def write_planes(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, mode: str = "byte") -> DataFrame:
    """Encode every text, append ``end_id`` and write the ids into ``folder``; returns the list of files.

    Files: (file int, path string, n_docs long, n_ids long), in ascending
    ``doc_id`` order by ``file`` and within a file (null ids first, equal ids by
    text; repeated rows are written as often as they occur).  Null texts count
    as empty: they have the end id alone.  An empty table has no file.  A task
    run again writes a file of a new name; only files in the list count.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    starts = range_starts(base, "doc_id", F.octet_length("text"), FILE_BYTES)
    dealt = (base.withColumn("b", bucket_of(F.col("doc_id"), starts).cast("int"))
             .repartitionById(len(starts), "b")
             .sortWithinPartitions("b", F.asc_nulls_first("doc_id"), "text"))
    end = np.asarray([end_id], np.uint32)

    def write(batches):
        enc = byte_bpe(tokenizer)
        fs, root = filesystem(folder)
        open_file = None
        for batch in batches:
            for doc_id, b, ids in zip(batch.column("doc_id").to_pylist(), batch.column("b").to_pylist(), enc.encode(batch.column("text"))):
                if open_file is None or open_file[0] != b:
                    if open_file is not None:
                        yield finish(open_file)
                    path = f"{root}/ids-{b:06d}-{uuid.uuid4().hex[:8]}.planes"
                    out = fs.open_output_stream(path)
                    open_file = (b, path, out, PlaneWriter(out, mode))
                open_file[3].add(doc_id, np.concatenate([ids, end]))
        if open_file is not None:
            yield finish(open_file)

    def finish(f):
        f[3].close()
        f[2].close()
        return pa.RecordBatch.from_arrays([pa.array([f[0]], pa.int32()), pa.array([f[1]], pa.string()), pa.array([len(f[3].docs)], pa.int64()), pa.array([f[3].total], pa.int64())],
                                          ["file", "path", "n_docs", "n_ids"])

    spark = docs.sparkSession
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    listed = f"{folder}/list"
    dealt.mapInArrow(write, "file int, path string, n_docs long, n_ids long").write.parquet(listed)
    return spark.read.schema("file int, path string, n_docs long, n_ids long").parquet(listed)


def read_planes(files: DataFrame, folder: str) -> DataFrame:
    """Each document's ids read from the files: (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before it; the files' totals (one
    number a file) are added up on the driver.  A document is read block by
    block.
    """
    spark = files.sparkSession
    sizes = sorted((r["file"], r["path"], r["n_ids"]) for r in files.select("file", "path", "n_ids").collect())
    rows, before = [], 0
    for _, path, n in sizes:
        rows.append((path, before))
        before += n
    todo = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)))

    def read(batches):
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                with fs.open_input_file(path) as f:
                    reader = PlaneReader(f)
                    crc = []
                    for _, start, n in reader.docs:
                        c = 0
                        for part in reader.pieces(start, n):
                            c = zlib.crc32(np.ascontiguousarray(part), c)
                        crc.append(c)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([d[0] for d in reader.docs], pa.int64()), pa.array([before + d[1] for d in reader.docs], pa.int64()),
                        pa.array([d[2] for d in reader.docs], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to byte-plane files and read back."""
    import public_tokenizers

    prepare(spark)
    folder = scratch_path(spark, "id-planes")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write_planes(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_planes(files, folder)
