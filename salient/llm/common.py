"""Helpers shared by the text operators: shared-folder files and vectorised word hashing."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salient.session import ensure_checkpoint_dir, scratch_path, ship_package

_U = np.uint64


#: Batches between Spark and its Python workers: texts can be long, and every stage of buffers and arrays
#: multiplies a batch's bytes.  Each is set where the session has no value of its own.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8388608b", "spark.sql.execution.arrow.maxRecordsPerBatch": "2500"}


def prepare(spark: SparkSession) -> None:
    """Shared folder registered, the package shipped to the Python workers, and batches of texts kept small."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    for key, value in BATCHES.items():
        if not spark.conf._jconf.contains(key):
            spark.conf.set(key, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    The written copy survives the loss of executors and is read by every later
    step instead of being recomputed.
    """
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder in the shared storage (any scheme pyarrow knows, or a plain path)."""
    if "://" in uri or uri.startswith("file:"):
        uri = "file://" + uri[5:] if uri.startswith("file:") and not uri.startswith("file://") else uri
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id written as text, modulo ``k`` (null for a null id)."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % k


def row_key() -> list[Column]:
    """Two hashes of ``doc_id`` and ``text`` that stand for a document row (rows equal in both are one)."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id").alias("k2")]


def with_row(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """Schema of a function's rows: the struct column ``row`` of ``df``, whatever its fields are called, and the new ``fields`` (name, type)."""
    new = [T.StructField(name, T.StructType.fromDDL(f"x {kind}")["x"].dataType) for name, kind in fields]
    return T.StructType([T.StructField("row", df.schema["row"].dataType), *new])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# ---------------------------------------------------------------------------
# ranges of ids

ROW = 64


def range_starts(df: DataFrame, key: str, weight: Column, target: int = 8 << 20) -> list[int]:
    """First keys of consecutive ranges of about ``target`` bytes each, every one an existing key.

    Only keys and weights are read; a row weighs ``ROW`` bytes besides, so that
    rows without text count too.  The driver gets one row for each fine
    range (four to a final range, at most 2^20).
    """
    weight = weight + F.lit(ROW)
    total = df.agg(F.sum(weight), F.count(key)).first()
    if not total[1]:
        return [-(1 << 63)]
    cells = int(min(1 << 20, max(1, 4 * total[0] // target)))
    probs = [i / cells for i in range(1, cells)]
    cuts = sorted(set(df.agg(F.percentile_approx(key, probs, 10 * cells + 100)).first()[0])) if probs else []
    fine = (df.where(F.col(key).isNotNull()).groupBy(bucket_of(F.col(key), [-(1 << 63), *cuts]).alias("c"))
            .agg(F.min(key).alias("lo"), F.sum(weight).alias("w")).orderBy("c").collect())
    starts, filled = [], None
    for r in fine:
        if filled is None or filled + (r["w"] or 0) > target:
            starts.append(r["lo"])
            filled = 0
        filled += r["w"] or 0
    starts[0] = -(1 << 63)
    return starts


def bucket_of(key: Column, starts: list[int]) -> Column:
    """Index of the last start not above the key (null keys in the first range)."""
    spots = F.array(*[F.lit(int(s)) for s in starts]) if len(starts) <= 64 else None
    if spots is not None:
        return F.greatest(F.size(F.filter(spots, lambda s: s <= key)) - 1, F.lit(0))

    @F.pandas_udf("int")
    def find(k):
        found = np.searchsorted(np.asarray(starts, np.int64), k.fillna(-(1 << 63)).to_numpy(np.int64), "right") - 1
        return pd.Series(np.maximum(found, 0).astype("int32"))

    return find(key)


# ---------------------------------------------------------------------------
# word hashing

#: ASCII white space that separates words: space and 0x09-0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_SEGMENT = 1 << 20
#: Words beyond this many bytes are hashed by a digest of their own.
_LONG_WORD = 1 << 12
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], _U)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def _eights(data: np.ndarray) -> np.ndarray:
    """Row i: the eight bytes from place i on (zeros behind the end), as a view."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1), writeable=False)


def _eight_at(eights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each run as a number, the bytes behind the run's end being zero."""
    return eights[at].view("<u8").ravel().astype(_U, copy=False) & _FIRST_BYTES[np.minimum(left, 8)]


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``, eight bytes a step, each step through a non-linear mixer.

    Runs of one length up to eight bytes never collide.
    """
    eights, size = _eights(data), (end - start).astype(np.int64)
    h = mix(_eight_at(eights, start, size) ^ (size.astype(_U) * _U(0x9E3779B97F4A7C15)))
    rows, k = np.flatnonzero((size > 8) & (size <= _LONG_WORD)), 8
    while len(rows):
        h[rows] = mix((h[rows] * _U(0xD6E8FEB86659FD93) + _U(k)) ^ _eight_at(eights, start[rows] + k, size[rows] - k))
        k += 8
        rows = rows[size[rows] > k]
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] = np.frombuffer(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return h


def differ(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Where ``data[start:end]`` is not byte for byte ``other[start2:end2]``."""
    size = end - start
    out = size != end2 - start2
    one, two = _eights(data), _eights(other)
    rows, k = np.flatnonzero(~out & (size > 0) & (size <= _LONG_WORD)), 0
    while len(rows):
        left = size[rows] - k
        out[rows] |= _eight_at(one, start[rows] + k, left) != _eight_at(two, start2[rows] + k, left)
        k += 8
        rows = rows[size[rows] > k]
    for i in np.flatnonzero(~out & (size > _LONG_WORD)):
        out[i] = not np.array_equal(data[start[i]:end[i]], other[start2[i]:end2[i]])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several documents and each document's range of them.

    ``data`` holds the documents' UTF-8 bytes one after the other, document i
    being ``data[offsets[i]:offsets[i + 1]]``.  Words are runs of bytes outside
    0x20 and 0x09-0x0D, with A-Z lower-cased.  Returns (hashes, bounds): the
    words of document i are ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    hashes, start, _ = _runs(data, offsets, _SPACE, True)
    return hashes, np.searchsorted(start, offsets)


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes between single spaces and line feeds, each with the one before it.

    Returns (hashes, starts, ends, bounds).  A run takes the space or line feed
    before it; its hash tells the three cases (space, line feed, start of the
    document) apart.  Bytes are told apart by case.
    """
    hashes, start, end = _runs(data, offsets, _GAP, False)
    bounds = np.searchsorted(start, offsets)
    lead = np.zeros(len(start), np.uint64)
    inner = np.ones(len(start), bool)
    at = bounds[:-1][np.diff(bounds) > 0]
    inner[at] = start[at] > offsets[:-1][np.diff(bounds) > 0]
    before = start[inner] - 1
    lead[inner] = data[before]
    return mix(hashes + lead * _U(0xA24BAED4963EE407)), start - inner, end, bounds


def _runs(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the runs of bytes outside ``gap``, which never cross a document's border; ``lower``: A-Z count as a-z."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    hashes, starts, ends = [], [], []
    at = lo
    while at < hi:
        end = min(at + _SEGMENT, hi)
        if end < hi:  # cut between runs
            stop = end
            while stop < hi:
                part = gap[data[stop:stop + 4096]]
                nxt = int(offsets[np.searchsorted(offsets, stop)])
                cut = stop + int(part.argmax()) if part.any() else hi
                if min(cut, nxt) <= stop + len(part):
                    stop = min(cut, nxt)
                    break
                stop += len(part)
            end = min(stop, hi)
        seg = data[at:end]
        word = ~gap[seg]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        a, b = np.searchsorted(offsets, (at, end))
        cuts = offsets[a:b] - at  # a document's first byte starts a run
        begin[cuts[word[cuts]]] = True
        first = np.flatnonzero(begin)
        if len(first):
            starts.append(first + at)
            last = word.copy()
            last[:-1] &= ~word[1:]
            last[cuts[cuts > 0] - 1] |= word[cuts[cuts > 0] - 1]
            stop = np.flatnonzero(last) + 1
            ends.append(stop + at)
            hashes.append(hash_runs(_LOWER[seg] if lower else seg, first, stop))
        at = end
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets without a copy (nulls count as empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, buf = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, offsets


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a document's ``n``-word shingles.

    With fewer than ``n`` words the whole sequence is one shingle; without
    words there is none.
    """
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, _U)
    for i in range(n):
        h = h * _U(0xA24BAED4963EE407) + words[i:len(words) - n + 1 + i]
    return np.unique(mix(h + _U(n)))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of consecutive ranges laid one after the other."""
    total = int(lengths.sum())
    shift = np.cumsum(lengths) - lengths
    return np.repeat(starts - shift, lengths) + np.arange(total)


class StretchCache:
    """Numbers made once for each distinct stretch of many texts, in sorted arrays.

    ``make(text)`` gives a stretch's 32-bit numbers as one byte string for each
    of ``columns`` columns, all of one length.  Entries are found by a 64-bit hash
    and used only where the stretch's bytes are the entry's; a stretch whose hash
    another one has is put under a digest instead.  About 60 bytes an entry and
    column; at ``limit`` entries the cache starts anew.
    """

    def __init__(self, make, columns: int = 1, limit: int = 1_500_000):
        self.make, self.columns, self.limit = make, columns, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.store = [np.zeros(0, np.uint32) for _ in range(self.columns)]
        self.bytes, self.at, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _checked(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(distinct keys, first place of each, key of each stretch): equal keys stand for equal bytes, in the cache too."""
        salt = 0
        while True:
            distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
            odd = differ(data, starts, ends, data, starts[first][place], ends[first][place])
            spot = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
            if len(self.keys):
                held = np.flatnonzero(self.keys[spot] == distinct)
                at = self.at[spot[held]]
                wrong = differ(data, starts[first[held]], ends[first[held]], self.bytes, at, at + self.length[spot[held]])
                bad = np.zeros(len(distinct), bool)
                bad[held[wrong]] = True
                odd |= bad[place]
            again = np.flatnonzero(odd)
            if not len(again):
                return distinct, first, place
            salt += 1
            hashes = hashes.copy()
            for i in again.tolist():
                digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest()
                hashes[i] = np.frombuffer(digest, "<u8")[0]

    def numbers(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(the numbers of all stretches one after the other, by column; how many each stretch has)."""
        if len(self.keys) > self.limit:
            self._clear()
        distinct, first, place = self._checked(data, hashes, starts, ends)
        spot = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = spot < len(self.keys)
        new[inside] = self.keys[spot[inside]] != distinct[inside]
        new = np.flatnonzero(new)
        if len(new):
            a, b = starts[first[new]], ends[first[new]]
            made = [self.make(data[x:y].tobytes().decode()) for x, y in zip(a.tolist(), b.tolist())]
            size = np.fromiter((len(m[0]) for m in made), np.int64, len(made)) // 4
            self.start = np.insert(self.start, spot[new], len(self.store[0]) + np.cumsum(size) - size)
            self.size = np.insert(self.size, spot[new], size)
            self.at = np.insert(self.at, spot[new], len(self.bytes) + np.cumsum(b - a) - (b - a))
            self.length = np.insert(self.length, spot[new], b - a)
            self.keys = np.insert(self.keys, spot[new], distinct[new])
            self.bytes = np.concatenate([self.bytes, data[ragged(a, b - a)]])
            self.store = [np.concatenate([old, np.frombuffer(b"".join([m[i] for m in made]), np.uint32)]) for i, old in enumerate(self.store)]
            spot = np.searchsorted(self.keys, distinct)
        length = self.size[spot][place].astype(np.int64)
        at = ragged(self.start[spot][place], length)
        return [s[at] for s in self.store], length


def is_plain(data: np.ndarray, offsets: np.ndarray, latin: bool) -> np.ndarray:
    """Documents whose only white space is single spaces and line feeds within the text.

    Documents with other control characters, no-break spaces or (with ``latin``)
    characters beyond U+024F are not plain.  Empty ones are not either.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    seg = data[lo:hi]
    gap = _GAP[seg]
    bad = _CONTROL[seg]
    bad[1:] |= gap[1:] & gap[:-1]
    second = seg[1:]
    bad[1:] |= (seg[:-1] == 0xC2) & (second <= 0xA0)
    if latin:
        bad |= seg >= 0xC9
    else:
        bad |= seg >= 0xE0  # may be a space of another script, or the space mark itself
    counts = np.concatenate([[0], np.cumsum(bad)])
    o = offsets - lo
    plain = (counts[o[1:]] == counts[o[:-1]]) & (o[1:] > o[:-1])
    some = np.flatnonzero(plain)
    plain[some] &= ~gap[o[:-1][some]] & ~gap[o[1:][some] - 1]
    return plain


_CONTROL = np.zeros(256, bool)
_CONTROL[[*range(0x00, 0x0A), *range(0x0B, 0x20), 0x7F]] = True
