"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint keeps the ``k`` smallest distinct 64-bit hashes of a text's
five-word shingles.  Sketches of parts merge into the sketch of the whole; two
sketches estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.llm.common import arrow_bytes, bucket_of, prepare, range_starts, shingle_hashes, text_or_empty, with_row, word_hashes

K = 64
#: Words of a part of a long text.
PART = 1 << 16
_TOP = float(1 << 64)


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest of sorted distinct hashes."""
    return shingles[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two parts."""
    return np.union1d(a, b)[:k]


def distinct_shingles(s: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles: exact below ``k``, else (k - 1) / the k-th smallest hash as a share."""
    return float(len(s)) if len(s) < k else (k - 1) * _TOP / (float(s[k - 1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: share of the union's sketch that both hold.  Two empty texts: 1."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has, from the resemblance and the counts.  An empty a: 1."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r / (1.0 + r) * (distinct_shingles(a, k) + distinct_shingles(b, k)) / distinct_shingles(a, k))


def pack(s: np.ndarray) -> str:
    """Fingerprint as text: base64 of the big-endian hashes in ascending order."""
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def sketches(column: pa.Array, k: int = K) -> Iterator[np.ndarray]:
    """The sketch of each text of a column.

    A long text is cut into parts of ``PART`` words that overlap by four words, so
    that every shingle lies in one; the parts' sketches are merged.
    """
    data, offsets = arrow_bytes(column)
    for a in range(0, len(column), 256):
        o = offsets[a:a + 257]
        words, bounds = word_hashes(data, o)
        for i in range(len(o) - 1):
            own = words[bounds[i]:bounds[i + 1]]
            out = sketch(shingle_hashes(own[:PART]), k)
            for at in range(PART - 4, len(own) - 4, PART - 4):
                out = merge(out, sketch(shingle_hashes(own[at:at + PART]), k), k)
            yield out


def with_fingerprint(df: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """``df`` with ``fingerprint`` and ``n_shingles`` for the text column (null: empty).

    ``n_shingles`` is the sketch's estimate of the number of distinct shingles (exact below ``k``).

    Columns of these names in ``df`` are replaced.  Rows, ties and repeats stay as they are.
    """
    prepare(df.sparkSession)
    keep = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("fingerprint", "n_shingles")]).alias("row"),
                     text_or_empty(text).alias("t"))

    def run(batches):
        for batch in batches:
            found = [(pack(s), distinct_shingles(s, k)) for s in sketches(batch.column("t"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x for x, _ in found], pa.string()),
                                              pa.array([n for _, n in found], pa.float64())], ["row", "fingerprint", "n_shingles"])

    return keep.mapInArrow(run, with_row(keep, ("fingerprint", "string"), ("n_shingles", "double"))).select("row.*", "fingerprint", "n_shingles")


def merge_fingerprints(df: DataFrame, by: list[str], fingerprint: str = "fingerprint", k: int = K, salts: int = 64) -> DataFrame:
    """One fingerprint a group: the ``k`` smallest hashes of its parts' sketches.

    Each task first merges what it holds of a group; a hot group's partial
    sketches then meet in ``salts`` shares and last in one, ``k`` hashes each.
    Null fingerprints count as nothing; null group values are a group.
    """
    prepare(df.sparkSession)
    rows = df.where(F.col(f"`{fingerprint}`").isNotNull()).select(
        F.struct(*[F.col(f"`{c}`") for c in by]).alias("g"), F.col(f"`{fingerprint}`").alias("f"))
    kind = rows.schema["g"].dataType.simpleString()

    def combine(batches):
        for batch in batches:
            held: dict = {}
            groups = batch.column("g")
            for i, (g, f) in enumerate(zip(groups.to_pylist(), batch.column("f").to_pylist())):
                key = tuple(g.values())
                at, old = held.get(key, (i, None))
                held[key] = (at, unpack(f) if old is None else merge(old, unpack(f), k))
            yield pa.RecordBatch.from_arrays([groups.take(pa.array([at for at, _ in held.values()], pa.int64())),
                                              pa.array([pack(s) for _, s in held.values()], pa.string())], ["g", "f"])

    def whole(pdf):
        out = np.zeros(0, np.uint64)
        for f in pdf["f"]:
            out = merge(out, unpack(f), k)
        return pdf.iloc[:1].assign(f=pack(out))

    part = rows.mapInArrow(combine, f"g {kind}, f string").select("g.*", F.pmod(F.xxhash64("f"), F.lit(salts)).alias("__salt"), F.col("f").alias("f"))
    names = [F.col(f"`{c}`") for c in by]
    part = part.groupBy(*names, "__salt").applyInPandas(whole, part.schema)
    return part.groupBy(*names).applyInPandas(whole, part.schema).drop("__salt").withColumnRenamed("f", fingerprint)


def edit_with_next(rows: Iterator[tuple[int, str]]) -> Iterator[tuple[int, str, str, str]]:
    """(id, text, edited text, next text) of consecutive documents; the last one only closes the row before it."""
    last = None
    for i, text in rows:
        if last is not None:
            cut = len(last[1]) // 4
            yield last[0], last[1], last[1][:len(last[1]) - cut] + text[:cut], text
        last = (i, text)


def neighbour_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprint of each text and of its text edited with the next document's.

    ``near_*`` is the resemblance, ``in_*`` the containment of the text's shingles in the
    edited or next text, ``n_shingles`` the number of distinct shingles, all estimated from the sketches.

    Documents are ordered by ``doc_id`` (null first; equal ids by text).  Each
    range of ids also gets a copy of the first document of the following range,
    and the last range that of the first, so every row meets its successor in
    its own task: one shuffle of the texts, no single ordered list.  A lone
    document is its own successor.  Null texts count as empty; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    starts = range_starts(base, "doc_id", F.octet_length("text"))
    first = base.agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "text"))["text"]).first()[0]
    if first is None:
        first = ""
    bucket = bucket_of(F.col("doc_id"), starts)
    heads = base.where(F.col("doc_id").isin(starts[1:]) if len(starts) > 1 else F.lit(False))
    # the first row in order of each id that opens a range, sent to the range before
    heads = (heads.groupBy("doc_id").agg(F.min("text").alias("text"))
             .select("doc_id", "text", (bucket - 1).cast("int").alias("b"), F.lit(True).alias("guest")))
    placed = base.select("doc_id", "text", bucket.cast("int").alias("b"), F.lit(False).alias("guest")).unionByName(heads)
    n = len(starts)
    dealt = (placed.repartitionById(n, "b")
             .sortWithinPartitions("b", F.asc_nulls_first("doc_id"), "text"))

    def run(batches):
        for group in _grouped(_edited(batches, first, n)):
            yield _measured(group, k)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double, n_shingles double, "
                                 "in_edited double, in_next double")


def _edited(batches, first: str, n: int):
    """Rows of each range in order, closed by the guest of the next range (or the first text of all)."""
    def rows():
        for batch in batches:
            yield from zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("b").to_pylist(), batch.column("guest").to_pylist())

    def closed(items):
        # a new range begins where b changes; the range of the last b ends with the first text of all
        held = None
        for i, t, b, guest in items:
            if held is not None and held[2] != b:
                held = None  # its guest came before
            if held is not None:
                yield from edit_with_next([(held[0], held[1]), (i, t)])
            held = None if guest else (i, t, b)
        if held is not None:
            yield from edit_with_next([(held[0], held[1]), (None, first)])

    return closed(rows())


def _grouped(rows, size: int = 4 << 20):
    group, n = [], 0
    for r in rows:
        group.append(r)
        n += len(r[1]) + len(r[2]) + len(r[3])
        if n >= size or len(group) >= 2048:
            yield group
            group, n = [], 0
    yield group


def _measured(group, k: int) -> pa.RecordBatch:
    texts = [r[1] for r in group] + [r[2] for r in group] + ([group[-1][3]] if group else [])
    found = list(sketches(pa.array(texts, pa.large_string()), k))
    m = len(group)
    own, edited = found[:m], found[m:2 * m]
    after = own[1:] + found[2 * m:]
    after = [a if i + 1 == m or group[i][3] is group[i + 1][1] or group[i][3] == group[i + 1][1]
             else next(sketches(pa.array([group[i][3]], pa.large_string()), k)) for i, a in enumerate(after)]
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in group], pa.int64()), pa.array([len(r[1]) for r in group], pa.int64()),
        pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in group], pa.string()),
        pa.array([pack(s) for s in own], pa.string()), pa.array([pack(s) for s in edited], pa.string()),
        pa.array([resemblance(a, b, k) for a, b in zip(own, edited)], pa.float64()),
        pa.array([resemblance(a, b, k) for a, b in zip(own, after)], pa.float64()),
        pa.array([distinct_shingles(s, k) for s in own], pa.float64()),
        pa.array([containment(a, b, k) for a, b in zip(own, edited)], pa.float64()),
        pa.array([containment(a, b, k) for a, b in zip(own, after)], pa.float64()),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "in_edited", "in_next"])


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
