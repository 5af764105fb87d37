"""Hard negatives by a packed R-tree.

Vectors of integers are packed by Sort-Tile-Recursive into leaves with minimum
bounding boxes; the label is the box's first coordinate.  A box gives an
interval for each coordinate of the inner product with an anchor, and so an
upper and a lower bound of all scores inside.  For each anchor a best-first queue opens
boxes by falling upper bound and leaves out those whose interval misses every
score window, or lies strictly below the k-th score found (equal scores may
still win by a smaller id).

The packing is a range partitioning by label, first coordinate and id into slabs; each
task packs one slab and writes its leaves to the shared folder.  Anchors are
dealt out in blocks; a task goes through the slabs one at a time, best bound
first, so it holds one block, one slab and the boxes of all leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.llm.common import filesystem, prepare
from salient.session import scratch_path

#: Rows of a leaf, leaves of an inner node, bytes of a slab's vectors.
LEAF, FAN, SLAB_BYTES = 256, 16, 8 << 20
#: Anchors searched at once.
BLOCK = 512
_LONG = (1 << 63) - 1


def scored_rows(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v being floor(scale * x) as long, x as double.

    Left out are rows with a null id, label or vector, and vectors with a null or
    non-finite component.  Empty vectors take part (every score is 0); a shorter
    vector counts as filled up with zeros.  Components beyond 63 bits are an error.
    """
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return df.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                 F.transform(x, lambda e: F.floor(e * F.lit(scale)).cast("long")).alias("v"))


# ---------------------------------------------------------------------------
# packing

def tile(label: np.ndarray, ids: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves: sorted by label, then halved on one coordinate after the other until a leaf holds ``leaf`` rows."""
    out: list[np.ndarray] = []

    def halve(rows: np.ndarray, axis: int) -> None:
        if len(rows) <= leaf:
            if len(rows):
                out.append(rows)
            return
        if v.shape[1]:
            rows = rows[np.lexsort((ids[rows], v[rows, axis % v.shape[1]]))]
        # the cut falls on a whole number of leaves, so that all but the last are full
        half = (-(-len(rows) // leaf) // 2) * leaf
        halve(rows[:half], axis + 1)
        halve(rows[half:], axis + 1)

    order = np.lexsort((ids, label))
    for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        halve(part, 0)
    return out


_LEAVES = ("slab int, leaf int, n int, dims int, label_lo long, label_hi long, lo binary, hi binary, ids binary, labels binary, vectors binary")


def pack(rows: DataFrame, leaf: int = LEAF) -> str:
    """The leaves of all rows, written slab by slab to the shared folder; returns the folder.

    Exact repeats of a row count once.
    """
    spark = rows.sparkSession
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    slab = max(leaf, SLAB_BYTES // (8 * max(1, dims)))
    slabs = max(1, -(-n // slab))
    first = F.coalesce(F.try_element_at("v", F.lit(1)), F.lit(0).cast("long")).alias("first")
    # equal rows have equal keys and so meet in one slab; the id splits any run of equal vectors
    dealt = rows.select("vec_id", "label", "v", first).repartitionByRange(slabs, "label", "first", "vec_id").select("vec_id", "label", "v")

    def build(batches):
        from pyspark import TaskContext

        got = [(b.column("vec_id").to_numpy(), b.column("label").to_numpy(), _matrix(b.column("v"), dims)) for b in batches if b.num_rows]
        if not got:
            return
        ids, label, v = (np.concatenate([g[i] for g in got]) for i in range(3))
        del got
        _, at = np.unique(np.column_stack([ids, label, v]), axis=0, return_index=True)
        ids, label, v = ids[at], label[at], v[at]
        no = TaskContext.get().partitionId()
        for k, rows_of in enumerate(tile(label, ids, v, leaf)):
            box = v[rows_of]
            yield pa.RecordBatch.from_pylist([{
                "slab": no, "leaf": k, "n": len(rows_of), "dims": dims, "label_lo": int(label[rows_of].min()), "label_hi": int(label[rows_of].max()),
                "lo": box.min(0).tobytes(), "hi": box.max(0).tobytes(), "ids": ids[rows_of].tobytes(),
                "labels": label[rows_of].tobytes(), "vectors": box.tobytes()}], schema=_ARROW)

    path = scratch_path(spark, "str-leaves")
    dealt.mapInArrow(build, _LEAVES).write.parquet(path)
    return path


_ARROW = pa.schema([("slab", pa.int32()), ("leaf", pa.int32()), ("n", pa.int32()), ("dims", pa.int32()), ("label_lo", pa.int64()), ("label_hi", pa.int64()),
                    *[(c, pa.binary()) for c in ("lo", "hi", "ids", "labels", "vectors")]])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` numbers, shorter ones filled up with zeros."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (size == dims).all():
        return flat.reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = flat
    return out


# ---------------------------------------------------------------------------
# searching

class _Slab:
    """Boxes of a slab's leaves, with inner nodes of ``FAN`` leaves each; rows are read when a leaf is opened."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.files, self.path = files, path
        t = pq.read_table(path, filesystem=files, columns=["dims", "label_lo", "label_hi", "lo", "hi"])
        d = t.column("dims")[0].as_py() if t.num_rows else 0
        self.lo, self.hi = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64).reshape(t.num_rows, d) for c in ("lo", "hi"))
        self.label_lo, self.label_hi = (t.column(c).to_numpy() for c in ("label_lo", "label_hi"))
        self.most = int(max(abs(int(self.lo.min())), abs(int(self.hi.max())))) if self.lo.size else 0
        self.rows = None
        groups = np.arange(0, t.num_rows, FAN)
        if t.num_rows:
            self.node_lo, self.node_hi = np.minimum.reduceat(self.lo, groups), np.maximum.reduceat(self.hi, groups)
            self.node_label = np.minimum.reduceat(self.label_lo, groups), np.maximum.reduceat(self.label_hi, groups)

    def __len__(self) -> int:
        return len(self.lo)

    def open(self) -> None:
        t = pq.read_table(self.path, filesystem=self.files, columns=["ids", "labels", "vectors"])
        d = self.lo.shape[1]
        self.rows = []
        for i, l, v in zip(*(t.column(c) for c in ("ids", "labels", "vectors"))):
            ids = np.frombuffer(i.as_buffer(), np.int64)
            self.rows.append((ids, np.frombuffer(l.as_buffer(), np.int64), np.frombuffer(v.as_buffer(), np.int64).reshape(len(ids), d)))

    def close(self) -> None:
        self.rows = None


def _number_type(slabs: list[_Slab], anchors: np.ndarray):
    """A type in which every bound and score is exact: doubles below 2^53, else long, else Python's whole numbers."""
    most = max([s.most for s in slabs] + [int(max(abs(int(anchors.min())), abs(int(anchors.max())))) if anchors.size else 0])
    top = max(1, anchors.shape[1]) * most * most
    return np.float64 if top < 1 << 53 else np.int64 if top <= _LONG else object


def _bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of anchors with anything in the boxes: sums of each coordinate's interval."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


class _Window:
    """The best ``k`` (score, id, place) found with lo <= score <= hi; by falling score, then id."""

    __slots__ = ("lo", "hi", "k", "held")

    def __init__(self, lo, hi, k: int):
        self.lo, self.hi, self.k, self.held = lo, hi, k, []

    def floor(self):
        """No score strictly below can still get in."""
        return self.lo if len(self.held) < self.k else max(self.lo, self.held[-1][0])

    def add(self, scores: np.ndarray, ids: np.ndarray, tags: tuple) -> None:
        good = np.flatnonzero((scores >= self.floor()) & (scores <= self.hi))
        if len(good) > self.k:  # only the best of the leaf can count
            good = good[np.lexsort((ids[good], -scores[good]))[:self.k]]
        if len(good):
            found = [(int(scores[g]), int(ids[g]), (*tags, int(g))) for g in good]
            self.held = sorted(self.held + found, key=lambda x: (-x[0], x[1], x[2]))[:self.k]


def _search(slabs: list[_Slab], anchors: np.ndarray, wanted, allowed, windows: list[list[_Window]], kind) -> None:
    """Fill every anchor's windows from all slabs.

    ``wanted(i, label_lo, label_hi)`` says which boxes may hold rows for anchor i
    by their labels; ``allowed(i, ids, labels, vectors)`` which rows of a leaf.
    """
    a = anchors.astype(kind)
    top = np.stack([_bounds(a, s.node_lo.astype(kind), s.node_hi.astype(kind))[1].max(1) for s in slabs]) if slabs else np.zeros((0, len(a)))
    for s in sorted(range(len(slabs)), key=lambda s: -top[s].max()):
        slab = slabs[s]
        low, high = _bounds(a, slab.lo.astype(kind), slab.hi.astype(kind))
        node_low, node_high = _bounds(a, slab.node_lo.astype(kind), slab.node_hi.astype(kind))
        for i, wins in enumerate(windows):
            if not wins or top[s, i] < min(w.floor() for w in wins):
                continue
            nodes = np.flatnonzero(wanted(i, *slab.node_label) & (node_low[i] <= max(w.hi for w in wins)))
            queue = [(-node_high[i, n], -1, int(n)) for n in nodes]
            heapq.heapify(queue)
            while queue:
                bound, leaf, node = heapq.heappop(queue)
                if -bound < min(w.floor() for w in wins):
                    break
                if leaf < 0:
                    part = np.arange(node * FAN, min(len(slab), node * FAN + FAN))
                    for n in part[wanted(i, slab.label_lo[part], slab.label_hi[part])].tolist():
                        if any(low[i, n] <= w.hi and high[i, n] >= w.floor() for w in wins):
                            heapq.heappush(queue, (-high[i, n], n, node))
                    continue
                if not any(low[i, leaf] <= w.hi and -bound >= w.floor() for w in wins):
                    continue
                if slab.rows is None:
                    slab.open()
                ids, labels, vectors = slab.rows[leaf]
                some = np.flatnonzero(allowed(i, ids, labels, vectors))
                scores = vectors[some].astype(kind) @ a[i]
                for w in wins:
                    w.add(scores, ids[some], (s, leaf))
        slab.close()


def mine_block(slabs: list[_Slab], ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of one block of anchors."""
    kind = _number_type(slabs, anchors)

    def other(i, i_ids, i_labels, vectors):
        good = i_labels == labels[i]
        same = np.flatnonzero(good & (i_ids == ids[i]))
        good[same[(vectors[same] == anchors[i]).all(1)]] = False
        return good

    best = [[_Window(-float("inf"), float("inf"), positives)] for _ in ids]
    _search(slabs, anchors, lambda i, lo, hi: (lo <= labels[i]) & (labels[i] <= hi), other, best, kind)
    # negatives of score n for a positive of score p: low * p <= 100 * n <= high * p
    windows: list[list[_Window]] = []
    for (w,) in best:
        spans = {p: (-((-low * p) // 100), high * p // 100) for p, _, _ in w.held}
        windows.append([_Window(a, b, negatives) for a, b in sorted(set(spans.values())) if a <= b])
    _search(slabs, anchors, lambda i, lo, hi: (lo != labels[i]) | (hi != labels[i]), lambda i, _, l, __: l != labels[i], windows, kind)
    for i, (w,) in enumerate(best):
        found = {(x.lo, x.hi): x.held for x in windows[i]}
        for p, pid, _ in w.held:
            for rank, (n, nid, _) in enumerate(found.get((-((-low * p) // 100), high * p // 100), ()), 1):
                if max(abs(p), abs(n)) > _LONG:
                    raise OverflowError("a score does not fit into 64 bits")
                yield int(ids[i]), pid, rank, nid, p, n


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of its label, the first ``negatives`` rows of other labels in the score window.

    Both tables are (vec_id, label, v) as from ``scored_rows``; anchors are rows
    too.  Scores are inner products; higher ones come first, ties by smaller id.
    The window of a positive of score p is ``low * p <= 100 n <= high * p`` (for a
    negative p and low < high it is empty).  Exact repeats of a row count once;
    rows that share an id but differ each take part, and ties among them go
    by their place in the packing.  Without rows or anchors there is no result.
    Every row is indexed and the search is exact.
    """
    spark = rows.sparkSession
    prepare(spark)
    path = pack(rows)
    dims = rows.select(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    asked = anchors.select("vec_id", "label", "v").dropDuplicates()
    dealt = asked.repartition(2 * spark.sparkContext.defaultParallelism, "vec_id")

    def run(batches):
        files, root = filesystem(path)
        slabs = None
        for batch in batches:
            if slabs is None:
                names = sorted(f.path for f in files.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
                slabs = [s for s in (_Slab(files, n) for n in names) if len(s)]
            ids, labels, v = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("v"), dims)
            for a in range(0, len(ids), BLOCK):
                found = list(mine_block(slabs, ids[a:a + BLOCK], labels[a:a + BLOCK], v[a:a + BLOCK], positives, negatives, low, high))
                cols = list(zip(*found)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j == 2 else pa.int64()) for j, c in enumerate(cols)], _NAMES)

    return dealt.mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


_NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def op13_str_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings``: anchors are the ids divisible by 100; ids divisible by 7 first get the label (label + 1) % 10."""
    prepare(spark)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = scored_rows(moved)
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


OP13_SQL = """
WITH q AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label AS anchor_label, r.label, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM (SELECT * FROM q WHERE vec_id % 100 = 0) a JOIN q r ON r.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE label = anchor_label)
  WHERE rn <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
   AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
WHERE rank <= 5
"""
