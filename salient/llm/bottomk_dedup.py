"""Near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles, its sketch the ``K``
smallest of their hashes.  Documents with equal sets form a class and only its
representative goes on.  Inverted lists of retained values tell which classes
can be similar: each class enters the lists of its rarest values only, as many
as a similar class must share one of.  Classes joined by lists are brought
together in groups; within a group overlaps of sketches are counted, an estimate
from the union of two sketches filters, and the exact Jaccard similarity of the
full sets decides.  Groups larger than a block are compared block against block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.llm.common import arrow_bytes, prepare, shingle_hashes, text_or_empty, word_hashes, written

#: Retained hashes.
K = 64
#: A pair is linked if 100 * intersection >= LINK * union.
LINK = 75
#: Overlap of two full sketches below which a pair of similarity 0.75 falls with a chance of about one in ten million
#: (the expected overlap is 48, its standard deviation 3.5).
FULL_OVERLAP = 30
#: Least overlap of a set of fewer than K shingles, held whole, with the sketch of a somewhat larger set that is not.
MIXED_OVERLAP = 42
#: How far below the similarity an estimate may fall (almost five standard deviations).
SLACK = 0.25
#: Classes, and bytes of sets, of a block.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Edges of a part written between rounds.
EDGES = 1 << 18
#: Bits of the filter of ids whose sets are needed, for each id, and at most (64 MB; a fuller filter lets more sets pass to the join).
FILTER_SHARE, FILTER_MOST, FILTER_PARTS = 16, 1 << 29, 64


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n, key1, key2, sketch): number of shingles, digest of the whole set, and the retained hashes."""
    def run(batches):
        for batch in batches:
            data, offsets = arrow_bytes(batch.column("text"))
            n, key1, key2, sketch = [], [], [], []
            for a in range(0, len(batch), 256):
                words, bounds = word_hashes(data, offsets[a:a + 257])
                for i in range(len(bounds) - 1):
                    s = shingle_hashes(words[bounds[i]:bounds[i + 1]])
                    one, two = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    n.append(len(s))
                    key1.append(one)
                    key2.append(two)
                    sketch.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()),
                                              pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "n", "key1", "key2", "sketch"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n long, key1 long, key2 long, sketch array<long>")


def list_entries(classes: DataFrame, k: int = K) -> DataFrame:
    """(v, rep): the inverted lists, rarest values first, without values that one class alone retains.

    Two similar classes share at least ``need`` retained values, so with all
    values in one order (by frequency, then value) they share one of the first
    ``len - need + 1``.  Very common values come last and hardly ever count.
    """
    values = classes.select("rep", "n", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    held = values.join(common, "v").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("fv"))
    size = F.least("n", F.lit(k))
    need = F.when(F.col("n") < k, F.least(F.ceil(F.col("n") * LINK / 100), F.lit(MIXED_OVERLAP))).otherwise(FULL_OVERLAP)
    rare = size - F.size("fv")  # values of its own stand before the shared ones
    take = F.greatest(size - need + 1 - rare, F.lit(0)).cast("int")
    return held.select("rep", F.explode(F.slice("fv", F.lit(1), take)).alias("fv")).select(F.col("fv.v").alias("v"), "rep")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node of each edge's component.

    Large-star and small-star steps in turn: every node's larger neighbours are
    hung onto its smallest neighbour, then its smaller ones, until each node hangs
    on its component's smallest one.  That takes a number of rounds that grows
    with the logarithm of the longest path, whatever the order of the ids.  Every
    round is written to the shared folder, in parts of about ``EDGES`` rows.
    """
    def put(df: DataFrame, step: str) -> DataFrame:
        return written(df.coalesce(parts), f"{name}-{step}")

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, f"{name}-edges")
    size = edges.count()
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-size // EDGES))
    before, i = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # large star: v > u hangs onto the smallest of u and its neighbours
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v"))
        large = put(large.distinct(), f"{i}-large")
        # small star: a node and its smaller neighbours hang onto the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = put(small.distinct(), f"{i}-small")
        # the stars stand still when neither step moves an edge; counts and sums tell
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38, 0)"))).first()
        if mark == before:
            labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before, i = mark, i + 1


def _bits(ids: DataFrame, column: str) -> np.ndarray:
    """A bit set of hashed ids, of a size that follows their number."""
    size = min(FILTER_MOST, max(1 << 16, 1 << (FILTER_SHARE * ids.count()).bit_length()))
    width = size // FILTER_PARTS

    def run(batches):
        for batch in batches:
            spot = np.unique(_spot(batch.column(column).to_numpy(), size))
            cuts = np.searchsorted(spot, np.arange(FILTER_PARTS + 1) * width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FILTER_PARTS), pa.int32()), pa.array(
                [(spot[a:b] - i * width).astype(np.uint32).tobytes() for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))], pa.binary())], ["part", "spots"])

    def fill(pdf):
        bits = np.zeros(width, bool)
        for spots in pdf["spots"]:
            bits[np.frombuffer(spots, np.uint32)] = True
        return pdf.iloc[:1].assign(spots=np.packbits(bits).tobytes())

    total = np.zeros(size // 8, np.uint8)
    for r in ids.select(column).mapInArrow(run, "part int, spots binary").groupBy("part").applyInPandas(fill, "part int, spots binary").toLocalIterator():
        total[r["part"] * width // 8:(r["part"] + 1) * width // 8] = np.frombuffer(bytes(r["spots"]), np.uint8)
    return total


def _spot(ids: np.ndarray, size: int) -> np.ndarray:
    return ((ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def needed_sets(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(rep, n, shingles): the full sorted sets of the documents that pass the filter of ids."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            spot = _spot(ids, 8 * len(bits))
            rows = np.flatnonzero((bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1)
            data, offsets = arrow_bytes(batch.column("text").take(pa.array(rows)))
            sets = []
            for i in range(len(rows)):
                words, _ = word_hashes(data, offsets[i:i + 2])
                sets.append(shingle_hashes(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "n", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "rep long, n long, shingles binary")


def _overlaps(parts: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Numbers of common values between the sets of two lists, by inverted lists laid out as columns."""
    sizes = [len(s) for s in parts + other]
    _, place, count = np.unique(np.concatenate(parts + other), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    use = count[place] > 1
    owner, place = owner[use], np.unique(place[use], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(parts), len(other)), np.float32)
    step, width = 4096, int(place[-1]) + 1 if len(place) else 0
    for a in range(0, width, step):
        lo, hi = np.searchsorted(place, (a, a + step))
        table = np.zeros((len(sizes), min(step, width - a)), np.float32)
        table[owner[lo:hi], place[lo:hi] - a] = 1
        out += table[:len(parts)] @ table[len(parts):].T
    return out


def estimates(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Estimated similarity of pairs of full sketches (rows of ``a`` and ``b``): share of the union's sketch held by both."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    rank = np.cumsum(~again, axis=1)
    return (again & (rank <= k)).sum(1) / k


def links_between(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, k: int = K) -> list[tuple[int, int]]:
    """Links that join the same classes as all links between two blocks (or within one) do.

    Pairs go by falling estimate; a pair whose classes are already joined needs
    no test, since it could join nothing more.
    """
    rows = left + (right or [])
    sets = [s for _, s in rows]
    n = np.array([len(s) for s in sets])
    sketches = [s[:k] for s in sets]
    split = len(left)
    x0 = list(range(split))
    y0 = list(range(split, len(rows))) if right is not None else x0
    over = _overlaps([sketches[i] for i in x0], [sketches[j] for j in y0])
    nx, ny = n[x0][:, None], n[y0][None, :]
    need = np.minimum(np.where(nx < k, np.minimum(np.ceil(nx * LINK / 100), MIXED_OVERLAP), FULL_OVERLAP),
                      np.where(ny < k, np.minimum(np.ceil(ny * LINK / 100), MIXED_OVERLAP), FULL_OVERLAP))
    ok = (over >= need) & (100 * np.minimum(nx, ny) >= LINK * np.maximum(nx, ny))
    if right is None:
        ok = np.triu(ok, 1)
    xs, ys = np.nonzero(ok)
    if right is not None:
        ys = ys + split
    guess = np.ones(len(xs))
    full = np.flatnonzero((n[xs] >= k) & (n[ys] >= k)) if len(xs) else np.zeros(0, np.int64)
    if len(full):
        table = np.zeros((len(rows), k), np.uint64)
        for i, s in enumerate(sketches):
            if len(s) == k:
                table[i] = s
        for a in range(0, len(full), 20_000):
            part = full[a:a + 20_000]
            guess[part] = estimates(table[xs[part]], table[ys[part]], k)
    keep = np.flatnonzero(guess >= LINK / 100 - SLACK)
    keep = keep[np.argsort(-guess[keep], kind="stable")]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    exact = None
    if len(keep) > 4000:  # many pairs: all intersections of the block at once
        exact = _overlaps([sets[i] for i in x0], [sets[j] for j in y0])
    out = []
    for p in keep.tolist():
        x, y = int(xs[p]), int(ys[p])
        a, b = find(x), find(y)
        if a == b:
            continue
        both = int(exact[x, y - split if right is not None else y]) if exact is not None else len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both >= LINK * (len(sets[x]) + len(sets[y]) - both):
            parent[a] = b
            out.append((rows[x][0], rows[y][0]))
    return out


def verified_links(groups: DataFrame, entries: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links within the groups ``(node, label)`` that connect what all links connect.

    A group beyond BLOCK classes or BLOCK_BYTES bytes of sets is dealt into
    blocks by a hash; each pair of blocks is one task's work of bounded size.  A
    class goes to its own block, and to those others in which a class stands that shares
    one of its inverted lists ``entries(v, rep)``.
    """
    rows = groups.select(F.col("node").alias("rep"), "label").join(sets, "rep")
    rows = written(rows, "group-sets")
    # the length of the binary column is 8 bytes a shingle
    size = rows.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"))
    rows = rows.join(size, "label").withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = entries.join(rows.where("blocks > 1").select("rep", "b"), "rep")
    meets = placed.select("v", F.col("b").alias("o")).distinct().join(placed, "v").where("o <> b").select("rep", "o").distinct()
    meets = meets.groupBy("rep").agg(F.collect_list("o").alias("others"))  # at most one entry a block
    own = F.array(F.col("b"))
    dealt = rows.join(meets, "rep", "left").select("label", "rep", "b", "shingles", F.explode(F.coalesce(F.concat("others", own), own)).alias("o")).select(
        "label", "rep", "b", "shingles", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, block = table.column("rep").to_pylist(), table.column("b").to_pylist()
        found = [(r, np.frombuffer(s.as_buffer(), np.uint64)) for r, s in zip(ids, table.column("shingles").combine_chunks())]
        left = [f for f, b in zip(found, block) if b == i]
        right = [f for f, b in zip(found, block) if b == j] if i != j else None
        links = links_between(left, right) if left and (right is None or right) else []
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return dealt.groupBy("label", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest id reachable over links.  Null and empty
    texts and texts without words have no shingle and are linked with nothing.
    ``doc_id`` names a document: rows that share an id share a component, and a
    row without id is kept and linked with nothing.  Equal sets are one class,
    so copies cost a row each and are never paired.
    """
    prepare(docs.sparkSession)
    sig = written(signatures(docs), "signatures")
    real = sig.where("n > 0 and doc_id is not null")
    classes = written(real.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    entries = written(list_entries(classes), "lists")
    heads = entries.groupBy("v").agg(F.min("rep").alias("head"), F.count("*").alias("f")).where("f > 1").select("v", "head")
    star = entries.join(heads, "v").where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b"))
    groups = components(star, "groups")
    sets = needed_sets(docs, _bits(groups, "node"))
    # a filter lets a few other ids pass; the join with the groups drops them
    links = verified_links(groups, entries, sets)
    linked = components(links, "links")
    whole = classes.select("key1", "key2", "rep").join(linked, classes["rep"] == linked["node"], "left").select(
        "key1", "key2", F.coalesce("label", "rep").alias("component_id"))
    rows = sig.select("doc_id", "n", "key1", "key2").join(whole, ["key1", "key2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op8_bottomk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
