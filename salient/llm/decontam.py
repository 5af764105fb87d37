"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, so that a question
with other numbers has the same template.  Hashes of template windows are joined
between benchmark and documents; windows with the item's own values count, and
others where their values map as most windows of the alignment map them.  This
finds re-parameterised copies, also with single values altered.  Verbatim copies
do not depend on the typing: windows of the lower-cased tokens are joined too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salient.llm.common import _LOWER, arrow_bytes, hash_runs, mix, prepare, row_key, text_or_empty, written

#: Tokens in a window; items with fewer have one window of their own length (templates at least MIN_TOKENS).
WINDOW = 8
MIN_TOKENS = 3
#: Share of an item's windows that a document must hold.
MIN_COVERAGE = 0.5
#: Bits of the filter of benchmark windows that every task gets: for each window, at least, and at most (64 MB; a fuller
#: filter only lets more windows pass to the join).
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 64, 1 << 16, 1 << 29
SEGMENT = 1 << 20

WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Units recognised after a number (fixed values).
UNITS = ("mm cm m km inch inches foot feet ft yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons tonne tonnes ml l liter liters litre litres "
         "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent degree degrees "
         "dollar dollars euro euros cent cents usd eur gbp mph kmh hz khz mhz ghz w kw mw v kv a ma j kj pa kpa bar k c f kb mb gb tb").split()

_U = np.uint64
_KIND = np.zeros(256, np.uint8)  # 0 gap, 1 letter, 2 digit
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
#: Added to the length in the hash of a window without placeholders.
_PLAIN = _U(0x504C41494E)
_HOLDERS = np.array([0, 0x4E554D, 0x4E414D45, 0x554E4954], np.uint64)


def _unit_hashes() -> np.ndarray:
    data, offsets = arrow_bytes(pa.array(UNITS))
    return np.sort(hash_runs(data, offsets[:-1], offsets[1:]))


_UNIT_HASHES = _unit_hashes()


def tokens(data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, kind, start, end) of the tokens of one text."""
    h, kind, start, end = plain_tokens(data, lo, hi)
    return template(h, kind), kind, start, end


def template(h: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return np.where(kind == WORD, h, _HOLDERS[kind])


def plain_tokens(data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, kind, start, end) of the tokens of one text, worked on a segment at a time.

    Letters (also non-ASCII ones; A-Z and Latin-1 capitals are lower-cased) and
    digits form words and numbers (``1,000.5`` is one); the rest separates.
    """
    parts = []
    at, opening = lo, True  # opening: a sentence begins here
    after_number = False
    while at < hi:
        end = min(at + SEGMENT, hi)
        while end < hi:
            gaps = np.flatnonzero((data[end:min(end + 4096, hi)] == 0x20) | (data[end:min(end + 4096, hi)] == 0x0A))
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + 4096, hi)
        raw = data[at:end].copy()
        n = len(raw)
        kind = _KIND[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
        lead = lead[(raw[lead] >= 0x80) & (raw[lead] <= 0x9E)]
        upper = (raw >= 0x41) & (raw <= 0x5A)
        upper[lead - 1] = True
        raw[lead] += 0x20
        for i in np.flatnonzero(raw == 0xC2):  # Latin-1 signs
            kind[i:i + 2] = 0
        for i in np.flatnonzero(raw[:-1] == 0xE2):  # general punctuation
            if data[at + i + 1] in (0x80, 0x81):
                kind[i:i + 3] = 0
        point = np.flatnonzero((raw[1:-1] == 0x2E) | (raw[1:-1] == 0x2C)) + 1 if n > 2 else np.zeros(0, np.int64)
        kind[point[(kind[point - 1] == 2) & (kind[point + 1] == 2)]] = 2
        begin = kind > 0
        begin[1:] &= kind[1:] != kind[:-1]
        first = np.flatnonzero(begin)
        if len(first):
            last = kind > 0
            last[:-1] &= kind[1:] != kind[:-1]
            after = np.flatnonzero(last) + 1
            h = hash_runs(_LOWER[raw], first, after)
            stops = np.concatenate([[0], np.cumsum(_STOP[raw] & (kind == 0))])
            fresh = np.empty(len(first), bool)
            fresh[0] = opening or stops[first[0]] > 0
            fresh[1:] = stops[first[1:]] > stops[after[:-1]]
            opening = bool(stops[n] > stops[after[-1]])
            k = np.where(kind[first] == 2, NUMBER, np.where(upper[first] & ~fresh, NAME, WORD)).astype(np.uint8)
            follows = np.concatenate([[after_number], k[:-1] == NUMBER])
            spot = np.minimum(np.searchsorted(_UNIT_HASHES, h), len(_UNIT_HASHES) - 1)
            k[follows & (k != NUMBER) & (_UNIT_HASHES[spot] == h)] = UNIT
            after_number = bool(k[-1] == NUMBER)
            parts.append((h, k, first + at, after + at))
        else:
            opening = opening or bool((_STOP[raw]).any())
        at = end
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*parts))


def _rolled(h: np.ndarray, n: int, salt: np.uint64) -> np.ndarray:
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.zeros(m, _U)
    for i in range(n):
        out = out * _U(0xA24BAED4963EE407) + h[i:i + m]
    return mix(out + salt)


def windows(h: np.ndarray, kind: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, usable) of each window of ``n`` template tokens; at least half must be words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, bool)
    words = np.concatenate([[0], np.cumsum(kind == WORD)])
    return _rolled(h, n, _U(n)), 2 * (words[n:] - words[:m]) >= n


def plain_windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` tokens without placeholders."""
    return _rolled(h, n, _U(n) + _PLAIN)


def slots(data: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray, at: int, n: int) -> list[str]:
    """Placeholders of a window with their values, lower-cased: ``2:paris``."""
    return [f"{kind[j]}:{data[start[j]:end[j]].tobytes().decode('utf-8', 'replace').lower()}" for j in range(at, at + n) if kind[j] != WORD]


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, tuple]]:
    data, offsets = arrow_bytes(column)
    for i in range(len(column)):
        yield i, data, plain_tokens(data, int(offsets[i]), int(offsets[i + 1]))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, pos, n, h, slots, usable, item_windows, typed_windows) of every window of every item.

    Each window has a row without placeholders, whose slots are null, and, if
    its template is usable, one of its template.
    """
    def run(batches):
        for batch in batches:
            ids, rows = batch.column("item_id").to_pylist(), []
            for i, data, (h, kind, start, end) in _texts(batch.column("text")):
                n = min(window, len(h))
                if not n:
                    continue
                w, ok = windows(template(h, kind), kind, n)
                ok &= n >= MIN_TOKENS
                for p, x in enumerate(plain_windows(h, n)):
                    rows.append((ids[i], p, n, int(x.view(np.int64)), None, bool(ok[p]), len(ok), int(ok.sum())))
                for p in np.flatnonzero(ok):
                    rows.append((ids[i], int(p), n, int(w[p].view(np.int64)), slots(data, kind, start, end, p, n), True, len(ok), int(ok.sum())))
            cols = zip(*rows) if rows else [[]] * 8
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["item_id", "pos", "n", "h", "slots", "usable", "item_windows", "typed_windows"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).mapInArrow(
        run, "item_id long, pos int, n int, h long, slots array<string>, usable boolean, item_windows int, typed_windows int")


def window_filter(bench: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit set of the benchmark's window hashes, of a size that follows their number, and the window lengths that occur."""
    size = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_SHARE * bench.count()).bit_length()))

    def run(batches):
        spots: list[np.ndarray] = []
        sizes: set[int] = set()
        for batch in batches:
            spots.append(np.unique(_spot(batch.column("h").to_numpy().view(np.uint64), size)))
            sizes |= set(batch.column("n").to_pylist())
        if spots:
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(np.concatenate(spots)).astype(np.uint32).tobytes()], pa.binary()),
                                              pa.array([sorted(sizes)], pa.list_(pa.int32()))], ["spots", "sizes"])

    total, sizes = np.zeros(size, bool), set()
    for r in bench.select("h", "n").mapInArrow(run, "spots binary, sizes array<int>").toLocalIterator():
        total[np.frombuffer(bytes(r["spots"]), np.uint32)] = True
        sizes |= set(r["sizes"])
    return np.packbits(total), sorted(sizes)


def _spot(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> _U(65 - size.bit_length())).astype(np.int64)


def document_windows(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(k1, k2, doc_id, pos, h, slots) of the documents' windows that pass the filter.

    Windows without placeholders have a null position and null slots, and are
    one row however often the document holds them.
    """
    def passes(w):
        top = _spot(w, 8 * len(bits))
        return ((bits[top >> 3] >> (7 - (top & 7)).astype(np.uint8)) & 1).astype(bool)

    def run(batches):
        for batch in batches:
            row, pos, found, held = [], [], [], []
            for i, data, (h, kind, start, end) in _texts(batch.column("text")):
                typed = template(h, kind)
                for n in sizes:
                    w = plain_windows(h, n)
                    for x in np.unique(w[passes(w)]):
                        row.append(i)
                        pos.append(None)
                        found.append(int(x.view(np.int64)))
                        held.append(None)
                    if n < MIN_TOKENS:
                        continue
                    w, ok = windows(typed, kind, n)
                    for p in np.flatnonzero(ok & passes(w)):
                        row.append(i)
                        pos.append(int(p))
                        found.append(int(w[p].view(np.int64)))
                        held.append(slots(data, kind, start, end, p, n))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("k1", "k2", "doc_id")), pa.array(pos, pa.int32()), pa.array(found, pa.int64()), pa.array(held, pa.list_(pa.string()))],
                                             ["k1", "k2", "doc_id", "pos", "h", "slots"])

    return docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "k1 long, k2 long, doc_id long, pos int, h long, slots array<string>")


def agreeing(pairs: list[tuple[list[str], list[str]]]) -> list[bool]:
    """Which windows of an alignment, given as (item's slots, document's slots), count.

    Windows with unchanged slots always do; others if each of their values maps
    to the document's value that most windows give it (of equals, the unchanged
    one, then the greatest).
    """
    seen: dict[str, Counter] = {}
    for a, b in pairs:
        for i, d in set(zip(a, b)):
            seen.setdefault(i, Counter())[d] += 1
    most = {i: max(c, key=lambda d: (c[d], d == i, d)) for i, c in seen.items()}
    return [len(a) == len(b) and (a == b or all(most[i] == d for i, d in zip(a, b))) for a, b in pairs]


def counted_windows(lines: DataFrame) -> DataFrame:
    """``lines`` with the positions of the windows that count (``ipos``, ``typed`` those with a usable template) in place of all, and whether a value in them differs."""
    kept = [c for c in lines.columns if c != "found"]

    def run(batches):
        for batch in batches:
            ipos, typed, changed = [], [], []
            for found in batch.column("found").to_pylist():
                good = agreeing([(w["islots"] or [], w["slots"] or []) for w in found])
                ipos.append([w["ipos"] for w, g in zip(found, good) if g])
                typed.append([w["ipos"] for w, g in zip(found, good) if g and w["usable"]])
                changed.append(any(g and w["islots"] != w["slots"] for w, g in zip(found, good)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(ipos, pa.list_(pa.int32())), pa.array(typed, pa.list_(pa.int32())), pa.array(changed, pa.bool_())],
                                             [*kept, "ipos", "typed", "changed"])

    return lines.mapInArrow(run, ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in kept) + ", ipos array<int>, typed array<int>, changed boolean")


def rare_windows(bench: DataFrame, min_coverage: float) -> DataFrame:
    """(item_id, h): for each item the hashes of its rarest windows, of which a copy must hold at least one.

    A copy holds ``min_coverage`` of the item's windows, or of those with a usable
    template; so with the windows in order of how many items have them, it holds
    one of the first ``all - least + 1``.  Windows that many items share, as a common stem, come
    last and join only where most of an item is made of such.
    """
    often = bench.groupBy("h").agg(F.count_distinct("item_id").alias("f"))
    spots = bench.join(often, "h").groupBy("item_id", "pos", "usable", "item_windows", "typed_windows").agg(F.max("f").alias("f"))
    order = Window.partitionBy("item_id").orderBy("f", "pos")
    typed = Window.partitionBy("item_id").orderBy(F.desc("usable"), "f", "pos")
    most = lambda n: F.col(n) - F.ceil(F.col(n) * min_coverage - 1e-9) + 1
    first = (spots.withColumn("r", F.row_number().over(order)).withColumn("rt", F.row_number().over(typed))
             .where((F.col("r") <= most("item_windows")) | (F.col("usable") & (F.col("rt") <= most("typed_windows")))))
    return bench.select("item_id", "pos", "h").join(first.select("item_id", "pos"), ["item_id", "pos"]).select("item_id", "h").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(k1, k2, doc_id, item_id, n_windows, item_windows, coverage, slots_changed) of the copies found.

    An alignment is a fixed distance between item and document.  Its windows
    whose values are the item's own count whatever the others hold; of the rest,
    those whose values conflict with the mapping of most of its windows do not.
    Windows equal token for token, but for the case of letters, count anywhere.
    A pair is a copy if the windows that count are at least ``min_coverage`` of
    the item's windows, or of those with a usable template (the greater share is
    given); ``slots_changed`` tells whether a value differs.  Null and empty
    texts, and items without a letter or digit, have no windows; items of one or
    two tokens are found verbatim only.
    Equal rows are one document here.  Every window of every document is looked
    up in a filter of the benchmark's windows; only those it passes are shuffled.
    Documents meet the items of whose rare windows they hold one, and the pairs'
    other windows are then joined by document and hash.  A task holds a few arrays of eight bytes for
    each token of a text.
    """
    prepare(docs.sparkSession)
    bench = written(benchmark_windows(benchmark), "benchmark-windows")
    bits, sizes = window_filter(bench)
    hits = written(document_windows(docs, bits, sizes).distinct(), "window-hits")
    items = bench.select("item_id", F.col("pos").alias("ipos"), "h", F.col("slots").alias("islots"), "usable", "item_windows", "typed_windows").distinct()
    pair = ["k1", "k2", "doc_id", "item_id", "item_windows", "typed_windows"]
    met = hits.join(rare_windows(bench, min_coverage), "h").select("k1", "k2", "item_id").distinct()
    lines = (met.join(items, "item_id").join(hits, ["k1", "k2", "h"]).groupBy(*pair, (F.col("pos") - F.col("ipos")).alias("shift"))
             .agg(F.collect_list(F.struct("ipos", "islots", "slots", "usable")).alias("found")))
    both = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    found = (counted_windows(lines).where(F.size("ipos") > 0).groupBy(*pair)
             .agg(both("ipos").alias("n_all"), both("typed").alias("n_typed"), F.max("changed").alias("slots_changed")))
    share = lambda n, m: F.struct((F.col(n) / F.col(m)).alias("coverage"), F.col(n).alias("n_windows"), F.col(m).cast("long").alias("item_windows"))
    found = found.withColumn("best", F.when(F.col("typed_windows") > 0, F.greatest(share("n_all", "item_windows"), share("n_typed", "typed_windows"))).otherwise(share("n_all", "item_windows")))
    return (found.where(F.col("best.coverage") >= min_coverage)
            .select("k1", "k2", "doc_id", "item_id", "best.n_windows", "best.item_windows", "best.coverage", "slots_changed"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, a row for each pair."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("k1", "k2").distinct()
