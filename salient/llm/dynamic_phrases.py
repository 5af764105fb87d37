"""Phrase collocations by dynamic itemset counting.

The documents are dealt into shards that are scanned in a cycle.  Words are
counted from the first shard on; a longer phrase becomes active at the step
after both its subphrases (all but its last word, all but its first) have
reached the threshold in the counts so far, whatever the shard, and is counted
until the scan comes round to the shard where it started.  Lengths thus
interleave: phrases of three words are usually counted before the words'
own cycle has ended.

What has reached the threshold is kept as a table of slots, one byte each: the
step at which a phrase that hashes there first reached it.  Every task derives
the step at which a phrase starts from the slots alone, so all tasks agree and
each phrase is counted in exactly one full cycle.  Two phrases that share their
slots only make one of them start early.  Running counts are kept by hash, as
arrays in the shared folder; the phrases that came to the threshold are at last
counted by their own texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salient.llm.common import arrow_bytes, filesystem, mix, prepare, text_or_empty, written
from salient.session import drop_scratch, scratch_path

_U = np.uint64
SHARDS = 4
#: Bytes of text whose words are held as arrays at once.
_SEGMENT = 1 << 20
#: Slots for each reached length: one for each 64 bytes of text, within these bounds (a fuller table
#: only activates more phrases, it loses none).
MIN_SLOTS, MAX_SLOTS = 1 << 16, 1 << 27
_RANGES = 64
#: Text whose phrases' hashes make one range of sums, and sums that a task holds before it deals them out.
RANGE_BYTES, HELD = 16 << 20, 1 << 18
#: Groups of frequent texts for each range of hashes (a text takes more room than a hash).
TEXT_GROUPS = 4
_NEVER = 255

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_POWERS = np.cumprod(np.full(1 << 16, 0xD6E8FEB86659FD93, _U), dtype=_U)


# ---------------------------------------------------------------------------
# slots of reached phrases

def _word_hashes(words: pa.Array) -> np.ndarray:
    data, offsets = arrow_bytes(words)
    if not len(words):
        return np.zeros(0, _U)
    lo, size = offsets[:-1], np.diff(offsets)
    at = np.arange(offsets[0], offsets[-1]) - np.repeat(lo, size)
    weighed = (data[offsets[0]:offsets[-1]].astype(_U) + _U(1)) * _POWERS[at & 0xFFFF]
    return mix(np.add.reduceat(weighed, lo - offsets[0]))


def _phrase_hashes(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases, given the hashes of their languages and of their words."""
    h = langs + _U(len(words))
    for w in words:
        h = h * _U(0xA24BAED4963EE407) + w
    return mix(h)


def _slots(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of each hash."""
    return (h & _U(slots - 1)).astype(np.int64), ((h >> _U(32)) & _U(slots - 1)).astype(np.int64)


_LOADED: dict[str, np.ndarray] = {}


def _load(paths: list[str | None]) -> list[np.ndarray | None]:
    """The slots written at each of ``paths``; a worker keeps these and drops those of earlier steps."""
    for old in set(_LOADED) - set(paths):
        del _LOADED[old]
    for path in paths:
        if path is not None and path not in _LOADED:
            files, root = filesystem(path)
            table = pq.read_table(root, filesystem=files, columns=["part", "slots"])
            order = np.argsort(table.column("part").to_numpy())
            parts = table.column("slots")
            _LOADED[path] = np.concatenate([np.frombuffer(parts[int(i)].as_buffer(), np.uint8) for i in order])
    return [_LOADED.get(path) for path in paths]


def _write_slots(spark: SparkSession, reached: DataFrame, name: str, step: int, old: str | None, slots: int) -> str:
    """Slots of the ``reached`` hashes (h) set to ``step`` where they held none, written in ranges."""
    width = slots // _RANGES

    def spots(batches):
        for batch in batches:
            both = np.unique(np.concatenate(_slots(batch.column("h").to_numpy().view(_U), slots)))
            cuts = np.searchsorted(both, np.arange(_RANGES + 1) * width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(_RANGES), pa.int32()),
                 pa.array([(both[a:b] - i * width).astype(np.uint32).tobytes() for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))], pa.binary())],
                ["part", "at"])

    def fill(pdf):
        out = np.full(width, _NEVER, np.uint8)
        for at in pdf["at"]:
            out[np.frombuffer(at, np.uint32)] = step
        return pdf.iloc[:1].assign(at=out.tobytes())

    new = reached.mapInArrow(spots, "part int, at binary").groupBy("part").applyInPandas(fill, "part int, at binary").withColumnRenamed("at", "slots")
    if old is not None:
        before = spark.read.schema("part int, slots binary").parquet(old).withColumnRenamed("slots", "old")

        def earliest(batches):
            for batch in batches:
                rows = [np.minimum(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).tobytes() if a and b else (a or b)
                        for a, b in zip(batch.column("slots").to_pylist(), batch.column("old").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(rows, pa.binary())], ["part", "slots"])

        new = new.join(before, "part", "full").mapInArrow(earliest, "part int, slots binary")
    path = scratch_path(spark, f"phrase-slots-{name}")
    new.write.parquet(path)
    return path


# ---------------------------------------------------------------------------
# one scan

def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Runs of whole documents, and parts of long ones: (bytes, borders between documents, first document, words already counted).

    A long document is cut at a space or break; where no break stands there the next part begins
    with the last words before the cut, which only lengthen the phrases that end behind them.
    """
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SEGMENT, "right")) - 1)
        if j > i + 1 or offsets[j] - offsets[i] <= _SEGMENT:
            j = min(j, n)
            yield data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], i, 0
            i = j
            continue
        at, end, tail = int(offsets[i]), int(offsets[i + 1]), b""
        while at < end:
            stop = min(at + _SEGMENT, end)
            while stop < end and not (_SPACE[data[stop]] or _BREAK[data[stop]]):
                part = data[stop:stop + 65536]
                gaps = np.flatnonzero(_SPACE[part] | _BREAK[part])
                stop = min(end, stop + (int(gaps[0]) if len(gaps) else len(part)))
            seg = np.concatenate([np.frombuffer(tail, np.uint8), data[at:stop]])
            held = tail.count(b" ")
            yield seg, np.array([0, len(seg)]), i, held
            tail = _tail(seg)
            at = stop
        i += 1


def _tail(seg: np.ndarray, most: int = 8) -> bytes:
    """Last words of a part behind its last break, each followed by one space."""
    words, at = [], len(seg)
    while at and len(words) < most:
        end = at
        while end and _SPACE[seg[end - 1]]:
            end -= 1
        if not end or _BREAK[seg[end - 1]]:
            break
        start = end
        while start and not (_SPACE[seg[start - 1]] or _BREAK[seg[start - 1]]):
            start -= 1
        words.append(seg[start:end].tobytes())
        at = start
    return b"".join(w + b" " for w in reversed(words))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Each key's number among the distinct keys, and how many there are."""
    coded = pa.array(keys).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def _count(seg: np.ndarray, borders: np.ndarray, langs: pa.Array, held: int, most: int, reached: list[np.ndarray | None], step: int | None, shards: int) -> Iterator[tuple]:
    """The phrases of one segment; ``langs`` are its documents' languages.

    In a step: (length, hashes, counts) of the active phrases.  With ``step`` None:
    (length, texts, languages, counts, hashes) of those whose slots in ``reached`` say that
    they are frequent, and with length 0 the number of all words of each language.
    """
    low = _LOWER[seg]
    stop = _BREAK[low]
    word = ~(stop | _SPACE[low])
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    first = borders[:-1][np.diff(borders) > 0]
    begin[first] = word[first]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return
    doc = np.searchsorted(borders, starts, "right") - 1
    piece = np.cumsum(stop, dtype=np.int32)[starts]
    link = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
    bytes_before = np.concatenate([[0], np.cumsum(word)])
    offs = np.append(bytes_before[starts], bytes_before[-1]).astype(np.int64)
    flat = low[word]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(flat)]).dictionary_encode()
    code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    del low, stop, word, begin, bytes_before, flat
    coded = langs.dictionary_encode()
    lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
    lang_hash = _word_hashes(pc.binary_join_element_wise("", coded.dictionary, " "))  # never of an empty string
    name_hash = _word_hashes(names)

    if step is None:
        fresh = np.bincount(lang[np.arange(len(lang)) >= held], minlength=len(coded.dictionary))
        spoken = np.flatnonzero(fresh)
        yield 0, pa.array([""] * len(spoken)), coded.dictionary.take(pa.array(spoken)).cast(pa.string()), fresh[spoken], np.zeros(len(spoken), _U)

    # occurrences of the current length: place of the first word, number of the phrase
    at = np.arange(len(code))
    number, kinds = _numbered(lang * len(names) + code)
    active = np.full(len(at), step is not None and step < shards)
    for n in range(1, most + 1):
        rep = np.zeros(kinds, np.int64)
        rep[number[::-1]] = at[::-1]
        h = _phrase_hashes(lang_hash[lang[rep]], [name_hash[code[rep + j]] for j in range(n)])
        slots = reached[n - 1] if n <= len(reached) else None
        if slots is not None:
            a, b = _slots(h, len(slots))
            first_at = np.maximum(slots[a], slots[b]).astype(np.int64)
        if step is None:
            if slots is None:
                return
            active = (first_at < _NEVER)[number]
        found = np.bincount(number[active & (at + n > held)], minlength=kinds)
        some = np.flatnonzero(found)
        if len(some) and step is not None:
            yield n, h[some], found[some]
        elif len(some):
            parts = [names.take(pa.array(code[rep[some] + j])) for j in range(n)]
            phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
            yield n, phrase.cast(pa.string()), coded.dictionary.take(pa.array(lang[rep[some]])).cast(pa.string()), found[some], h[some]
        if n == most or slots is None:
            return
        when = first_at[number]
        keep = when < _NEVER
        at, number, when = at[keep], number[keep], when[keep]
        if len(at) < 2:
            return
        # an occurrence and the one a word further on make one that is a word longer
        pair = (at[1:] == at[:-1] + 1) & link[np.minimum(at[:-1] + n - 1, len(link) - 1)]
        left = np.flatnonzero(pair)
        if not len(left):
            return
        start = np.maximum(when[left], when[left + 1]) + 1
        kept = at[left]
        number, kinds = _numbered(number[left] * len(names) + code[kept + n])
        at = kept
        if step is not None:
            active = (start <= step) & (step < start + shards)


def _kind(most: int):
    """The smallest type of counts up to ``most``."""
    return np.min_scalar_type(most)


def _merged(h: list[np.ndarray], c: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and the sums of their counts, up to ``most``."""
    keys, place = np.unique(np.concatenate(h), return_inverse=True)
    return keys, np.minimum(np.bincount(place, weights=np.concatenate(c), minlength=len(keys)), most).astype(_kind(most))


def _scan(shard: DataFrame, step: int, most: int, paths: list[str | None], shards: int, ranges: int, threshold: int) -> DataFrame:
    """(n, part, h, c): counts of the phrases active in this step over one shard, by hash, as arrays of a range of hashes."""
    bounds = np.arange(1, ranges, dtype=_U) * _U((1 << 64) // ranges)

    def run(batches):
        reached = _load(paths)
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def flush():
            for n, (h, c) in held.items():
                h, c = _merged(h, c, threshold)
                cuts = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
                spans = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([n] * len(spans), pa.int32()), pa.array([i for i, _, _ in spans], pa.int32()),
                    pa.array([h[a:b].tobytes() for _, a, b in spans], pa.binary()), pa.array([c[a:b].tobytes() for _, a, b in spans], pa.binary())], ["n", "part", "h", "c"])
            held.clear()

        for batch in batches:
            data, offsets = arrow_bytes(batch.column("text"))
            langs = batch.column("lang")
            for seg, borders, i, old in _segments(data, offsets):
                for n, h, c in _count(seg, borders, langs.slice(i, len(borders) - 1), old, most, reached, step, shards):
                    hs, cs = held.setdefault(n, ([], []))
                    hs.append(h)
                    cs.append(c)
                    size += len(h)
                if size > HELD:
                    yield from flush()
                    size = 0
            pa.default_memory_pool().release_unused()
        yield from flush()
        pa.default_memory_pool().release_unused()

    return shard.mapInArrow(run, "n int, part int, h binary, c binary")


def _packed(table: pa.Table) -> bytes:
    """A table as compressed bytes of the Arrow stream format."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


_STATE = "h binary, c binary, reached binary, n int, part int"


def _add(rows: DataFrame, old: str | None, threshold: int, path: str) -> DataFrame:
    """Sums by hash so far, one row of arrays a length and range, written to ``path``; ``reached``: the hashes that reach the threshold now.

    The sums so far are read where they are merged and not shuffled again.  A range's arrays are of
    bounded size, since the number of ranges follows the input.
    """
    kind = _kind(threshold)

    def merge(table: pa.Table) -> pa.Table:
        n, part = table.column("n")[0].as_py(), table.column("part")[0].as_py()
        h0, c0 = np.zeros(0, _U), np.zeros(0, kind)
        if old is not None:
            files, root = filesystem(f"{old}/n={n}/part={part}")
            for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.path.endswith(".parquet"):
                    held = pq.ParquetFile(files.open_input_file(f.path)).read(columns=["h", "c"])
                    h0, c0 = np.frombuffer(held.column("h")[0].as_buffer(), _U), np.frombuffer(held.column("c")[0].as_buffer(), kind)
        h, c = _merged([h0, *(np.frombuffer(x.as_buffer(), _U) for x in table.column("h"))], [c0, *(np.frombuffer(x.as_buffer(), kind) for x in table.column("c"))], threshold)
        before = np.zeros(len(h), kind)
        before[np.searchsorted(h, h0)] = c0
        now = h[(c >= threshold) & (before < threshold)]
        return pa.table({"h": pa.array([h.tobytes()], pa.binary()), "c": pa.array([c.tobytes()], pa.binary()), "reached": pa.array([now.tobytes()], pa.binary()),
                         "n": pa.array([n], pa.int32()), "part": pa.array([part], pa.int32())})

    merged = rows.groupBy("n", "part").applyInArrow(merge, _STATE)
    merged.write.partitionBy("n", "part").parquet(path)
    return rows.sparkSession.read.schema(_STATE).parquet(path)


def _hashes(state: DataFrame, n: int) -> DataFrame:
    """(h): the hashes of length ``n`` that reached the threshold in the last step."""
    def run(batches):
        for batch in batches:
            for r in batch.column("reached"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r.as_buffer(), np.int64))], ["h"])

    return state.where(F.col("n") == n).select("reached").mapInArrow(run, "h long")


def phrase_counts(docs: DataFrame, most: int = 3, threshold: int = 10, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """((len, lang, phrase, cnt) of all phrases of 1 to ``most`` words that occur ``threshold`` times or more; (lang, n) of all words).

    Needs ``text`` and ``lang``; null texts are empty, null languages ``und``;
    repeated rows count each; other columns are not read.  An empty table gives
    no rows.  While the shards are scanned phrases are summed by hash; what
    came to the threshold is then counted by its own text, so that phrases of one hash
    are told apart and counts are exact.  Memory of a task: arrays of 1 MB of text,
    the slots (at most ``most`` times ``MAX_SLOTS`` bytes), ``HELD`` sums, and the sums of one range of hashes.
    """
    if not 2 <= most <= 8 or shards < 1 or most * shards >= _NEVER:
        raise ValueError("phrases of 2 to 8 words, and fewer than 255 steps")
    spark = docs.sparkSession
    prepare(spark)
    key = [F.col("doc_id")] if "doc_id" in docs.columns else []
    dealt = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"),
                        F.pmod(F.xxhash64("text", *key), F.lit(shards)).cast("int").alias("shard"))
    path = scratch_path(spark, "phrase-shards")
    dealt.write.partitionBy("shard").parquet(path)
    all_rows = spark.read.schema("lang string, text string, shard int").parquet(path)
    size = all_rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(MAX_SLOTS, max(MIN_SLOTS, 1 << int(size // 64).bit_length()))

    ranges = max(2 * spark.sparkContext.defaultParallelism, int(size // RANGE_BYTES))
    paths: list[str | None] = [None] * most
    state = None
    step, last = 0, shards - 1
    while step <= last:
        shard = all_rows.where(F.col("shard") == step % shards).select("lang", "text")
        # phrases of n words are counted from step n - 1 to step n * shards - 1; an empty row a range keeps its sums
        lengths = [n for n in range(1, most + 1) if n - 1 <= step < n * shards]
        none = (spark.range(len(lengths) * ranges)
                .select(F.array(*map(F.lit, lengths))[(F.col("id") / ranges).cast("int")].alias("n"), (F.col("id") % ranges).cast("int").alias("part"),
                        F.lit(b"").alias("h"), F.lit(b"").alias("c")))
        rows = _scan(shard, step, most, paths[:most - 1], shards, ranges, threshold).unionByName(none)
        now = scratch_path(spark, f"phrase-sums-{step}")
        sums = _add(rows, state, threshold, now)
        for n in sorted(r["n"] for r in sums.where(F.length("reached") > 0).select("n").distinct().collect()):
            paths[n - 1] = _write_slots(spark, _hashes(sums, n), f"{n}-{step}", step, paths[n - 1], slots)
            if n < most:
                last = max(last, step + shards)  # what they activate starts at the next step
        if state is not None:
            drop_scratch(spark, state)
        state = now
        step += 1

    groups = TEXT_GROUPS * ranges
    bounds = np.arange(1, groups, dtype=_U) * _U((1 << 64) // groups)
    key = ["len", "lang", "phrase"]

    def texts(batches):
        held = _load(paths)
        found: list[pa.Table] = []

        def dealt():
            table = pa.concat_tables(found).group_by([*key, "h"]).aggregate([("cnt", "sum")]).rename_columns([*key, "h", "cnt"])
            found.clear()
            part = np.searchsorted(bounds, table.column("h").to_numpy(), "right")
            order = np.argsort(part, kind="stable")
            table = table.drop_columns(["h"]).take(pa.array(order))
            cuts = np.searchsorted(part[order], np.arange(groups + 1))
            spans = [(i, x, y) for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in spans], pa.int32()), pa.array([_packed(table.slice(x, y - x)) for _, x, y in spans], pa.binary())], ["part", "rows"])

        for batch in batches:
            data, offsets = arrow_bytes(batch.column("text"))
            langs = batch.column("lang")
            for seg, borders, i, old in _segments(data, offsets):
                for n, phrase, lang, count, h in _count(seg, borders, langs.slice(i, len(borders) - 1), old, most, held, None, shards):
                    found.append(pa.table([pa.array(np.full(len(count), n, np.int32)), lang, phrase, pa.array(count.astype(np.int64)), pa.array(h)], [*key, "cnt", "h"]))
                if sum(t.num_rows for t in found) > HELD:
                    yield from dealt()
            pa.default_memory_pool().release_unused()
        if found:
            yield from dealt()
        pa.default_memory_pool().release_unused()

    def whole(table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([pa.ipc.open_stream(r.as_buffer()).read_all() for r in table.column("rows")])
        rows = rows.group_by(key).aggregate([("cnt", "sum")]).rename_columns([*key, "cnt"])
        pa.default_memory_pool().release_unused()
        return rows.filter(pc.or_(pc.greater_equal(rows.column("cnt"), threshold), pc.equal(rows.column("len"), 0)))

    # the frequent phrases' texts, counted once more by the texts themselves, in ranges of hashes; length 0: all words of a language
    found = all_rows.select("lang", "text").mapInArrow(texts, "part int, rows binary")
    counts = written(found.groupBy("part").applyInArrow(whole, "len int, lang string, phrase string, cnt long"), "phrases-frequent")
    for used in (state, path):
        drop_scratch(spark, used)
    return counts.where("len > 0"), counts.where("len = 0").select("lang", F.col("cnt").alias("n"))


def collocations(docs: DataFrame, most: int = 3, threshold: int = 10, share: int = 50, top: int = 2000, shards: int = SHARDS) -> DataFrame:
    """Each language's ``top`` collocations (lang, rank, phrase, a, l, r, n, score).

    Words are runs of bytes other than space and tab (A-Z lower-cased) within
    pieces between the bytes ``. , ; : ! ?`` and 0x0A-0x0D.  A candidate has 2 to
    ``most`` words and ``threshold`` or more occurrences ``a``; cut after its
    first k words it scores floor(1000000 a a / (l r)), and its lowest-scoring
    cut counts (ties: smallest k).  Candidates inside a longer candidate of at
    least ``share`` % of their occurrences are dropped.  Ties of score and count
    are broken by the phrase's bytes.  Rows as in ``phrase_counts``.
    """
    frequent, totals = phrase_counts(docs, most, threshold, shards)
    words = F.split("phrase", " ")
    cand = frequent.where("len >= 2").select("lang", "phrase", F.col("cnt").alias("a"), "len", words.alias("w"))

    cut = cand.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("head"),
                     F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("rest"))
    part = frequent.select("lang", F.col("phrase").alias("part"), "cnt")
    cut = (cut.join(part.select("lang", F.col("part").alias("head"), F.col("cnt").alias("l")), ["lang", "head"])
           .join(part.select("lang", F.col("part").alias("rest"), F.col("cnt").alias("r")), ["lang", "rest"]))
    big = "cast({} as decimal(19, 0))"
    score = F.expr(f"(cast(1000000 as decimal(38, 0)) * {big.format('a')} * {big.format('a')}) div ({big.format('l')} * {big.format('r')})")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("b"))

    # phrases that stand inside a longer candidate, with its largest count
    inner = cand.where("len > 2").select("lang", "a", "w", F.explode(F.expr("sequence(2, size(w) - 1)")).alias("m"))
    inner = inner.select("lang", "a", F.explode(F.expr("transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {int(share)} * a"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))


def op12_dynamic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of ``documents``: phrases of 2 to 3 words, 10 occurrences or more."""
    prepare(spark)
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS m))),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS cnt FROM g GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(cnt) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, cnt AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND cnt >= 10),
cuts AS MATERIALIZED (
  SELECT lang, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM c
  UNION ALL SELECT lang, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM c WHERE m = 3),
heads AS MATERIALIZED (SELECT cuts.*, f.cnt AS l FROM cuts JOIN f ON f.lang = cuts.lang AND f.phrase = cuts.head),
cut AS (
  SELECT heads.lang, heads.phrase, heads.a, heads.k, heads.l, f.cnt AS r,
         (1000000::HUGEINT * heads.a * heads.a) // (heads.l::HUGEINT * f.cnt) AS score
  FROM heads JOIN f ON f.lang = heads.lang AND f.phrase = heads.rest),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM cut),
longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE m = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE m = 3) GROUP BY ALL),
k AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN longer USING (lang, phrase)
  WHERE b.pick = 1 AND (longer IS NULL OR 100 * longer < 50 * b.a))
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, tot.n, CAST(k.score AS BIGINT) AS score
FROM k JOIN tot USING (lang) WHERE k.rank <= 2000
"""
