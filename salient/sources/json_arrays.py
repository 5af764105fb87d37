"""Large JSON files whose records are the elements of one array, read by many tasks.

A JSON array has no line borders, so a file is cut into byte ranges and each
element is read by the task in whose range it begins.  Whether a byte stands
inside a string, and how deeply it is nested, depends on everything before it;
but a range changes that state in a way that can be found without knowing it: the
number of quotes decides about strings, and the brackets outside strings, for
either answer, about the depth.  A first pass over the ranges returns these
numbers, a second finds where the wanted array ends, a third emits its elements.
A task goes through its range piece by piece and keeps the places of quotes and
brackets of one piece, and the element that is not yet complete.
The driver holds a few numbers a range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.operators.scoring import filesystem
from salient.session import qualified

RANGE_BYTES = 32 << 20
#: Bytes of a range looked at together; a task holds a few times as much, whatever the range's size.
PIECE_BYTES = 1 << 20

#: What every byte does to the depth, outside strings.
STEP = np.zeros(256, np.int8)
STEP[[0x5B, 0x7B]], STEP[[0x5D, 0x7D]] = 1, -1


def _unescaped_quotes(data: np.ndarray, slashes: int) -> np.ndarray:
    """Places of the quotes that open or close a string; ``slashes`` backslashes stand before the data."""
    at = np.flatnonzero(data == 0x22)
    after = (at == 0) | (data[np.maximum(at - 1, 0)] == 0x5C)
    if not after.any():
        return at
    plain = np.flatnonzero(data != 0x5C)
    before = np.searchsorted(plain, at[after])
    last = np.where(before > 0, plain[np.maximum(before - 1, 0)], -1)
    keep = np.ones(len(at), bool)
    keep[after] = (at[after] - 1 - last + np.where(last < 0, slashes, 0)) % 2 == 0
    return at[keep]


def _slashes_before(file, at: int) -> int:
    """How many backslashes end just before a place."""
    n, step = 0, 64
    while at - n > 0:
        part = file.read_at(min(step, at - n), max(0, at - n - step))
        run = len(part) - len(part.rstrip(b"\\"))
        n += run
        if run < len(part):
            break
        step *= 16
    return n


def _pieces(file, start: int, end: int, size: int, more: int = 0) -> Iterator[tuple[int, bytes, bytes, np.ndarray]]:
    """(place, text, the text and up to ``more`` bytes after it, places of its quotes) of a stretch, piece by piece."""
    slashes = _slashes_before(file, start)
    while start < end:
        wide = file.read_at(min(start + size, end) - start + more, start)
        text = wide[:min(start + size, end) - start]
        if not text:
            return
        yield start, text, wide, _unescaped_quotes(np.frombuffer(text, np.uint8), slashes)
        run = len(text) - len(text.rstrip(b"\\"))
        slashes = run if run < len(text) else slashes + run
        start += len(text)


def _brackets(data: np.ndarray, quotes: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The brackets outside strings: their places, +1 or -1 each, and the depth after each (from 0 before the data)."""
    step = STEP[data]
    at = np.flatnonzero(step)
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    return at, step[at], np.cumsum(step[at], dtype=np.int64)


def _depths(at: np.ndarray, depth: np.ndarray, places) -> np.ndarray:
    """The depth at places, from the brackets at ``at`` and the depth after each."""
    return np.concatenate([[0], depth])[np.searchsorted(at, places, side="right")]


def _each(spark: SparkSession, ranges: list[tuple], schema: str, work) -> DataFrame:
    """``work(file, path, range row)`` on every range ``(path, start, end, ...)``, a task each.

    The ranges are dealt without a shuffle: after one, Spark takes the few bytes of the ranges for the size of what
    is read from them, and joins broadcast whole files through the driver.  So the size is unknown until the rows are shuffled.
    """
    dealt = spark.sparkContext.parallelize(ranges, max(1, len(ranges)))
    rows = spark.createDataFrame(dealt, "path string, size long, start long, end long, inside boolean, depth long, first long, last long")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                files, path = filesystem(r["path"])
                with files.open_input_file(path) as file:
                    yield from work(file, r)

    return rows.mapInArrow(run, schema)


def read_json_array(spark: SparkSession, path: str, schema: str, field: str | None = None, range_bytes: int = RANGE_BYTES,
                    piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The elements of the array in ``field`` of each file's object (or of the file's own top-level array) below ``path``.

    Columns are ``schema`` (of one element, a record), and ``file`` and ``place``, by which
    elements are in the file's order.  ``path`` is a file or a folder of files.
    A file without the field, or a null in its place, gives no rows; nested fields of that name do not
    count.  An element is read whole by one task.
    """
    root_uri = qualified(spark, path)
    files, root = filesystem(root_uri)
    info = files.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    listed = [info] if info.is_file else [f for f in files.get_file_info(pafs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", "."))]
    prefix = root_uri[:len(root_uri) - len(root)] if root_uri.endswith(root) else ""
    ranges = [(prefix + f.path, f.size, a, min(a + range_bytes, f.size), False, 0, -1, -1) for f in sorted(listed, key=lambda f: f.path) for a in range(0, f.size, range_bytes)]
    kind = f"file string, place long, {schema}"
    if not ranges:
        return spark.createDataFrame([], kind)
    key = re.compile(rb'"' + re.escape(field.encode()) + rb'"\s*:\s*\[') if field is not None else None

    def count(file, r):
        # both answers to whether the range begins inside a string; a name cut by a piece's end is read a little further
        deltas, places, depths, quotes = [0, 0], [[], []], [[], []], 0
        for start, text, wide, said in _pieces(file, r["start"], r["end"], piece_bytes, 0 if key is None else len(field) * 6 + 4096):
            data = np.frombuffer(text, np.uint8)
            names = [] if key is None else [(m.start(), start + m.end() - 1) for m in key.finditer(wide) if m.start() < len(text)]
            for begun in (0, 1):
                inside = (begun + quotes) % 2
                at, _, depth = _brackets(data, said, inside)
                for m, place in names:
                    if (int(np.searchsorted(said, m)) + inside) % 2 == 0:
                        places[begun].append(place)
                        depths[begun].append(deltas[begun] + int(_depths(at, depth, m)))
                deltas[begun] += int(depth[-1]) if len(depth) else 0
            quotes += len(said)
        yield pa.RecordBatch.from_pylist([{"path": r["path"], "start": r["start"], "quotes": quotes, "out": deltas[0], "in": deltas[1],
                                           "places": places, "depths": depths}],
                                         schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("out", pa.int64()), ("in", pa.int64()),
                                                           ("places", pa.list_(pa.list_(pa.int64()))), ("depths", pa.list_(pa.list_(pa.int64())))]))

    counted = _each(spark, ranges, "path string, start long, quotes long, out long, in long, places array<array<long>>, depths array<array<long>>", count).collect()
    begins: dict[str, int] = {}
    known, state = [], {}
    by_range = {(r["path"], r["start"]): r for r in counted}
    for name, size, a, b, *_ in ranges:
        inside, depth = state.get(name, (False, 0))
        r = by_range[(name, a)]
        known.append((name, size, a, b, inside, depth))
        for p, d in zip(r["places"][inside], r["depths"][inside]):
            if depth + d == 1:
                begins.setdefault(name, p)
        state[name] = ((inside + r["quotes"]) % 2 == 1, depth + r["in" if inside else "out"])
    if field is None:
        for f in listed:
            with files.open_input_file(f.path) as file:
                head = file.read_at(min(f.size, 4096), 0)
            lead = len(head) - len(head.lstrip())
            if head[lead:lead + 1] == b"[":
                begins[prefix + f.path] = lead
    level = 1 if field is None else 2  # depth inside the array
    ranges = [(*k, begins[k[0]], -1) for k in known if k[0] in begins and k[3] > begins[k[0]]]
    if not ranges:
        return spark.createDataFrame([], kind)

    def close(file, r):
        inside, deep, found = r["inside"], r["depth"], []
        for start, text, _, said in _pieces(file, r["start"], r["end"], piece_bytes):
            at, step, depth = _brackets(np.frombuffer(text, np.uint8), said, inside)
            ends = at[(deep + depth < level) & (step < 0) & (at + start > r["first"])]
            if len(ends):
                found = [{"path": r["path"], "last": start + int(ends[0])}]
                break
            inside, deep = (inside + len(said)) % 2, deep + (int(depth[-1]) if len(depth) else 0)
        yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("path", pa.string()), ("last", pa.int64())]))

    lasts = {r["path"]: r["last"] for r in _each(spark, ranges, "path string, last long", close).groupBy("path").agg(F.min("last").alias("last")).collect()}
    ranges = [(*r[:7], lasts.get(r[0], r[1])) for r in ranges if r[2] < lasts.get(r[0], r[1])]

    def elements(file, r):
        end = min(r["end"], r["last"])
        inside, deep = r["inside"], r["depth"]
        begun, held = None, []  # the element that is still open: its place, and the parts of its text so far

        def batch(found):
            found = [(p, t.decode("utf-8")) for p, t in found if t]
            return pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(found), pa.string()), pa.array([p for p, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], ["file", "place", "json"])

        for start, text, _, said in _pieces(file, r["start"], r["last"], piece_bytes):  # read on until the last element that begins here is complete
            data = np.frombuffer(text, np.uint8)
            at, _, depth = _brackets(data, said, inside)
            commas = np.flatnonzero(data == 0x2C)
            commas = commas[(commas + start > r["first"]) & ((np.searchsorted(said, commas) + inside) % 2 == 0)]
            cuts = commas[deep + _depths(at, depth, commas) == level]
            if start <= r["first"] < start + len(text):
                cuts = np.concatenate([[r["first"] - start], cuts])
            inside, deep = (inside + len(said)) % 2, deep + (int(depth[-1]) if len(depth) else 0)
            if not len(cuts):
                if begun is not None:
                    held.append(text)
                elif start + len(text) >= end:
                    return
                continue
            cuts = cuts.tolist()
            found = [] if begun is None else [(begun, b"".join([*held, text[:cuts[0]]]).strip())]
            found += [(start + a, text[a + 1:b].strip()) for a, b in zip(cuts, cuts[1:]) if start + a < end]
            yield batch(found)
            if start + cuts[-1] >= end:
                return
            begun, held = start + cuts[-1], [text[cuts[-1] + 1:]]
        if begun is not None:
            yield batch([(begun, b"".join(held).strip())])

    texts = _each(spark, ranges, "file string, place long, json string", elements)
    return texts.select("file", "place", F.from_json("json", schema).alias("e")).select("file", "place", "e.*")
