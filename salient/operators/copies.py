"""Perturbed copies of samples, made and scored where the sample's row is.

A design ``Z`` (draws x cells, keep values) belongs to the parameters, not to the data.  It is
written once to the shared folder; each task reads it and works through its
Arrow batches of samples without a shuffle.  Two scorers:

* :class:`LinearCopies` (S2, R2) makes no copies.  The logits of copy k relative to
  the target class are ``r0 + sum_cell (1 - Z[k, cell]) C[cell]`` with
  ``C[cell, c] = sum_{pos in cell} (w[c, pos] - w[t, pos]) (ref[pos] - x[pos])``:
  one blocked matrix product of the design and the sample's contributions.
  Weights are read in tiles of positions.
* :class:`BatchCopies` (S3) builds the copies ``x m + ref (1 - m)`` and calls any
  batch function on them.

Either way at most ``VALUES`` doubles are held at once, whatever the numbers
of samples, draws and positions; only a sample's scores (one number a draw)
stay until the estimator has used them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salient.functions.arrays import to_array
from salient.operators.masking import Shape, max_perturbed
from salient.operators.scoring import LinearSoftmaxModel, filesystem
from salient.session import scratch_path

#: Doubles of copies, logits or contributions held at once (8 MB; a step holds several such arrays).
VALUES = 1 << 20
#: Doubles of a table that a worker keeps; a larger one is read again for each batch.
KEEP = 1 << 23


class SharedRows:
    """Rows ``(idx, v ARRAY<DOUBLE>)`` in the shared folder, read by tasks as a matrix or in tiles."""

    def __init__(self, df: DataFrame, name: str):
        self.path = scratch_path(df.sparkSession, name)
        df.select(F.col("idx").cast("int"), F.col("v").cast("array<double>")).write.parquet(self.path)
        self._kept = None

    def __getstate__(self):
        return {"path": self.path, "_kept": None}

    def tiles(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, rows) part by part."""
        if self._kept is not None:
            yield from self._kept
            return
        files, root = filesystem(self.path)
        held, size = [], 0
        for batch in ds.dataset(root, filesystem=files, format="parquet", exclude_invalid_files=True).to_batches(batch_size=4096):
            if batch.num_rows:
                tile = batch.column("idx").to_numpy(), rows_of(batch.column("v"))
                size += tile[1].size
                if size <= KEEP:
                    held.append(tile)
                yield tile
        if size <= KEEP:
            self._kept = held

    def matrix(self) -> np.ndarray:
        parts = list(self.tiles())
        idx = np.concatenate([i for i, _ in parts])
        return np.concatenate([v for _, v in parts])[np.argsort(idx, kind="stable")]


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n and len(flat) % n or n and (np.diff(column.offsets.to_numpy()) != len(flat) // n).any():
        raise ValueError("all arrays of a column must have one length")
    return flat.reshape(n, len(flat) // n if n else 0)


def design_rows(design: DataFrame, name: str = "design") -> SharedRows:
    """A design ``(draw, cell, m)`` as one row a draw."""
    return SharedRows(to_array(design, "m", "v", keys=("draw",), pos_col="cell").withColumnRenamed("draw", "idx"), name)


# --- scorers ------------------------------------------------------------------------

class LinearCopies:
    """Scores of copies for the linear-softmax model, from cell contributions."""

    def __init__(self, model: LinearSoftmaxModel):
        self.weights = SharedRows(to_array(model._W, "w", "v", keys=("pos",), pos_col="cls").withColumnRenamed("pos", "idx"), "weights")
        self.classes = model.n_classes

    def rows_at_once(self, d: int, cells: int, draws: int) -> int:
        return max(1, VALUES // (self.classes * max(cells, 1) + 2 * d + draws))

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(n, c): class logits of the inputs."""
        out = np.zeros((len(x), self.classes))
        for pos, w in self.weights.tiles():
            out += x[:, pos] @ w
        return out

    def contributions(self, x: np.ndarray, ref: np.ndarray, target: np.ndarray, cells: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Clean logits (n, c) and cell contributions (n, cells, c), relative to the target class."""
        n, c = len(x), self.classes
        base, out = np.zeros((n, c)), np.zeros((n, dims, c))
        for pos, w in self.weights.tiles():
            base += x[:, pos] @ w
            change = (ref - x)[:, pos]
            order = np.argsort(cells[pos], kind="stable")
            own = cells[pos][order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for a in range(0, n, max(1, VALUES // max(1, len(pos) * c))):
                part = slice(a, a + max(1, VALUES // max(1, len(pos) * c)))
                out[part, own[first]] += np.add.reduceat(change[part][:, order, None] * w[order], first, axis=1)
        at = np.arange(n)
        return base - base[at, target][:, None], out - out[at, :, target][:, :, None]

    def scores(self, x: np.ndarray, ref: np.ndarray, target: np.ndarray, z: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """(n, draws): probability of the target class of every copy."""
        base, own = self.contributions(x, ref, target, cells, z.shape[1])
        out = np.empty((len(x), len(z)))
        step = max(1, VALUES // max(1, len(x) * self.classes))
        for a in range(0, len(z), step):
            r = np.matmul(1.0 - z[a:a + step], own) + base[:, None, :]
            with np.errstate(over="ignore"):
                out[:, a:a + step] = 1.0 / np.exp(r).sum(2)  # the target's own term is 1
        return out


class BatchCopies:
    """Scores of copies for any batch function ``fn(X[n, d]) -> probabilities[n, classes]``."""

    def __init__(self, fn: Callable[[np.ndarray], np.ndarray]):
        self.fn = fn

    def rows_at_once(self, d: int, cells: int, draws: int) -> int:
        return max(1, VALUES // (2 * d + draws))

    def of(self, copies: np.ndarray, target: np.ndarray) -> np.ndarray:
        return np.asarray(self.fn(copies), dtype=np.float64)[np.arange(len(copies)), target]

    def scores(self, x: np.ndarray, ref: np.ndarray, target: np.ndarray, z: np.ndarray, cells: np.ndarray) -> np.ndarray:
        n, d = x.shape
        out = np.empty((n, len(z)))
        step = max(1, VALUES // max(1, d))
        for a in range(0, n * len(z), step):  # copies in order of sample, then draw
            flat = np.arange(a, min(a + step, n * len(z)))
            i, k = flat // len(z), flat % len(z)
            m = z[k][:, cells]
            out.reshape(-1)[flat] = self.of(x[i] * m + ref[i] * (1.0 - m), target[i])
        return out


def scorer_of(model) -> "LinearCopies | BatchCopies":
    """The copy scorer of a linear-softmax model or of a batch function."""
    return LinearCopies(model) if isinstance(model, LinearSoftmaxModel) else BatchCopies(model)


# --- cells and replacements ---------------------------------------------------------

def grid_cells(shape: Shape, grid: int) -> np.ndarray:
    """The g x g cell of every position (nearest expansion; channels share their pixel's cell)."""
    row = np.floor((np.arange(shape.h) + 0.5) * grid / shape.h).astype(int)
    col = np.floor((np.arange(shape.w) + 0.5) * grid / shape.w).astype(int)
    return np.repeat((row[:, None] * grid + col).reshape(-1), shape.c)


def blurred(x: np.ndarray, shape: Shape) -> np.ndarray:
    """3x3 box mean of every sample, clipped at the border, per channel."""
    v = x.reshape(-1, shape.h, shape.w, shape.c)

    def sums(a: np.ndarray) -> np.ndarray:
        for axis in (1, 2):
            wide = np.concatenate([np.zeros_like(a.take([0], axis)), a, np.zeros_like(a.take([0], axis))], axis)
            size = a.shape[axis]
            a = sum(wide.take(range(k, k + size), axis) for k in range(3))
        return a

    return (sums(v) / sums(np.ones_like(v))).reshape(x.shape)


# --- running ------------------------------------------------------------------------

#: ``estimate(scores, clean, row)`` -> (n, width): from the scores of all draws and of the input itself.
Estimate = Callable[[np.ndarray, np.ndarray, "Block"], np.ndarray]


class Block:
    """Some samples of a batch: inputs, replacement values, targets, the cell of each position, the design, and a map if there is one."""

    def __init__(self, x, ref, target, cells, z, e=None):
        self.x, self.ref, self.target, self.cells, self.z, self.e = x, ref, target, cells, z, e

    def per_cell(self, values: np.ndarray) -> np.ndarray:
        """(n, cells): values of the positions of each cell added up."""
        out = np.zeros((len(values), self.z.shape[1]))
        order = np.argsort(self.cells, kind="stable")
        own = self.cells[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[:, own[first]] = np.add.reduceat(values[:, order], first, axis=1)
        return out


def estimate_rows(rows: DataFrame, model, design: SharedRows, estimate: Estimate, cells: np.ndarray | None,
                  replacement: float | Callable[[np.ndarray], np.ndarray] = 0.0, name: str = "e") -> DataFrame:
    """``(sample_id, name ARRAY<DOUBLE>)``: ``estimate`` on the scores of every sample's copies; NaN becomes null.

    ``rows`` is ``(sample_id, x, target[, e][, cells])``.  ``cells`` gives the cell
    of every position; where it is None each row's own ``cells`` column does, and
    the sample uses the design's first as many columns as it has cells.
    Where a cell is dropped a copy takes the row's ``ref`` array, if there is that
    column, else ``replacement``: a number, or a function of a batch of inputs.
    """
    scorer = scorer_of(model)
    own, maps, refs = cells is None, "e" in rows.columns, "ref" in rows.columns
    names = ["sample_id", "x", "target"] + ["e"] * maps + ["cells"] * own + ["ref"] * refs
    schema = T.StructType([rows.schema["sample_id"], T.StructField(name, T.ArrayType(T.DoubleType()))])

    def block(batch: pa.RecordBatch, a: int, b: int, z: np.ndarray) -> Block:
        part = batch.slice(a, b - a)
        x = rows_of(part.column("x")).astype(np.float64)
        at = rows_of(part.column("cells"))[0].astype(np.int64) if own else cells
        if own:
            z = z[:, :int(at.max()) + 1]
        if len(at) != x.shape[1]:
            raise ValueError(f"{len(at)} cells for {x.shape[1]} positions")
        ref = rows_of(part.column("ref")).astype(np.float64) if refs else replacement(x) if callable(replacement) else np.full(x.shape, float(replacement))
        return Block(x, ref, part.column("target").to_numpy().astype(np.int64), at, z, rows_of(part.column("e")).astype(np.float64) if maps else None)

    def run(batches):
        z = None
        for batch in batches:
            if not batch.num_rows:
                continue
            z = design.matrix() if z is None else z
            d = len(batch.column("x")[0])
            step = 1 if own else scorer.rows_at_once(d, z.shape[1], len(z))
            for a in range(0, batch.num_rows, step):
                b = min(a + step, batch.num_rows)
                rows_in = block(batch, a, b, z)
                ones = np.ones((1, rows_in.z.shape[1]))
                clean = scorer.scores(rows_in.x, rows_in.ref, rows_in.target, ones, rows_in.cells)[:, 0]
                y = scorer.scores(rows_in.x, rows_in.ref, rows_in.target, rows_in.z, rows_in.cells)
                out = np.ascontiguousarray(estimate(y, clean, rows_in), dtype=np.float64)
                values = pa.array(out.reshape(-1), from_pandas=True)  # NaN: null
                offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("sample_id").slice(a, b - a), pa.ListArray.from_arrays(offsets, values)], ["sample_id", name])

    return rows.select(*names).mapInArrow(run, schema)


def path_scores(rows: DataFrame, fn, mode: str, steps: int, max_pct: float = 1.0, baseline: float = 0.0, channels: int = 1) -> DataFrame:
    """D4 + S3: ``(sample_id, ys ARRAY<DOUBLE>)``: scores along the ranked path of each sample.

    ``rows`` is ``(sample_id, x, target, e[, ref])`` with one map value a pixel.
    Pixels rank by falling map value, ties by position; at step k those of rank up to
    ``k (m - 1) div (steps - 1)`` are switched, m being the share of pixels
    that may change: deletion writes the baseline (``ref`` where there is that column) over them, insertion restores them.
    """
    if mode not in ("insertion", "deletion"):
        raise ValueError(f"unknown causal mode {mode!r}: use 'deletion' or 'insertion'")
    if steps < 2:
        raise ValueError("nb_steps must be >= 2")
    max_perturbed(1, max_pct)
    scorer, refs = BatchCopies(fn), "ref" in rows.columns
    schema = T.StructType([rows.schema["sample_id"], T.StructField("ys", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, e = rows_of(batch.column("x")).astype(np.float64), rows_of(batch.column("e")).astype(np.float64)
            ref = rows_of(batch.column("ref")).astype(np.float64) if refs else np.full(x.shape, float(baseline))
            target = batch.column("target").to_numpy().astype(np.int64)
            limits = np.arange(steps) * (max_perturbed(e.shape[1], max_pct) - 1) // (steps - 1)
            order = np.argsort(-e, axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(e.shape[1])[None, :], axis=1)
            rank = np.repeat(rank, channels, axis=1)
            on, off = (ref, x) if mode == "deletion" else (x, ref)
            out = np.empty((len(x), steps))
            part = max(1, VALUES // max(1, x.shape[1]))
            for a in range(0, out.size, part):
                flat = np.arange(a, min(a + part, out.size))
                i, k = flat // steps, flat % steps
                out.reshape(-1)[flat] = scorer.of(np.where(rank[i] <= limits[k][:, None], on[i], off[i]), target[i])
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * steps, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))], ["sample_id", "ys"])

    return rows.select("sample_id", "x", "target", "e", *["ref"] * refs).mapInArrow(run, schema)
