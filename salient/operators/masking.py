"""Baselines, ranks, step schedules, cells and resizes.

Shapes are operator parameters: an ``(H, W, C)`` input is flattened
row-major, pixel ``pix = r*W + c`` and position ``pos = pix*C + ch``.
Parameter tables here (steps, cells, patches, resize weights) depend only on
the shape and the settings, never on the data, so they are small and broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    h: int
    w: int
    c: int = 1

    @property
    def pixels(self) -> int:
        return self.h * self.w

    @property
    def size(self) -> int:
        return self.h * self.w * self.c


# --- D1 baselines ------------------------------------------------------------

def baseline_value(baseline, x: Column | None = None) -> Column:
    """Constant baseline (default 0.0) or a Column expression of the input value."""
    if baseline is None:
        return F.lit(0.0)
    if isinstance(baseline, (int, float)):
        return F.lit(float(baseline))
    if callable(baseline):
        return baseline(x)
    return baseline


# --- D3 ranks ----------------------------------------------------------------

def rank_positions(maps: DataFrame, value: str = "e", pos: str = "pix", keys=("sample_id",)) -> DataFrame:
    """D3: 0-based ordinal rank, high to low; ties broken by position ascending."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(pos).asc())
    return maps.withColumn("rank", F.row_number().over(w) - 1)


# --- D4 step schedule --------------------------------------------------------

def max_perturbed(n_features: int, max_pct: float) -> int:
    if not 0.0 < max_pct <= 1.0:
        raise ValueError(f"max_pct is a share above 0 and up to 1, not {max_pct}")
    return int(math.floor(n_features * max_pct))


def step_thresholds(spark: SparkSession, n_features: int, steps: int, max_pct: float = 1.0) -> DataFrame:
    """``(k, t)``: step k perturbs positions with ``rank <= t``.

    Steps are ``linspace(0, max_n - 1, S)``; only their floor matters, so the
    integer form ``k * (max_n - 1) div (S - 1)`` is used.
    """
    if steps < 2:
        raise ValueError("nb_steps must be >= 2")
    max_n = max_perturbed(n_features, max_pct)
    return F.broadcast(spark.range(steps).select(
        F.col("id").cast("int").alias("k"),
        F.expr(f"cast(div(id * {max_n - 1}, {steps - 1}) as int)").alias("t")))


# --- D12 / D13 cells -----------------------------------------------------------

def grid_cell(pix: Column, shape: Shape, grid: int) -> Column:
    """D13 nearest expansion: the g x g cell of a pixel, ``floor((r + 0.5) * g / H)``."""
    r = (pix / F.lit(shape.w)).cast("int")
    c = pix % F.lit(shape.w)
    cr = F.floor((r + F.lit(0.5)) * F.lit(grid) / F.lit(shape.h)).cast("int")
    cc = F.floor((c + F.lit(0.5)) * F.lit(grid) / F.lit(shape.w)).cast("int")
    return cr * F.lit(grid) + cc


def segment_map(spark: SparkSession, shape: Shape, kind: str = "grid", grid: int | None = None) -> DataFrame:
    """``(pos, cell)`` for every input position.

    ``identity`` — one feature per pixel (tabular and time-series maps);
    ``grid``     — a g x g square grid of super-pixels (nearest expansion).
    Channels of a pixel share the pixel's cell.
    """
    pos = spark.range(shape.size).select(F.col("id").cast("int").alias("pos"))
    pix = (F.col("pos") / F.lit(shape.c)).cast("int")
    if kind == "identity":
        cell = pix
    elif kind == "grid":
        cell = grid_cell(pix, shape, grid or shape.h)
    else:
        raise ValueError(f"unknown segment kind {kind!r}")
    return F.broadcast(pos.select("pos", cell.alias("cell")))


def patch_positions(spark: SparkSession, shape: Shape, patch: int, stride: int) -> DataFrame:
    """E7 helper: ``(patch_id, pos)`` for sliding square patches fully inside the map."""
    rows = [i for i in range(0, shape.h - patch + 1, stride)]
    cols = [j for j in range(0, shape.w - patch + 1, stride)]
    n_c = len(cols)
    p = spark.range(len(rows) * n_c).select(F.col("id").cast("int").alias("patch_id"))
    r0 = (F.col("patch_id") / F.lit(n_c)).cast("int") * F.lit(stride)
    c0 = (F.col("patch_id") % F.lit(n_c)) * F.lit(stride)
    p = (p.withColumn("dr", F.explode(F.sequence(F.lit(0), F.lit(patch - 1))))
          .withColumn("dc", F.explode(F.sequence(F.lit(0), F.lit(patch - 1))))
          .withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(shape.c - 1)))))
    pos = ((r0 + F.col("dr")) * F.lit(shape.w) + c0 + F.col("dc")) * F.lit(shape.c) + F.col("ch")
    return F.broadcast(p.select("patch_id", pos.cast("int").alias("pos")))


# --- D14 bicubic resize ----------------------------------------------------------

KEYS_A = -0.5  # fixed value: Keys cubic convolution parameter


def _keys_weight(t: float) -> float:
    t = abs(t)
    a = KEYS_A
    if t <= 1.0:
        return (a + 2.0) * t ** 3 - (a + 3.0) * t ** 2 + 1.0
    if t < 2.0:
        return a * t ** 3 - 5.0 * a * t ** 2 + 8.0 * a * t - 4.0 * a
    return 0.0


def _axis_weights(n_out: int, n_in: int) -> list[tuple[int, int, float]]:
    out = []
    for o in range(n_out):
        src = (o + 0.5) * n_in / n_out - 0.5
        base = math.floor(src)
        acc: dict[int, float] = {}
        for k in range(base - 1, base + 3):
            wgt = _keys_weight(src - k)
            if wgt != 0.0:
                idx = min(max(k, 0), n_in - 1)
                acc[idx] = acc.get(idx, 0.0) + wgt
        out.extend((o, i, wv) for i, wv in sorted(acc.items()))
    return out


def bicubic_weights(spark: SparkSession, grid: int, shape: Shape) -> DataFrame:
    """Static sparse map ``(cell, pix, weight)`` for a g x g -> H x W bicubic resize.

    Made by tasks from a range: every output pixel has four taps an axis, those
    beyond the border count for the border cell.  A resize is a join on ``cell`` and ``sum(weight*v)``.
    """
    tap = spark.range(shape.pixels * 16)
    pix, t = F.floor(F.col("id") / 16), F.col("id") % 16

    def axis(out, n_out: int, k):
        src = (out + F.lit(0.5)) * F.lit(float(grid)) / F.lit(float(n_out)) - F.lit(0.5)
        at = F.floor(src) - 1 + k
        d = F.abs(src - at)
        a = KEYS_A
        near = F.lit(a + 2.0) * d * d * d - F.lit(a + 3.0) * d * d + F.lit(1.0)
        far = F.lit(a) * d * d * d - F.lit(5.0 * a) * d * d + F.lit(8.0 * a) * d - F.lit(4.0 * a)
        return F.greatest(F.least(at, F.lit(grid - 1)), F.lit(0)), F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)

    r, wr = axis(F.floor(pix / shape.w), shape.h, F.floor(t / 4))
    c, wc = axis(pix % shape.w, shape.w, t % 4)
    taps = tap.select((r * grid + c).cast("int").alias("cell"), pix.cast("int").alias("pix"), (wr * wc).alias("weight"))
    return taps.groupBy("cell", "pix").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def bicubic_matrix(grid: int, shape: Shape) -> np.ndarray:
    """D14 as a dense matrix (positions x cells) for arrays: the product of the two axes' weights."""
    axes = []
    for size in (shape.h, shape.w):
        m = np.zeros((size, grid))
        for o, i, wv in _axis_weights(size, grid):
            m[o, i] += wv
        axes.append(m)
    return np.kron(*axes)


def resize_bicubic(cell_map: DataFrame, weights: DataFrame, keys=("sample_id",), value: str = "v") -> DataFrame:
    """``(keys, cell, v)`` -> ``(keys, pix, v)``."""
    return (cell_map.join(weights, "cell")
            .groupBy(*keys, "pix").agg(F.sum(F.col(value) * F.col("weight")).alias(value)))


# --- D10 / D11 perturbations -------------------------------------------------------

def blend(x: Column, m: Column, ref: Column | float = 0.0) -> Column:
    """``x*m + ref*(1-m)``; inpainting is ``ref = 0``."""
    ref = F.lit(float(ref)) if isinstance(ref, (int, float)) else ref
    return x * m + ref * (F.lit(1.0) - m)


def amplitude(x: Column, m: Column) -> Column:
    """The input scaled by a real mask."""
    return x * m


def box_blur(long_x: DataFrame, shape: Shape, radius: int = 1) -> DataFrame:
    """Box mean of the (2r+1)^2 neighbourhood clipped at the border, per channel.

    A neighbour table (pos -> src) from the shape is joined on ``src``; no
    per-sample pairs are formed beyond the fixed neighbourhood.
    """
    spark = long_x.sparkSession
    pos = spark.range(shape.size).select(F.col("id").cast("int").alias("pos"))
    pix = (F.col("pos") / F.lit(shape.c)).cast("int")
    ch = F.col("pos") % F.lit(shape.c)
    r, c = (pix / F.lit(shape.w)).cast("int"), pix % F.lit(shape.w)
    nb = (pos.select("pos", r.alias("r"), c.alias("c"), ch.alias("ch"))
          .withColumn("dr", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
          .withColumn("dc", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
          .withColumn("rr", F.col("r") + F.col("dr")).withColumn("cc", F.col("c") + F.col("dc"))
          .filter((F.col("rr") >= 0) & (F.col("rr") < shape.h) & (F.col("cc") >= 0) & (F.col("cc") < shape.w))
          .select(F.col("pos").alias("dst"),
                  ((F.col("rr") * F.lit(shape.w) + F.col("cc")) * F.lit(shape.c) + F.col("ch")).cast("int").alias("pos")))
    return (long_x.join(F.broadcast(nb), "pos")
            .groupBy("sample_id", "dst").agg(F.avg("x").alias("blur"))
            .withColumnRenamed("dst", "pos"))


def prefix_masks(ranked: DataFrame, n_features: int, steps: int, mode: str = "deletion", baseline=0.0,
                 max_pct: float = 1.0) -> DataFrame:
    """D4 (explicit form): the input at every step of the ranked path, ``(sample_id, k, pos, v)``.

    ``ranked`` has ``(sample_id, pos, x, rank)``.  Steps come from a generator
    (no join): ``t_k = k * (max_n - 1) div (S - 1)``; positions with ``rank <= t_k``
    are switched (to the baseline for deletion, to ``x`` for insertion).  Used by
    general scorers; the linear scorer uses the running-sum form instead.
    """
    if mode not in ("insertion", "deletion"):
        raise ValueError(f"unknown causal mode {mode!r}: use 'deletion' or 'insertion'")
    max_n = max_perturbed(n_features, max_pct)
    b = baseline_value(baseline, F.col("x"))
    k = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k")
    t = F.expr(f"div(k * {max_n - 1}, {steps - 1})")
    on, off = (b, F.col("x")) if mode == "deletion" else (F.col("x"), b)
    return (ranked.select("sample_id", "pos", "x", "rank", k)
            .select("sample_id", "k", "pos", F.when(F.col("rank") <= t, on).otherwise(off).alias("v")))
