"""Explainers (E1-E12): ``(samples, model, targets) -> (sample_id, pos, e)``.

Gradient family (E1-E6).  For the linear-softmax scorer the gradient of the
target probability is ``g = W^T a`` with the class coefficients
``a_c = p_t ([c = t] - p_c)``.  Class-level quantities are small arrays per
sample (length = number of classes); a map is then one broadcast lookup of
the per-position weight column ``wv[pos]`` and a dot product, so every
gradient explainer is a per-sample, shuffle-free projection after the logits.
Averages over a path are averages of the coefficient arrays; averages over noise
draws (E4-E6) need the coefficients' first and second moments only.

The perturbation family (E8-E12) scores designs row by row through
:mod:`salient.operators.copies`; occlusion (E7) through :mod:`salient.operators.perturb`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import numpy as np
import pyarrow as pa
from salient.functions.arrays import let, to_array
from salient.functions.hashing import hash_normal
from salient.operators.copies import VALUES, LinearCopies, SharedRows, blurred, design_rows, estimate_rows, grid_cells, rows_of
from salient.operators.designs import binary_design, replicated_design, sobol_ab, sobol_design, uniform_design
from salient.operators.estimators import (InputKernels, constrained_shap, hsic_scores, jansen_arrays, similarity_arrays, weighted_ridge)
from salient.operators.masking import Shape, bicubic_matrix, patch_positions
from salient.operators.perturb import clean_scores, design_scores, relative_contributions
from salient.operators.scoring import LinearSoftmaxModel, maybe_broadcast

# Benchmark settings of the explainers (fixed values of the published benchmark).
SMOOTHGRAD = dict(nb_samples=175, sigma=0.11)
SQUAREGRAD = dict(nb_samples=194, sigma=0.63)
VARGRAD = dict(nb_samples=100, sigma=0.62)
INTEGRATED_GRADIENTS = dict(steps=100)
OCCLUSION = dict(patch_size=5, patch_stride=3, occlusion_value=0.0)
RISE = dict(nb_samples=8000, grid_size=10, mask_value=0.0)
KERNEL_SHAP = dict(nb_samples=400)
LIME = dict(nb_samples=2000, distance_mode="cosine", kernel_width=46.0, alpha=2.0)
HSIC = dict(nb_samples=500, grid_size=11)
SOBOL = dict(nb_design=32, grid_size=11)


# --- class-array helpers ---------------------------------------------------------

def softmax_array(zs: Column) -> Column:
    """Softmax of a logit array; max, exponentials and their sum are bound once."""
    def with_max(z):
        return let(F.array_max(z), lambda m: let(
            F.transform(z, lambda v: F.exp(v - m)),
            lambda e: let(F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v),
                          lambda s: F.transform(e, lambda v: v / s))))
    return let(zs, with_max)


def grad_coefs(probs: Column, target: Column) -> Column:
    """``a_c = p_t ([c = t] - p_c)`` from a probability array and a 0-based target."""
    def coefs(p):
        return let(F.element_at(p, target + 1), lambda pt: F.transform(
            p, lambda q, i: pt * (F.when(i == target, 1.0).otherwise(0.0) - q)))
    return let(probs, coefs)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)


def weights_by_pos(model: LinearSoftmaxModel) -> DataFrame:
    """``(pos, wv)``: the weight column of each position, ordered by class.

    Broadcast under the same proven size bound as the weight table itself.
    """
    return maybe_broadcast(to_array(model._W, "w", "wv", keys=("pos",), pos_col="cls"), model.n_rows)


def _field(name: str):
    return lambda r: r[name]


def logit_arrays(model: LinearSoftmaxModel, samples: DataFrame, targets: DataFrame,
                 x_col: str = "x", baseline: float | DataFrame | None = None) -> DataFrame:
    """``(sample_id, x, target, zs[, zb])``: class logits of ``x`` (and of the baseline).

    A baseline is a constant or a per-position table ``(pos, b)``; its logits are
    summed in the same aggregate as the input's, so no extra join is needed.
    """
    long = samples.select("sample_id", F.posexplode(x_col).alias("pos", "x"))
    aggs = [F.sum(F.col("w") * F.col("x")).alias("z")]
    if isinstance(baseline, DataFrame):
        long = long.join(F.broadcast(baseline.select("pos", "b")), "pos")
        aggs.append(F.sum(F.col("w") * F.col("b")).alias("zb"))
    elif baseline is not None:
        aggs.append(F.sum(F.col("w") * F.lit(float(baseline))).alias("zb"))
    z = long.join(model.W(), "pos").groupBy("sample_id", "cls").agg(*aggs)
    names = [a for a in ("z", "zb") if a in z.columns]
    arr = (z.groupBy("sample_id")
           .agg(F.array_sort(F.collect_list(F.struct("cls", *names))).alias("_s"))
           .select("sample_id", *[F.transform("_s", _field(n)).alias(n + "s") for n in names]))
    return samples.select("sample_id", x_col).join(targets, "sample_id").join(arr, "sample_id")


def project(model: LinearSoftmaxModel, rows: DataFrame, coef_col: str, value: Column,
            x_col: str = "x", extra=()) -> DataFrame:
    """Map ``e[pos] = value(x[pos], g[pos])`` with ``g = W^T coef`` for each sample row."""
    exploded = rows.select("sample_id", coef_col, F.posexplode(x_col).alias("pos", "x"))
    return (exploded.join(weights_by_pos(model), "pos")
            .withColumn("g", dot(F.col(coef_col), F.col("wv")))
            .select("sample_id", "pos", value.alias("e"), *extra))


# --- E1 / E2 -------------------------------------------------------------------------

def _coef_rows(model, samples, targets):
    rows = logit_arrays(model, samples, targets)
    return rows.withColumn("coef", grad_coefs(softmax_array(F.col("zs")), F.col("target")))


def saliency(model: LinearSoftmaxModel, samples: DataFrame, targets: DataFrame) -> DataFrame:
    """|d p_t / d x|."""
    return project(model, _coef_rows(model, samples, targets), "coef", F.abs(F.col("g")))


def gradient_input(model: LinearSoftmaxModel, samples: DataFrame, targets: DataFrame) -> DataFrame:
    """X * d p_t / d x."""
    return project(model, _coef_rows(model, samples, targets), "coef", F.col("x") * F.col("g"))


# --- E3 integrated gradients ---------------------------------------------------------

def integrated_gradients(model: LinearSoftmaxModel, samples: DataFrame, targets: DataFrame,
                         steps: int = 100, baseline: float | DataFrame = 0.0) -> DataFrame:
    """(x - b) * trapezoid mean of the gradient on the straight path b -> x.

    Along the path the logits are affine, ``z(a) = z_b + a (z_x - z_b)``, so the
    whole path is evaluated on the per-sample class arrays (no exploded copies).
    ``baseline`` is a constant or a per-position table ``(pos, b)`` (e.g. the
    channel mean of P10 spread over positions).
    """
    if steps < 2:
        raise ValueError("steps must be >= 2")
    rows = logit_arrays(model, samples, targets, baseline=baseline).withColumnRenamed("zbs", "zb")
    n = steps - 1

    def coef_at(k):
        alpha = k.cast("double") / F.lit(float(n))
        z = F.zip_with(F.col("zb"), F.col("zs"), lambda u, v: u + alpha * (v - u))
        wk = F.when((k == 0) | (k == n), 0.5 / n).otherwise(1.0 / n)
        return F.transform(grad_coefs(softmax_array(z), F.col("target")), lambda a: a * wk)

    zero = F.array_repeat(F.lit(0.0), F.size("zs"))
    coef = F.aggregate(F.sequence(F.lit(0), F.lit(n)), zero,
                       lambda acc, k: F.zip_with(acc, coef_at(k), lambda u, v: u + v))
    rows = rows.withColumn("coef", coef)
    if isinstance(baseline, DataFrame):
        maps = project(model, rows, "coef", F.col("x"), extra=("g",))
        return (maps.join(F.broadcast(baseline.select("pos", "b")), "pos")
                .select("sample_id", "pos", ((F.col("e") - F.col("b")) * F.col("g")).alias("e")))
    return project(model, rows, "coef", (F.col("x") - F.lit(float(baseline))) * F.col("g"))


# --- E4-E6 noise averages ----------------------------------------------------------

def noise_logit_shifts(model: LinearSoftmaxModel, spark: SparkSession, draws: int, sigma: float,
                       n_pos: int, seed: int) -> DataFrame:
    """``(idx, v)``: logit shifts ``W eps_k`` of each shared Gaussian noise draw, ordered by class.

    The design (draws x positions) does not depend on the data; it is generated
    from hash normals and reduced against the weights.
    """
    eps = (spark.range(draws * n_pos)
           .select((F.col("id") / F.lit(n_pos)).cast("int").alias("draw"),
                   (F.col("id") % F.lit(n_pos)).cast("int").alias("pos"))
           .withColumn("eps", F.lit(float(sigma)) * hash_normal(seed, F.col("draw"), F.col("pos"))))
    shifts = (eps.join(model.W(), "pos").groupBy("draw", "cls")
              .agg(F.sum(F.col("w") * F.col("eps")).alias("z")))
    return to_array(shifts, "z", "v", keys=("draw",), pos_col="cls").withColumnRenamed("draw", "idx")


def _noise_maps(model: LinearSoftmaxModel, samples: DataFrame, targets: DataFrame, draws: int, sigma: float, seed: int, kind: str) -> DataFrame:
    """The mean, mean square or variance over noise draws of the gradient at every position.

    A draw's gradient is ``W' a_k`` with the class coefficients ``a_k``, so a sample
    needs the coefficients' first and second moments only: position ``p`` then has
    ``w_p . mean(a)``, and its mean square is the quadratic form ``w_p' mean(a a') w_p``.
    """
    shifts = SharedRows(noise_logit_shifts(model, samples.sparkSession, draws, sigma, model.n_pos, seed), "noise")
    scorer = LinearCopies(model)
    c = model.n_classes
    rows = _array_rows(samples, targets)

    def run(batches):
        noise = None
        for batch in batches:
            if not batch.num_rows:
                continue
            noise = shifts.matrix() if noise is None else noise
            d = len(batch.column("x")[0])
            step = max(1, VALUES // (c * c + 2 * d))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x, target = rows_of(part.column("x")).astype(np.float64), part.column("target").to_numpy().astype(np.int64)
                z, n = scorer.logits(x), len(x)
                first, second = np.zeros((n, c)), np.zeros((n, c, c))
                block = max(1, VALUES // max(1, n * c))
                for k in range(0, draws, block):
                    p = z[:, None, :] + noise[k:k + block]
                    p = np.exp(p - p.max(2, keepdims=True))
                    p /= p.sum(2, keepdims=True)
                    own = p[np.arange(n), :, target]
                    a = -own[:, :, None] * p
                    a[np.arange(n), :, target] += own
                    first += a.sum(1)
                    if kind != "mean":
                        second += np.matmul(a.transpose(0, 2, 1), a)
                first, second = first / draws, second / draws
                if kind == "variance":
                    second -= first[:, :, None] * first[:, None, :]
                out = np.empty((n, d))
                for pos, w in scorer.weights.tiles():
                    out[:, pos] = first @ w.T if kind == "mean" else np.maximum((np.matmul(w, second) * w).sum(2), 0.0)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("sample_id"), pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))], ["sample_id", "e"])

    schema = T.StructType([rows.schema["sample_id"], T.StructField("e", T.ArrayType(T.DoubleType()))])
    return _long(rows.mapInArrow(run, schema))


def smoothgrad(model: LinearSoftmaxModel, samples: DataFrame, targets: DataFrame,
               nb_samples: int = 175, sigma: float = 0.11, seed: int = 0) -> DataFrame:
    """Mean gradient under N(0, sigma^2) input noise (one shared noise design)."""
    return _noise_maps(model, samples, targets, nb_samples, sigma, seed, "mean")


def squaregrad(model: LinearSoftmaxModel, samples: DataFrame, targets: DataFrame,
               nb_samples: int = 194, sigma: float = 0.63, seed: int = 0) -> DataFrame:
    """E5: mean squared gradient under noise."""
    return _noise_maps(model, samples, targets, nb_samples, sigma, seed, "square")


def vargrad(model: LinearSoftmaxModel, samples: DataFrame, targets: DataFrame,
            nb_samples: int = 100, sigma: float = 0.62, seed: int = 0) -> DataFrame:
    """Population variance of the gradient under noise."""
    return _noise_maps(model, samples, targets, nb_samples, sigma, seed, "variance")


# --- perturbation family ------------------------------------------------------------------

def _input_rows(samples: DataFrame, targets: DataFrame, shape: Shape) -> DataFrame:
    """``(sample_id, target, pos, pix, x)``."""
    return (samples.select("sample_id", "x").join(targets, "sample_id")
            .select("sample_id", "target", F.posexplode("x").alias("pos", "x"))
            .withColumn("pix", (F.col("pos") / F.lit(shape.c)).cast("int")))


def occlusion(model, samples: DataFrame, targets: DataFrame, shape: Shape,
              patch_size: int = 5, patch_stride: int = 3, occlusion_value: float = 0.0) -> DataFrame:
    """Score drop of sliding patches, averaged over the patches covering a position (0 if none).

    ``model`` is a linear-softmax model (patches are cells of a join) or a batch
    function (S3: the copies are made from the row, a block of patches at a time).
    """
    spark = samples.sparkSession
    if not isinstance(model, LinearSoftmaxModel):
        return _occluded(model, samples, targets, shape, patch_size, patch_stride, occlusion_value)
    rows = _input_rows(samples, targets, shape)
    patches = patch_positions(spark, shape, patch_size, patch_stride)
    n_patches = len(range(0, shape.h - patch_size + 1, patch_stride)) * len(range(0, shape.w - patch_size + 1, patch_stride))
    prow = rows.join(patches, "pos").withColumnRenamed("patch_id", "cell")
    contrib = relative_contributions(model, prow, F.lit(float(occlusion_value)), base_rows=rows)
    design = spark.range(n_patches).select(F.col("id").cast("int").alias("draw"),
                                           F.col("id").cast("int").alias("cell"), F.lit(1.0).alias("drop"))
    scores = design_scores(contrib, design, n_patches)
    drops = (scores.join(clean_scores(contrib).withColumnRenamed("score", "base"), "sample_id")
             .select("sample_id", "draw", (F.col("base") - F.col("score")).alias("v")))
    covered = drops.join(patches.withColumnRenamed("patch_id", "draw"), "draw").select(
        "sample_id", "pos", "v", F.lit(1).alias("n"))
    zeros = rows.select("sample_id", "pos", F.lit(0.0).alias("v"), F.lit(0).alias("n"))
    return (covered.unionByName(zeros).groupBy("sample_id", "pos")
            .agg(F.coalesce(F.sum("v") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("e")))


class PatchMasks:
    """The keep values of sliding patches over the positions, made for the patches asked for (a design too large to hold)."""

    def __init__(self, shape: Shape, size: int, stride: int):
        self.rows, self.cols = (np.arange(0, n - size + 1, stride) for n in (shape.h, shape.w))
        self.size, self.full = size, shape
        self.shape = (len(self.rows) * len(self.cols), shape.size)

    def matrix(self) -> "PatchMasks":
        return self

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        r0, c0 = self.rows[k // len(self.cols)], self.cols[k % len(self.cols)]
        r, c = np.arange(self.full.h), np.arange(self.full.w)
        inside = (((r >= r0[:, None]) & (r < r0[:, None] + self.size))[:, :, None] & ((c >= c0[:, None]) & (c < c0[:, None] + self.size))[:, None, :])
        return np.repeat(1.0 - inside.reshape(len(k), -1), self.full.c, axis=1)


def _occluded(fn, samples: DataFrame, targets: DataFrame, shape: Shape, size: int, stride: int, value: float) -> DataFrame:
    masks = PatchMasks(shape, size, stride)

    def estimate(y, clean, block):
        total, covered = np.zeros((len(y), shape.size)), np.zeros(shape.size)
        step = max(1, VALUES // shape.size)
        for a in range(0, len(masks), step):
            k = np.arange(a, min(a + step, len(masks)))
            inside = 1.0 - masks[k]
            total += (clean[:, None] - y[:, k]) @ inside
            covered += inside.sum(0)
        return np.divide(total, covered, out=np.zeros(total.shape), where=covered > 0)

    return _long(estimate_rows(_array_rows(samples, targets), fn, masks, estimate, np.arange(shape.size), value))


def _array_rows(samples: DataFrame, targets: DataFrame) -> DataFrame:
    return samples.select("sample_id", F.col("x").cast("array<double>").alias("x")).join(targets.select("sample_id", "target"), "sample_id")


def _long(maps: DataFrame) -> DataFrame:
    return maps.select("sample_id", F.posexplode("e").alias("pos", "e"))


def rise(model, samples: DataFrame, targets: DataFrame, shape: Shape,
         nb_samples: int = 8000, grid_size: int = 10, preservation_probability: float = 0.5,
         mask_value: float = 0.0, seed: int = 0) -> DataFrame:
    """``map(pos) = sum_k m_k(pos) y_k / sum_k m_k(pos)`` over random cell masks (0 where no mask keeps a cell).

    ``model`` is a linear-softmax model or a batch function (S3), as in all that follow.
    """
    design = design_rows(binary_design(samples.sparkSession, nb_samples, grid_size * grid_size, preservation_probability, seed))

    def estimate(y, clean, block):
        kept = block.z.sum(0)
        return (np.divide(y @ block.z, kept, out=np.zeros((len(y), len(kept))), where=kept > 0))[:, block.cells]

    return _long(estimate_rows(_array_rows(samples, targets), model, design, estimate, grid_cells(shape, grid_size), mask_value))


def _segmented(samples: DataFrame, targets: DataFrame, shape: Shape, grid_size: int | None, segments):
    """``(rows, cell of every position or None, number of cells)`` for a grid, given segments, or single pixels.

    ``segments`` is one number from 0 on for each of the ``h * w`` pixels, or a
    table ``(sample_id, pix, cell)`` with a map of its own for every sample; the
    samples' maps may have different numbers of cells.
    """
    rows = _array_rows(samples, targets)
    if isinstance(segments, DataFrame):
        # one sample's own map, bounded by its size; the most cells of any sample is one number
        maps = to_array(segments.select("sample_id", "pix", F.col("cell").cast("int").alias("cell")), "cell", "own", pos_col="pix")
        most = segments.agg(F.max("cell")).first()[0]
        if most is None:
            raise ValueError("the segment table is empty")
        spread = F.flatten(F.transform("own", lambda c: F.array_repeat(c, shape.c)))
        missing = F.raise_error(F.concat(F.lit("sample "), F.col("sample_id").cast("string"), F.lit(" has no segment map")))
        rows = rows.join(maps, "sample_id", "left").withColumn("cells", F.when(F.col("own").isNull(), missing).otherwise(spread)).drop("own")
        return rows, None, int(most) + 1
    if segments is not None:
        if len(segments) != shape.h * shape.w:
            raise ValueError(f"{len(segments)} segment numbers for {shape.h * shape.w} pixels")
        return rows, np.repeat(np.asarray(segments, int), shape.c), max(segments) + 1
    if grid_size:
        return rows, grid_cells(shape, grid_size), grid_size * grid_size
    return rows, np.repeat(np.arange(shape.h * shape.w), shape.c), shape.h * shape.w


def lime_sums(block) -> dict[str, np.ndarray]:
    """Squared distance, norms and product of every copy and its input, from sums over cells."""
    x, r, drop = block.x, block.ref, 1.0 - block.z.T
    xx = (x ** 2).sum(1)[:, None]
    return {"sq": block.per_cell((x - r) ** 2) @ drop, "xx": xx,
            "xp": xx + block.per_cell(x * r - x ** 2) @ drop, "pp": xx + block.per_cell(r * r - x ** 2) @ drop}


def _channel_values(value, shape: Shape):
    """A replacement given as one number, as one a channel, or as a function of a batch of inputs."""
    if callable(value) or isinstance(value, (int, float)):
        return value
    if len(value) != shape.c:
        raise ValueError(f"{len(value)} reference values for {shape.c} channels")
    one = np.tile(np.asarray(value, float), shape.h * shape.w)
    return lambda x: np.broadcast_to(one, x.shape)


def lime(model, samples: DataFrame, targets: DataFrame, shape: Shape,
         nb_samples: int = 2000, grid_size: int | None = None, distance_mode: str = "cosine",
         kernel_width: float = 46.0, alpha: float = 2.0, prob: float = 0.5, ref_value=None,
         reference_sign: bool = False, seed: int = 0, segments=None, kernel=None) -> DataFrame:
    """Weighted ridge of the target score on binary cell samples (D7 -> D13 -> D10 -> E10a -> E10b).

    ``ref_value`` is a number, one for each channel, or a function of a batch of
    inputs; it defaults to 0.5 for 3-channel inputs and 0 otherwise.  Segments are a g x g grid, the given segment number of every pixel, a table
    of maps for each sample, or (by default) every pixel by itself.  ``kernel``,
    where given, takes the place of the similarity kernel: a function of the arrays
    ``sq, xx, xp, pp`` (samples x draws).
    """
    rows, cells, dims = _segmented(samples, targets, shape, grid_size, segments)
    ref = _channel_values(ref_value if ref_value is not None else (0.5 if shape.c == 3 else 0.0), shape)
    design = design_rows(binary_design(samples.sparkSession, nb_samples, dims, prob, seed))

    def estimate(y, clean, block):
        out, step = [], max(1, VALUES // max(1, block.z.size))
        sums = lime_sums(block)
        sim = kernel(**sums) if kernel else similarity_arrays(distance_mode, kernel_width, reference_sign=reference_sign, **sums)
        for a in range(0, len(y), step):
            out.append(weighted_ridge(block.z, y[a:a + step], sim[a:a + step], alpha))
        return np.concatenate(out)[:, block.cells]

    return _long(estimate_rows(rows, model, design, estimate, cells, ref))


def lime_similarity(samples: DataFrame, shape: Shape, nb_samples: int = 2000, grid_size: int | None = None, distance_mode: str = "cosine",
                    kernel_width: float = 46.0, prob: float = 0.5, ref_value: float = 0.0, reference_sign: bool = False, seed: int = 0) -> DataFrame:
    """E10a as a report: ``(sample_id, draw, sim)`` of every LIME draw (no model is asked)."""
    rows, cells, dims = _segmented(samples, samples.select("sample_id", F.lit(0).alias("target")), shape, grid_size, None)
    design = design_rows(binary_design(samples.sparkSession, nb_samples, dims, prob, seed))

    def estimate(y, clean, block):
        return similarity_arrays(distance_mode, kernel_width, reference_sign=reference_sign, **lime_sums(block))

    sims = estimate_rows(rows, lambda x: np.ones((len(x), 1)), design, estimate, cells, ref_value, name="sim")
    return sims.select("sample_id", F.posexplode("sim").alias("draw", "sim"))


def kernel_shap(model, samples: DataFrame, targets: DataFrame, shape: Shape,
                nb_samples: int = 400, grid_size: int | None = None, ref_value: float = 0.0,
                seed: int = 0, segments=None) -> DataFrame:
    """Shapley-kernel weighted regression with the efficiency constraint (segments as in :func:`lime`).

    Coalitions are Bernoulli(1/2) over cells; the empty and full coalitions
    (infinite kernel weight) are the last two copies and enter as the
    constraint ``sum(phi) = f(x) - f(empty)``.
    """
    spark = samples.sparkSession
    rows, cells, dims = _segmented(samples, targets, shape, grid_size, segments)
    ends = (spark.range(2 * dims).select((nb_samples + F.floor(F.col("id") / dims)).cast("int").alias("draw"), (F.col("id") % dims).cast("int").alias("cell"))
            .withColumn("m", F.when(F.col("draw") == nb_samples, 0.0).otherwise(1.0)))
    design = design_rows(binary_design(spark, nb_samples, dims, 0.5, seed).unionByName(ends))

    def estimate(y, clean, block):
        return constrained_shap(block.z[:-2], y[:, :-2], y[:, -2], y[:, -1])[:, block.cells]

    return _long(estimate_rows(rows, model, design, estimate, cells, ref_value))


def _replacement(shape: Shape, perturbation):
    """D10/D11 for the GSA explainers: what ``x m + replacement (1 - m)`` takes.

    ``inpainting`` and ``amplitude`` scale the input by the mask (replacement 0);
    ``blurring`` replaces dropped cells by the 3x3 box blur of the input; a
    function of a batch of inputs gives any other replacement.
    """
    if callable(perturbation):
        return perturbation
    if perturbation in ("inpainting", "amplitude"):
        return 0.0
    if perturbation == "blurring":
        return lambda x: blurred(x, shape)
    raise ValueError(f"unknown perturbation {perturbation!r}: inpainting, blurring or amplitude, or a function")


def sobol_attribution(model, samples: DataFrame, targets: DataFrame, shape: Shape,
                      grid_size: int = 11, nb_design: int = 32, sampler: str = "sobol", seed: int = 0,
                      perturbation="inpainting") -> DataFrame:
    """Total-order Sobol indices of the cells (Jansen), bicubic-resized to the map.

    A and C_i = A with cell i from B are scored as one design of
    ``nb_design * (cells + 1)`` draws (B itself is never used by the estimator, R3).
    """
    if nb_design & (nb_design - 1):
        raise ValueError("nb_design must be a power of two")
    spark = samples.sparkSession
    dims = grid_size * grid_size
    if sampler == "sobol":
        a, b = sobol_ab(spark, nb_design, dims)
    else:
        a, b = uniform_design(spark, nb_design, dims, seed), uniform_design(spark, nb_design, dims, seed + 1)
    blocks = replicated_design(a, b, dims).where("block <> 'B'")
    design = design_rows(blocks.select(((F.col("rep") + 1) * nb_design + F.col("draw")).cast("int").alias("draw"), "cell", "m"))
    resize = bicubic_matrix(grid_size, shape)

    def estimate(y, clean, block):
        return jansen_arrays(y[:, :nb_design], y[:, nb_design:].reshape(len(y), dims, nb_design)) @ resize.T

    return _long(estimate_rows(_array_rows(samples, targets), model, design, estimate, grid_cells(shape, grid_size), _replacement(shape, perturbation)))


def hsic_attribution(model, samples: DataFrame, targets: DataFrame, shape: Shape,
                     grid_size: int = 11, nb_design: int = 500, kernel: str = "binary",
                     sampler: str = "sobol", seed: int = 0, perturbation="inpainting", binary: bool = True) -> DataFrame:
    """HSIC between each cell's mask and the target score, bicubic-resized to the map.

    Masks are Sobol points or hash uniforms, rounded to 0 and 1 unless
    ``binary`` is off (for the RBF and Sobolev kernels).  A score that is undefined (output
    kernel of width 0) is NULL.
    """
    spark = samples.sparkSession
    dims = grid_size * grid_size
    if sampler == "sobol":
        masks = sobol_design(spark, nb_design, dims, binary=binary)
    else:
        masks = binary_design(spark, nb_design, dims, 0.5, seed) if binary else uniform_design(spark, nb_design, dims, seed)
    design = design_rows(masks)
    resize = bicubic_matrix(grid_size, shape)

    kernels = None  # of the design, made once in a task

    def estimate(y, clean, block):
        nonlocal kernels
        if not binary and kernels is None:
            kernels = InputKernels(block.z, kernel)
        return hsic_scores(block.z, y, kernel, kernels) @ resize.T

    return _long(estimate_rows(_array_rows(samples, targets), model, design, estimate, grid_cells(shape, grid_size), _replacement(shape, perturbation)))
