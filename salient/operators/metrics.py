"""Per-sample metrics (M1-M12) over metric triplets.

A triplet row is ``(sample_id, x ARRAY, target INT, e ARRAY)`` (P6): the
input, its predicted class and its attribution map, joined on ``sample_id``.
Every metric returns ``(sample_id, score)``.  All intermediate tables stay
keyed and partitioned by ``sample_id``, so a metric is one shuffle at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salient.functions.arrays import channel_reduce, entropy, gini
from salient.functions.hashing import hash_uniform
from salient.operators.copies import VALUES, design_rows, estimate_rows, grid_cells, path_scores, rows_of
from salient.operators.designs import off_class, random_grid_mask
from salient.operators.estimators import spearman_arrays
from salient.operators.masking import Shape, baseline_value, max_perturbed, step_thresholds
from salient.operators.scoring import LinearSoftmaxModel, prob_from_relative
from salient.session import materialize

# Benchmark settings of the metrics (fixed values of the published benchmark).
FIDELITY_STEPS = 200
MUFIDELITY = dict(grid_size=8, subset_percent=0.2, nb_samples=200)
RANDOM_LOGIT_SEED = 42


# --- P6 / P11 -------------------------------------------------------------------------

def metric_triplets(samples: DataFrame, preds: DataFrame, maps: DataFrame,
                    check: bool = True) -> DataFrame:
    """Align (input, prediction, map) by key instead of by position.

    ``samples(sample_id, x)``, ``preds(sample_id, pred)``, ``maps(sample_id, e)``.
    A sample without a prediction or a map is an error, raised by the join itself
    when its row is made: nothing runs while the query is built, and the maps are
    computed once.  ``check=False`` drops such samples.
    """
    rows = samples.select("sample_id", "x")
    for name, table, value in (("prediction", preds, "pred"), ("explanation", maps, "e")):
        if not check:
            rows = rows.join(table.select("sample_id", value), "sample_id")
            continue
        rows = rows.join(table.select("sample_id", value, F.lit(True).alias("_found")), "sample_id", "left")
        missing = F.raise_error(F.concat(F.lit("sample "), F.col("sample_id").cast("string"), F.lit(f" has no {name}")))
        # a null-checked struct keeps the check in the plan, whatever columns are read later
        rows = rows.select(F.when(F.col("_found").isNull(), missing.cast("bigint")).otherwise(F.col("sample_id")).cast(samples.schema["sample_id"].dataType).alias("sample_id"),
                           *[c for c in rows.columns if c not in ("sample_id", "_found")])
    return rows.withColumnRenamed("pred", "target").select("sample_id", "x", "target", "e")


# --- M1 / M2 ---------------------------------------------------------------------------

def complexity(maps: DataFrame, channels: int = 1, e_col: str = "e") -> DataFrame:
    """M1: entropy of the normalized absolute map (row-wise, no shuffle)."""
    return maps.select("sample_id", entropy(channel_reduce(e_col, channels)).alias("score"))


def sparseness(maps: DataFrame, channels: int = 1, e_col: str = "e") -> DataFrame:
    """M2: Gini index of the normalized absolute map (row-wise, no shuffle)."""
    return maps.select("sample_id", gini(channel_reduce(e_col, channels)).alias("score"))


# --- M3-M6 causal fidelity -------------------------------------------------------------

def _long_triplets(triplets: DataFrame, channels: int) -> DataFrame:
    """``(sample_id, target, pos, pix, x, e)``; the map is channel-reduced first."""
    t = triplets.select("sample_id", "target", "x", channel_reduce("e", channels).alias("e"))
    pix = (F.col("pos") / F.lit(channels)).cast("int")
    return (t.select("sample_id", "target", "e", F.posexplode("x").alias("pos", "x"))
            .withColumn("pix", pix)
            .withColumn("e", F.element_at("e", F.col("pix") + 1)))


def causal_curve(model: LinearSoftmaxModel, triplets: DataFrame, mode: str = "deletion",
                 baseline=0.0, steps: int = 10, max_pct: float = 1.0, channels: int = 1,
                 n_features: int | None = None) -> DataFrame:
    """M3: ``(sample_id, k, score)``: target probability at each step of the ranked path.

    Deletion starts from ``x`` and writes the baseline over the top-ranked
    pixels; insertion starts from the baseline and restores them.  At step k the
    pixels with ``rank <= t_k`` are switched (step 0 already switches one).

    R1: the logit at step k is the start logit plus a running sum of
    ``w * delta`` over ranks, one window per (sample, class), evaluated only
    at the S threshold ranks — no S rescored copies.
    """
    if mode not in ("insertion", "deletion"):
        raise ValueError(f"unknown causal mode {mode!r}: use 'deletion' or 'insertion'")
    spark = triplets.sparkSession
    rows = _long_triplets(triplets, channels)
    rank = F.dense_rank().over(Window.partitionBy("sample_id").orderBy(F.col("e").desc(), F.col("pix"))) - 1
    rows = rows.withColumn("rank", rank)
    b = baseline_value(baseline, F.col("x"))
    start, delta = (F.col("x"), b - F.col("x")) if mode == "deletion" else (b, F.col("x") - b)
    cols = rows.select("sample_id", "target", "pos", "rank", start.alias("s"), delta.alias("d"))
    per_rank = model.relative_rows(cols).select(
        "sample_id", "cls", "rank", (F.col("w") * F.col("s")).alias("s"), (F.col("w") * F.col("d")).alias("d"))
    if channels > 1:  # the channels of one pixel share a rank
        per_rank = per_rank.groupBy("sample_id", "cls", "rank").agg(F.sum("s").alias("s"), F.sum("d").alias("d"))
    w = Window.partitionBy("sample_id", "cls").orderBy("rank")
    cum = per_rank.select(
        "sample_id", "cls", "rank",
        (F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
         + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("z"))
    n = n_features if n_features is not None else model.n_pos // channels
    thresholds = step_thresholds(spark, n, steps, max_pct)
    return (cum.join(thresholds, cum["rank"] == thresholds["t"])
            .groupBy("sample_id", "k").agg(prob_from_relative("z").alias("score")))


def curve_auc(curve: DataFrame, steps: int) -> DataFrame:
    """M4: mean of the S-1 trapezoids of the curve (x axis normalized to 1)."""
    last = steps - 1
    return (curve.groupBy("sample_id")
            .agg(((F.sum("score") - F.lit(0.5) * (F.sum(F.when(F.col("k") == 0, F.col("score")))
                                                  + F.sum(F.when(F.col("k") == last, F.col("score")))))
                  / F.lit(float(last))).alias("score")))


def deletion(model, triplets, baseline=0.0, steps: int = FIDELITY_STEPS, max_pct: float = 1.0,
             channels: int = 1) -> DataFrame:
    """M5: area under the deletion curve (lower is better)."""
    return curve_auc(causal_curve(model, triplets, "deletion", baseline, steps, max_pct, channels), steps)


def insertion(model, triplets, baseline=0.0, steps: int = FIDELITY_STEPS, max_pct: float = 1.0,
              channels: int = 1) -> DataFrame:
    """M6: area under the insertion curve (higher is better)."""
    return curve_auc(causal_curve(model, triplets, "insertion", baseline, steps, max_pct, channels), steps)


# --- M8 ordinal Spearman ------------------------------------------------------------------

def ordinal_spearman(df: DataFrame, a: str, b: str, keys=("sample_id",), order: str = "idx") -> DataFrame:
    """M8: Pearson correlation of ordinal ranks (ties broken by ``order``).

    Ranks are permutations of 1..n, so the correlation is ``1 - 6 sum d^2 / (n (n^2 - 1))``;
    n < 2 gives NULL (undefined).
    """
    keys = list(keys)
    wa = Window.partitionBy(*keys).orderBy(F.col(a).asc(), F.col(order).asc())
    wb = Window.partitionBy(*keys).orderBy(F.col(b).asc(), F.col(order).asc())
    ranked = df.select(*keys, F.row_number().over(wa).alias("ra"), F.col(b), F.col(order))
    ranked = ranked.withColumn("rb", F.row_number().over(wb))
    n = F.count(F.lit(1)).cast("double")
    return (ranked.groupBy(*keys)
            .agg(n.alias("n"), F.sum((F.col("ra") - F.col("rb")) ** 2).alias("d2"))
            .select(*keys, F.when(F.col("n") > 1, F.lit(1.0) - F.lit(6.0) * F.col("d2")
                                  / (F.col("n") * (F.col("n") * F.col("n") - 1))).alias("score")))


# --- M7 MuFidelity ----------------------------------------------------------------------

def _metric_rows(triplets: DataFrame, channels: int, baseline) -> tuple[DataFrame, float]:
    """``(sample_id, x, target, e[, ref])`` with one map value a pixel; a baseline expression becomes the ``ref`` array."""
    rows = triplets.select("sample_id", F.col("x").cast("array<double>").alias("x"), "target", channel_reduce("e", channels).alias("e"))
    if baseline is None or isinstance(baseline, (int, float)):
        return rows, float(baseline or 0.0)
    return rows.withColumn("ref", F.transform("x", lambda v: baseline_value(baseline, v).cast("double"))), 0.0


def mu_fidelity(model, triplets: DataFrame, shape: Shape, grid_size: int | None = 8,
                subset_percent: float = 0.2, baseline=0.0, nb_samples: int = 200, seed: int = 0) -> DataFrame:
    """M7: Spearman(sum of the map over dropped cells, f(x) - f(x with dropped cells at baseline)).

    ``model`` is a linear-softmax model or a batch function (S3).  One seeded
    design (D6) serves the whole job; scores, masses and ranks are arrays of the sample's row.
    """
    grid = grid_size or shape.h
    rows, value = _metric_rows(triplets, shape.c, baseline)
    design = design_rows(random_grid_mask(triplets.sparkSession, grid, subset_percent, nb_samples, seed))
    pixel_cells = grid_cells(shape, grid)[::shape.c]

    def estimate(y, clean, block):
        mass = np.zeros((len(y), block.z.shape[1]))
        np.add.at(mass.T, pixel_cells, block.e.T)
        return spearman_arrays(mass @ (1.0 - block.z.T), clean[:, None] - y)[:, None]

    found = estimate_rows(rows, model, design, estimate, grid_cells(shape, grid), value, name="s")
    return found.select("sample_id", F.element_at("s", 1).alias("score"))


# --- M9 SSIM --------------------------------------------------------------------------------

def gaussian_window(size: int, sigma: float) -> list[float]:
    coords = [i - (size - 1) / 2.0 for i in range(size)]
    g = [math.exp(-0.5 * c * c / (sigma * sigma)) for c in coords]
    s = sum(g)
    return [v / s for v in g]


def window_bands(size: int, win: int, sigma: float) -> np.ndarray:
    """(windows, size): one axis of all windows fully inside, each row the gaussian weights at its place."""
    if size < win:
        raise ValueError(f"window {win} larger than an axis of {size}")
    out = np.zeros((size - win + 1, size))
    for i in range(len(out)):
        out[i, i:i + win] = gaussian_window(win, sigma)
    return out


def ssim(pairs: DataFrame, shape: Shape, win: int = 11, sigma: float = 1.5, k1: float = 0.01,
         k2: float = 0.03) -> DataFrame:
    """M9: SSIM per sample between two maps given long as ``(sample_id, pos, a, b)``.

    Dynamic range ``L = max - min`` over both maps of the pair; zero range is 1.0.
    The window is separable: a moment of all windows is one product with the
    bands of each axis, on the maps as arrays.  The score is the mean over windows and channels.
    """
    tall, wide = window_bands(shape.h, win, sigma), window_bands(shape.w, win, sigma)
    maps = (pairs.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("s"))
            .select("sample_id", F.transform("s", lambda v: v["a"]).alias("a"), F.transform("s", lambda v: v["b"]).alias("b")))

    def run(batches):
        for batch in batches:
            step = max(1, VALUES // (8 * shape.size))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                a, b = (rows_of(part.column(k)).astype(np.float64).reshape(-1, shape.h, shape.w, shape.c).transpose(0, 3, 1, 2) for k in ("a", "b"))
                moment = lambda v: np.matmul(np.matmul(tall, v), wide.T)
                ma, mb, m2, mab = moment(a), moment(b), moment(a * a + b * b), moment(a * b)
                span = (np.maximum(a.max((1, 2, 3)), b.max((1, 2, 3))) - np.minimum(a.min((1, 2, 3)), b.min((1, 2, 3))))
                c1, c2 = ((k * np.where(span > 0, span, 1.0)[:, None, None, None]) ** 2 for k in (k1, k2))
                num, den = 2.0 * ma * mb, ma * ma + mb * mb
                each = (num + c1) / (den + c1) * ((2.0 * mab - num + c2) / (m2 - den + c2))
                score = np.where(span > 0, each.mean((1, 2, 3)), 1.0)
                yield pa.RecordBatch.from_arrays([part.column("sample_id"), pa.array(score)], ["sample_id", "score"])

    schema = T.StructType([pairs.schema["sample_id"], T.StructField("score", T.DoubleType())])
    return maps.mapInArrow(run, schema)


def spearman_maps(pairs: DataFrame, channels: int = 1) -> DataFrame:
    """Spearman between two maps ``(sample_id, pos, a, b)``, channel-averaged first."""
    if channels > 1:
        pairs = (pairs.groupBy("sample_id", (F.col("pos") / F.lit(channels)).cast("int").alias("idx"))
                 .agg(F.avg("a").alias("a"), F.avg("b").alias("b")))
    else:
        pairs = pairs.withColumnRenamed("pos", "idx")
    return ordinal_spearman(pairs, "a", "b")


__all__ = [
    "metric_triplets", "complexity", "sparseness", "causal_curve", "curve_auc", "deletion", "insertion",
    "ordinal_spearman", "mu_fidelity", "ssim", "spearman_maps", "max_perturbed",
    "random_logit", "randomize_layers", "model_randomization", "subsample_first", "off_class",
]


# --- M10 random logit ----------------------------------------------------------------------

def random_logit(explainer, model: LinearSoftmaxModel, samples: DataFrame, targets: DataFrame,
                 maps_long: DataFrame, shape: Shape, seed: int = RANDOM_LOGIT_SEED, win: int = 11,
                 sigma: float = 1.5) -> DataFrame:
    """SSIM between the map of the predicted class and the map of a random other class.

    ``explainer(model, samples, targets) -> (sample_id, pos, e)`` is rerun with
    the off-class targets (D15); maps are compared as given (channels kept).
    """
    off = targets.select("sample_id", off_class(F.col("target"), model.n_classes, seed,
                                                F.col("sample_id")).alias("target"))
    other = explainer(model, samples, off)
    pairs = (maps_long.select("sample_id", "pos", F.col("e").alias("a"))
             .join(other.select("sample_id", "pos", F.col("e").alias("b")), ["sample_id", "pos"]))
    return ssim(pairs, shape, win, sigma)


# --- M11 / M12 model randomization ------------------------------------------------------

def layer_positions(weights: DataFrame, reverse: bool = False) -> DataFrame:
    """``(layer_idx, layer_name, place)``: the layers numbered in the order they are visited."""
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in ("layer_idx", "layer_name")]
    layers = weights.select("layer_idx", "layer_name").distinct()
    return layers.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def layers_before(layers: DataFrame, stop) -> DataFrame:
    """The rows of :func:`layer_positions` that precede ``stop``.

    Each given stop becomes one place: a name the place of its first layer, a
    whole number itself (from the end if negative), a share of the layers the
    whole part of that many.  Of several stops the earliest counts.
    """
    stops = stop if isinstance(stop, list) else [stop]
    exact = [s for s in stops if isinstance(s, (str, int)) and not isinstance(s, bool)]
    shares = [s for s in stops if isinstance(s, float) and not isinstance(stop, list)]
    if len(exact) + len(shares) != len(stops) or not stops:
        raise TypeError(f"cannot stop at {stop!r}: give a layer name, a number, a share, or a list of names and numbers")
    total = F.count(F.lit(1))
    wanted = [F.min(F.when(F.col("layer_name") == s, F.col("place"))) if isinstance(s, str) else
              F.floor(total * F.lit(s)) if isinstance(s, float) else F.lit(s) for s in stops]
    found = layers.agg(total.alias("total"), *[w.cast("long").alias(f"s{i}") for i, w in enumerate(wanted)]).first()
    unknown = [s for i, s in enumerate(stops) if found[f"s{i}"] is None]
    if unknown:
        raise ValueError(f"the model has no layer named {', '.join(map(repr, unknown))}")
    place = min(found[f"s{i}"] for i in range(len(stops)))
    return layers.where(F.col("place") < (place if place >= 0 else found["total"] + place))


def randomize_layers(weights: DataFrame, stop, reverse: bool = False, seed: int = 0) -> DataFrame:
    """The weights of all layers before ``stop`` (see :func:`layers_before`) replaced by U[0, 1).

    The table of layers is written once and read both for the stop and for the
    join, so the weights' own lineage runs once for it.
    """
    layers = materialize(layer_positions(weights, reverse))
    chosen = layers_before(layers, stop).select("layer_idx", F.lit(True).alias("_drawn"))
    u = hash_uniform(seed, F.col("layer_idx"), F.col("cls"), F.col("pos"))
    return (weights.join(chosen, "layer_idx", "left")
            .withColumn("w", F.when(F.col("_drawn"), u).otherwise(F.col("w"))).select(*weights.columns))


def model_randomization(explainer, model: LinearSoftmaxModel, samples: DataFrame, targets: DataFrame,
                        maps_long: DataFrame, stop=0.25, reverse: bool = False, seed: int = 42,
                        channels: int = 1) -> DataFrame:
    """Spearman between each map and the map of the same class under randomized weights."""
    randomized = model.with_weights(randomize_layers(model.weights, stop, reverse, seed))
    other = explainer(randomized, samples, targets)
    pairs = (maps_long.select("sample_id", "pos", F.col("e").alias("a"))
             .join(other.select("sample_id", "pos", F.col("e").alias("b")), ["sample_id", "pos"]))
    return spearman_maps(pairs, channels)


# --- P7 --------------------------------------------------------------------------------------

def subsample_first(df: DataFrame, n: int, key: str = "sample_id") -> DataFrame:
    """The first ``n`` samples by key (a top-n, planned as TakeOrderedAndProject)."""
    return df.orderBy(key).limit(n)


# --- M3 with a general scorer ---------------------------------------------------------------

def causal_curve_scored(fn, triplets: DataFrame, mode: str = "deletion", baseline=0.0, steps: int = 10,
                        max_pct: float = 1.0, channels: int = 1) -> DataFrame:
    """M3 for any batch scorer ``fn(X[n, d]) -> probs[n, c]`` (S3): ``(sample_id, k, score)``.

    The copies of the ranked path are made from the sample's row and scored in
    batches of bounded size (see :func:`salient.operators.copies.path_scores`);
    the linear scorer never needs this path (see :func:`causal_curve`).
    """
    rows, value = _metric_rows(triplets, channels, baseline)
    return path_scores(rows, fn, mode, steps, max_pct, value, channels).select("sample_id", F.posexplode("ys").alias("k", "score"))
