"""Scorers and targets.

A scorer maps inputs to class probabilities.  Two kinds:

* :class:`LinearSoftmaxModel` — a parameter table ``weights(layer_idx,
  layer_name, cls, pos, w)``.  Logits are ``tau * sum_pos scale[pos] *
  w[cls, pos] * x[pos]`` and are computed by an equi-join on ``pos`` and a
  group-by; because the model is linear in ``x``, perturbation metrics use
  running sums and cell sums of ``w * delta`` instead of rescoring copies.
* :func:`udf_scorer` — any vectorised Python function over a batch of inputs,
  run with ``mapInPandas`` (Arrow batches).

The effective weight table has one row per (class, position); its size is
proven by one small aggregate before it is broadcast, and above
``BROADCAST_ROWS`` the joins fall back to shuffled joins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salient.functions.arrays import to_long
from salient.session import ensure_checkpoint_dir, scratch_path

BROADCAST_ROWS = 4_000_000  # ~100 MB of (cls, pos, w) rows


def maybe_broadcast(df: DataFrame, rows: int, limit: int | None = None) -> DataFrame:
    """Broadcast only a side whose row count is known and under the limit."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if limit is None else limit) else df


class LinearSoftmaxModel:
    """Table-driven classifier with a softmax head (the model of S2)."""

    def __init__(self, weights: DataFrame, tau: float = 10.0):
        # The layer table is written once to the shared checkpoint folder: the model's
        # own weights, and those of its randomized versions, come from it.
        ensure_checkpoint_dir(weights.sparkSession)
        weights = self.weights = weights.checkpoint(eager=True)
        self.tau = float(tau)
        cls_layer = weights.filter(F.col("cls") >= 0).select("cls", "pos", "w")
        scales = (weights.filter(F.col("cls") < 0)
                  .groupBy("pos").agg(F.product("w").alias("s")))
        W = (cls_layer.join(scales, "pos", "left")
             .select("cls", "pos",
                     (F.lit(self.tau) * F.coalesce(F.col("s"), F.lit(1.0)) * F.col("w")).alias("w")))
        # The effective weights are the model: computed once and written to the
        # shared checkpoint folder, so every later join reads a small table
        # instead of recomputing it from the inputs (and survives lost executors).
        self._W = W.checkpoint(eager=True)
        shape = self._W.agg(F.count_distinct("cls").alias("c"), F.count_distinct("pos").alias("d"),
                            F.count(F.lit(1)).alias("n")).first()
        self.n_classes, self.n_pos, self.n_rows = int(shape["c"]), int(shape["d"]), int(shape["n"])

    # --- parameter views -----------------------------------------------------
    def W(self) -> DataFrame:
        """Effective weights ``(cls, pos, w)``, broadcast when the proven size allows."""
        return maybe_broadcast(self._W, self.n_rows)

    def W_target(self) -> DataFrame:
        """``(pos, target, wt)``: the weights of a row's own target class (join on both keys)."""
        return maybe_broadcast(self._W.select("pos", F.col("cls").alias("target"), F.col("w").alias("wt")),
                               self.n_rows)

    def relative_rows(self, rows: DataFrame) -> DataFrame:
        """Attach ``(cls, w)`` with ``w = w[cls, pos] - w[target, pos]`` to rows with ``pos`` and ``target``.

        Logits relative to the target, ``r_c = z_c - z_t``, give the target
        probability as ``1 / (1 + sum_{c != t} exp(r_c))`` — one hash aggregate
        with no max-shift pass (an overflow to +inf correctly yields 0).  The
        target's own class is dropped (its relative logit is always 0).
        """
        return (rows.join(self.W(), "pos").filter(F.col("cls") != F.col("target"))
                .join(self.W_target(), ["pos", "target"])
                .withColumn("w", F.col("w") - F.col("wt")).drop("wt"))

    def with_weights(self, weights: DataFrame) -> "LinearSoftmaxModel":
        return LinearSoftmaxModel(weights, self.tau)

    # --- scoring ---------------------------------------------------------------
    def logits_long(self, long_x: DataFrame, keys=("sample_id",), value: str = "x") -> DataFrame:
        """``(keys, pos, x)`` -> ``(keys, cls, z)``; map-side partial sums per key."""
        return (long_x.join(self.W(), "pos")
                .groupBy(*keys, "cls").agg(F.sum(F.col(value) * F.col("w")).alias("z")))

    def logits(self, samples: DataFrame, x_col: str = "x", keys=("sample_id",)) -> DataFrame:
        return self.logits_long(to_long(samples, x_col, "x", keys=keys), keys=keys)


def weights_from_centroids(samples: DataFrame, x_col: str = "x", label_col: str = "label") -> DataFrame:
    """S2 parameter table: layer 0 = per-position scale (ones), layer 1 = class centroids.

    Centroids are a partial/final aggregate per (label, pos), so a label holding
    a third of the rows only adds map-side partial rows.
    """
    long = samples.select(F.col(label_col).alias("cls"), F.posexplode(x_col).alias("pos", "v"))
    centroid = long.groupBy("cls", "pos").agg(F.avg("v").alias("w"))
    layer1 = centroid.select(F.lit(1).alias("layer_idx"), F.lit("centroids").alias("layer_name"),
                             "cls", "pos", "w")
    layer0 = (centroid.select("pos").distinct()
              .select(F.lit(0).alias("layer_idx"), F.lit("scale").alias("layer_name"),
                      F.lit(-1).alias("cls"), "pos", F.lit(1.0).alias("w")))
    return layer0.unionByName(layer1)


def class_probabilities(z: DataFrame, keys=("sample_id",)) -> DataFrame:
    """Softmax over classes per key: ``(keys, cls, z)`` -> ``(keys, cls, z, p)``."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys)
    m = F.max("z").over(w)
    e = F.exp(F.col("z") - m)
    return z.withColumn("p", e / F.sum(e).over(w))


def target_probability(z: DataFrame, keys, target_col: str = "target") -> DataFrame:
    """S1 on logits: ``p_target`` per key from ``(keys, cls, z, target)``.

    One hash aggregate: the group is one sample's class logits (bounded by the
    class count), softmax is then evaluated on that small array.
    """
    agg = (z.groupBy(*keys)
           .agg(F.collect_list("z").alias("_zs"), F.max("z").alias("_m"),
                F.max(F.when(F.col("cls") == F.col(target_col), F.col("z"))).alias("_zt")))
    denom = F.aggregate("_zs", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("_m")))
    return agg.select(*keys, (F.exp(F.col("_zt") - F.col("_m")) / denom).alias("score"))


def prob_from_relative(r: str = "z") -> Column:
    """Aggregate: target probability from relative logits of the other classes."""
    return F.lit(1.0) / (F.lit(1.0) + F.coalesce(F.sum(F.exp(F.col(r))), F.lit(0.0)))


def predictions(model: LinearSoftmaxModel, samples: DataFrame) -> DataFrame:
    """``(sample_id, pred, p_pred, one_hot)``; ties go to the lowest class."""
    z = model.logits(samples)
    probs = class_probabilities(z)
    agg = probs.groupBy("sample_id").agg(
        F.max_by("cls", F.struct(F.col("z"), -F.col("cls"))).alias("pred"),
        F.max("p").alias("p_pred"))
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(model.n_classes - 1)),
                          lambda i: F.when(i == F.col("pred"), 1.0).otherwise(0.0))
    return agg.select("sample_id", "pred", "p_pred", one_hot.alias("one_hot"))


def target_scores(model: LinearSoftmaxModel, samples: DataFrame, targets: DataFrame,
                  x_col: str = "x") -> DataFrame:
    """g(f, x, y) = f(x)[target] for ``targets(sample_id, target)``."""
    z = model.logits(samples, x_col).join(targets, "sample_id")
    return target_probability(z, ["sample_id"])


def one_hot_dot(probs: Column, one_hot: Column) -> Column:
    """S1 for soft targets: sum_c p_c * y_c on two arrays."""
    return F.aggregate(F.zip_with(probs, one_hot, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def udf_scorer(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], keys=("sample_id",),
               x_col: str = "x", target_col: str = "target") -> DataFrame:
    """S3: score inputs with any batch function ``fn(X[n, d]) -> probs[n, c]``.

    Runs in ``mapInPandas``: Arrow batches of ``spark.sql.execution.arrow.
    maxRecordsPerBatch`` rows replace the reference's batch loop; the result is
    ``(keys, score)`` with score = probs[target].
    """
    keys = list(keys)
    schema = ", ".join([f"{k} {t}" for k, t in df.select(*keys).dtypes] + ["score double"])

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf[x_col].to_numpy())
            probs = np.asarray(fn(X), dtype=np.float64)
            t = pdf[target_col].to_numpy().astype(np.int64)
            out = pdf[keys].copy()
            out["score"] = probs[np.arange(len(t)), t]
            yield out

    return df.select(*keys, x_col, target_col).mapInPandas(run, schema)


def numpy_linear_softmax(W: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A batch function equivalent to a linear-softmax model (for S3 and tests)."""
    def fn(X: np.ndarray) -> np.ndarray:
        z = X @ W.T
        z = z - z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)
    return fn


def filesystem(uri: str):
    """The pyarrow file system and path of a folder in the shared storage, given with its scheme."""
    import pyarrow.fs as pafs
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class SharedLinearSoftmax:
    """A linear-softmax model as a batch function whose weights lie in the shared folder.

    The weights are written once as a table; each worker process reads them
    when it scores its first batch, so neither the driver nor the task closure
    holds the model.
    """

    def __init__(self, model: LinearSoftmaxModel):
        self.path = scratch_path(model._W.sparkSession, "scorer")
        self.shape = (model.n_classes, model.n_pos)
        model._W.select("cls", "pos", "w").write.parquet(self.path)
        self._fn = None

    def __getstate__(self):
        return {"path": self.path, "shape": self.shape, "_fn": None}

    def __call__(self, X: np.ndarray) -> np.ndarray:
        if self._fn is None:
            import pyarrow.dataset as ds
            fs, root = filesystem(self.path)
            W = np.zeros(self.shape)
            for batch in ds.dataset(root, filesystem=fs, format="parquet", exclude_invalid_files=True).to_batches():
                cls, pos, w = (batch.column(c).to_numpy() for c in ("cls", "pos", "w"))
                W[cls, pos] = w
            self._fn = numpy_linear_softmax(W)
        return self._fn(X)


__all__ = [
    "SharedLinearSoftmax",
    "LinearSoftmaxModel", "weights_from_centroids", "class_probabilities", "target_probability",
    "predictions", "target_scores", "udf_scorer", "numpy_linear_softmax", "one_hot_dot",
]
