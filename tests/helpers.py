"""Hand-made fixtures: tiny models and samples with NumPy references."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from salient.operators.scoring import LinearSoftmaxModel


def weights_df(spark, W: np.ndarray, scale: np.ndarray | None = None):
    """Layer 0 = per-position scale, layer 1 = class weights W[c, pos]."""
    c, d = W.shape
    scale = np.ones(d) if scale is None else scale
    rows = [(0, "scale", -1, p, float(scale[p])) for p in range(d)]
    rows += [(1, "dense", k, p, float(W[k, p])) for k in range(c) for p in range(d)]
    return spark.createDataFrame(rows, "layer_idx INT, layer_name STRING, cls INT, pos INT, w DOUBLE")


def model(spark, W, tau=1.0):
    return LinearSoftmaxModel(weights_df(spark, W), tau)


def samples_df(spark, X: np.ndarray, labels=None):
    labels = labels if labels is not None else [0] * len(X)
    rows = [(i, [float(v) for v in X[i]], int(labels[i])) for i in range(len(X))]
    return spark.createDataFrame(rows, "sample_id BIGINT, x ARRAY<DOUBLE>, label INT").repartition(4, "sample_id")


def targets_df(spark, t):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(t)], "sample_id BIGINT, target INT")


def softmax(z):
    z = z - z.max(axis=-1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=-1, keepdims=True)


def maps_to_numpy(df, n, d, value="e"):
    out = np.zeros((n, d))
    for r in df.select("sample_id", "pos", value).collect():
        out[r["sample_id"], r["pos"]] = r[value]
    return out


def scores_to_numpy(df, n, value="score"):
    out = np.full(n, np.nan)
    for r in df.select("sample_id", value).collect():
        out[r["sample_id"]] = np.nan if r[value] is None else r[value]
    return out


def arrays_df(spark, maps: np.ndarray, col="e"):
    rows = [(i, [float(v) for v in maps[i]]) for i in range(len(maps))]
    return spark.createDataFrame(rows, f"sample_id BIGINT, {col} ARRAY<DOUBLE>")


def col(name):
    return F.col(name)
