"""Metric invariants and NumPy references on hand-made fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from salient.operators import metrics as M
from salient.operators.masking import Shape
from tests.helpers import arrays_df, model, samples_df, scores_to_numpy, softmax, targets_df


def test_complexity_and_sparseness_invariants(spark):
    n = 16
    maps = np.array([np.eye(n)[3], np.ones(n), np.zeros(n), [1.0, 1.0, 2.0, 2.0] * 4])
    df = arrays_df(spark, maps)
    ent = scores_to_numpy(M.complexity(df), 4)
    gin = scores_to_numpy(M.sparseness(df), 4)
    assert ent[0] == pytest.approx(0.0, abs=1e-6)
    assert ent[1] == pytest.approx(math.log(n), abs=1e-6)
    assert gin[0] == pytest.approx((n - 1) / n, abs=1e-5)
    assert gin[1] == pytest.approx(0.0, abs=1e-6)
    assert gin[2] == pytest.approx(0.0, abs=1e-6)  # all-zero map: uniform after the +1e-7 shift
    p = np.abs(maps[3]) / (np.abs(maps[3]).sum() + 1e-8)
    s = np.sort(p) + 1e-7
    ref = np.sum((2 * np.arange(1, n + 1) - n - 1) * s) / (s.sum() * n)
    assert gin[3] == pytest.approx(ref, abs=1e-12)


def test_channel_reduce_matches_mean(spark):
    x = np.arange(16, dtype=float).reshape(1, 16)  # 2x2x4
    from salient.functions.arrays import channel_reduce
    got = arrays_df(spark, x).select(channel_reduce("e", 4).alias("v")).first()["v"]
    assert got == pytest.approx(x.reshape(4, 4).mean(axis=1).tolist())


def _causal_numpy(W, x, e, t, mode, baseline, steps, max_pct=1.0):
    n = x.size
    max_n = int(math.floor(n * max_pct))
    order = np.lexsort((np.arange(n), -e))
    rank = np.empty(n, dtype=int)
    rank[order] = np.arange(n)
    inp, base = (np.full(n, baseline), x) if mode == "deletion" else (x, np.full(n, baseline))
    out = []
    for k in range(steps):
        thr = k * (max_n - 1) // (steps - 1)
        pert = np.where(rank <= thr, inp, base)
        out.append(softmax(W @ pert)[t])
    out = np.array(out)
    return out, np.mean((out[1:] + out[:-1]) / 2)


@pytest.mark.parametrize("mode", ["deletion", "insertion"])
def test_causal_curve_matches_rescoring(spark, mode):
    rng = np.random.default_rng(0)
    W = rng.normal(size=(3, 9))
    X = rng.normal(size=(5, 9))
    E = rng.normal(size=(5, 9))
    t = np.argmax(X @ W.T, axis=1)
    mdl = model(spark, W)
    trip = (samples_df(spark, X).join(targets_df(spark, t), "sample_id")
            .join(arrays_df(spark, E), "sample_id"))
    curve = M.causal_curve(mdl, trip, mode, 0.3, 6).collect()
    auc = scores_to_numpy(M.curve_auc(M.causal_curve(mdl, trip, mode, 0.3, 6), 6), 5)
    for r in curve:
        ref, _ = _causal_numpy(W, X[r["sample_id"]], E[r["sample_id"]], t[r["sample_id"]], mode, 0.3, 6)
        assert r["score"] == pytest.approx(ref[r["k"]], abs=1e-12)
    for i in range(5):
        assert auc[i] == pytest.approx(_causal_numpy(W, X[i], E[i], t[i], mode, 0.3, 6)[1], abs=1e-12)


def test_deletion_curve_ends_at_baseline_score(spark):
    rng = np.random.default_rng(1)
    W, X = rng.normal(size=(4, 8)), rng.normal(size=(3, 8))
    t = np.argmax(X @ W.T, axis=1)
    trip = (samples_df(spark, X).join(targets_df(spark, t), "sample_id")
            .join(arrays_df(spark, rng.normal(size=(3, 8))), "sample_id"))
    curve = M.causal_curve(model(spark, W), trip, "deletion", 0.0, 5).filter(F.col("k") == 4).collect()
    for r in curve:
        assert r["score"] == pytest.approx(softmax(W @ np.zeros(8))[t[r["sample_id"]]], abs=1e-12)


def test_ordinal_spearman(spark):
    rows = [(0, i, float(i), float(i)) for i in range(10)] + [(1, i, float(i), float(-i)) for i in range(10)]
    rows += [(2, i, 1.0, float(i)) for i in range(5)]  # ties broken by index -> identical ranks
    df = spark.createDataFrame(rows, "sample_id BIGINT, idx INT, a DOUBLE, b DOUBLE")
    s = scores_to_numpy(M.ordinal_spearman(df, "a", "b"), 3)
    assert s.tolist() == pytest.approx([1.0, -1.0, 1.0])


def _ssim_numpy(a, b, win, sigma, h, w):
    coords = np.arange(win) - (win - 1) / 2
    g = np.exp(-0.5 * coords ** 2 / sigma ** 2)
    g /= g.sum()
    k = np.outer(g, g)
    A, B = a.reshape(h, w), b.reshape(h, w)
    L = max(a.max(), b.max()) - min(a.min(), b.min())
    if L == 0:
        return 1.0
    c1, c2 = (0.01 * L) ** 2, (0.03 * L) ** 2
    vals = []
    for i in range(h - win + 1):
        for j in range(w - win + 1):
            pa, pb = A[i:i + win, j:j + win], B[i:i + win, j:j + win]
            ma, mb = (k * pa).sum(), (k * pb).sum()
            m2, mab = (k * (pa * pa + pb * pb)).sum(), (k * pa * pb).sum()
            vals.append((2 * ma * mb + c1) / (ma * ma + mb * mb + c1) * (2 * mab - 2 * ma * mb + c2) / (m2 - ma * ma - mb * mb + c2))
    return float(np.mean(vals))


def test_ssim_matches_numpy_and_identity(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(3, 36)), rng.normal(size=(3, 36))
    b[2] = a[2]
    a[1] = b[1] = 0.5  # zero dynamic range -> 1.0
    rows = [(i, p, float(a[i, p]), float(b[i, p])) for i in range(3) for p in range(36)]
    pairs = spark.createDataFrame(rows, "sample_id BIGINT, pos INT, a DOUBLE, b DOUBLE")
    got = scores_to_numpy(M.ssim(pairs, Shape(6, 6, 1), win=3), 3)
    assert got[0] == pytest.approx(_ssim_numpy(a[0], b[0], 3, 1.5, 6, 6), abs=1e-12)
    assert got[1] == 1.0
    assert got[2] == pytest.approx(1.0, abs=1e-12)


def test_mu_fidelity_matches_rescoring(spark):
    rng = np.random.default_rng(3)
    W, X, E = rng.normal(size=(3, 16)), rng.normal(size=(4, 16)), rng.normal(size=(4, 16))
    t = np.argmax(X @ W.T, axis=1)
    trip = (samples_df(spark, X).join(targets_df(spark, t), "sample_id")
            .join(arrays_df(spark, E), "sample_id"))
    shape = Shape(4, 4, 1)
    got = scores_to_numpy(M.mu_fidelity(model(spark, W), trip, shape, 2, 0.3, 0.0, 12, seed=5), 4)
    design = {(r["draw"], r["cell"]): r["m"] for r in M.random_grid_mask(spark, 2, 0.3, 12, seed=5).collect()}
    cell = np.array([(r // 2) * 2 + (c // 2) for r in range(4) for c in range(4)])
    for i in range(4):
        base = softmax(W @ X[i])[t[i]]
        attr, delta = [], []
        for k in range(12):
            m = np.array([design[(k, cell[p])] for p in range(16)])
            delta.append(base - softmax(W @ (X[i] * m))[t[i]])
            attr.append(float(np.sum(E[i] * (1 - m))))
        ra = np.lexsort((np.arange(12), attr)).argsort()
        rb = np.lexsort((np.arange(12), delta)).argsort()
        ref = 1 - 6 * np.sum((ra - rb) ** 2) / (12 * (12 ** 2 - 1))
        assert got[i] == pytest.approx(ref, abs=1e-12)


def test_randomize_layers_resolution(spark):
    from tests.helpers import weights_df
    w = weights_df(spark, np.ones((2, 3)))
    assert M.randomize_layers(w, 0).filter(F.col("w") != 1.0).count() == 0
    assert M.randomize_layers(w, 1).filter((F.col("w") != 1.0) & (F.col("layer_idx") == 0)).count() == 3
    assert M.randomize_layers(w, "dense").filter(F.col("layer_idx") == 1).filter(F.col("w") != 1.0).count() == 0
    assert M.randomize_layers(w, 1.0).filter(F.col("w") != 1.0).count() == 9
    assert M.randomize_layers(w, 0.4).filter(F.col("w") != 1.0).count() == 0  # int(2 * 0.4) = 0
    assert M.randomize_layers(w, ["dense", 1]).filter(F.col("w") != 1.0).count() == 3
    assert M.randomize_layers(w, 1, reverse=True).filter(
        (F.col("w") != 1.0) & (F.col("layer_idx") == 1)).count() == 6
    with pytest.raises(ValueError):
        M.randomize_layers(w, "missing")
    with pytest.raises(TypeError):
        M.randomize_layers(w, [1.5])


def test_general_scorer_curve_matches_linear_rewrite(spark):
    """The explicit-copy path (any NumPy scorer, mapInPandas) equals the running-sum rewrite."""
    from salient.operators.scoring import numpy_linear_softmax
    rng = np.random.default_rng(11)
    W, X = rng.normal(size=(3, 16)), rng.normal(size=(4, 16))
    E = rng.normal(size=(4, 4))  # 2x2 pixels x 4 channels -> map per pixel after channel mean
    E4 = np.repeat(E, 4, axis=1)
    t = np.argmax(X @ W.T, axis=1)
    trip = (samples_df(spark, X).join(targets_df(spark, t), "sample_id")
            .join(arrays_df(spark, E4), "sample_id"))
    lin = {(r["sample_id"], r["k"]): r["score"] for r in
           M.causal_curve(model(spark, W), trip, "deletion", 0.0, 4, channels=4).collect()}
    gen = {(r["sample_id"], r["k"]): r["score"] for r in
           M.causal_curve_scored(numpy_linear_softmax(W), trip, "deletion", 0.0, 4, channels=4).collect()}
    assert lin.keys() == gen.keys() and len(lin) == 16
    assert all(abs(lin[k] - gen[k]) < 1e-12 for k in lin)
