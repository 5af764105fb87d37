"""Explainers against NumPy brute force on tiny fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from salient.functions.hashing import hash_normal
from salient.operators import designs as D
from salient.operators import estimators as X
from salient.operators import explainers as E
from salient.operators.masking import Shape
from tests.helpers import maps_to_numpy, model, samples_df, softmax, targets_df

RNG = np.random.default_rng(7)
W = RNG.normal(size=(3, 16))
XS = RNG.normal(size=(4, 16))
T = np.argmax(XS @ W.T, axis=1)
SHAPE = Shape(4, 4, 1)


def grad(x, t, Wm=W):
    p = softmax(Wm @ x)
    return p[t] * (Wm[t] - p @ Wm)


@pytest.fixture(scope="module")
def inputs(spark):
    return model(spark, W), samples_df(spark, XS), targets_df(spark, T)


def test_saliency_and_gradient_input(spark, inputs):
    mdl, smp, tgt = inputs
    sal = maps_to_numpy(E.saliency(mdl, smp, tgt), 4, 16)
    gi = maps_to_numpy(E.gradient_input(mdl, smp, tgt), 4, 16)
    for i in range(4):
        g = grad(XS[i], T[i])
        assert np.allclose(sal[i], np.abs(g), atol=1e-12)
        assert np.allclose(gi[i], XS[i] * g, atol=1e-12)
        # the closed form agrees with central differences
        h = 1e-6
        fd = np.array([(softmax(W @ (XS[i] + h * np.eye(16)[d]))[T[i]] - softmax(W @ (XS[i] - h * np.eye(16)[d]))[T[i]]) / (2 * h)
                       for d in range(16)])
        assert np.allclose(fd, g, atol=1e-8)


def test_integrated_gradients_trapezoid_and_completeness(spark, inputs):
    mdl, smp, tgt = inputs
    ig = maps_to_numpy(E.integrated_gradients(mdl, smp, tgt, steps=9, baseline=0.0), 4, 16)
    for i in range(4):
        gs = np.array([grad(a * XS[i], T[i]) for a in np.linspace(0, 1, 9)])
        ref = XS[i] * np.mean((gs[1:] + gs[:-1]) / 2, axis=0)
        assert np.allclose(ig[i], ref, atol=1e-12)
    fine = maps_to_numpy(E.integrated_gradients(mdl, smp, tgt, steps=400, baseline=0.0), 4, 16)
    for i in range(4):
        assert fine[i].sum() == pytest.approx(softmax(W @ XS[i])[T[i]] - softmax(W @ np.zeros(16))[T[i]], abs=1e-4)


def _noise(spark, draws, sigma, seed=0):
    df = spark.range(draws * 16).select((F.col("id") / 16).cast("int").alias("d"), (F.col("id") % 16).cast("int").alias("p"))
    eps = np.zeros((draws, 16))
    for r in df.select("d", "p", (F.lit(sigma) * hash_normal(seed, F.col("d"), F.col("p"))).alias("e")).collect():
        eps[r["d"], r["p"]] = r["e"]
    return eps


def test_noise_explainers(spark, inputs):
    mdl, smp, tgt = inputs
    eps = _noise(spark, 7, 0.4)
    sg = maps_to_numpy(E.smoothgrad(mdl, smp, tgt, nb_samples=7, sigma=0.4), 4, 16)
    sq = maps_to_numpy(E.squaregrad(mdl, smp, tgt, nb_samples=7, sigma=0.4), 4, 16)
    vg = maps_to_numpy(E.vargrad(mdl, smp, tgt, nb_samples=7, sigma=0.4), 4, 16)
    for i in range(4):
        gs = np.array([grad(XS[i] + eps[k], T[i]) for k in range(7)])
        assert np.allclose(sg[i], gs.mean(0), atol=1e-12)
        assert np.allclose(sq[i], (gs ** 2).mean(0), atol=1e-12)
        assert np.allclose(vg[i], gs.var(0), atol=1e-12)


def test_occlusion(spark, inputs):
    mdl, smp, tgt = inputs
    occ = maps_to_numpy(E.occlusion(mdl, smp, tgt, SHAPE, patch_size=2, patch_stride=2, occlusion_value=0.5), 4, 16)
    patches = []
    for r0 in (0, 2):
        for c0 in (0, 2):
            patches.append([(r0 + a) * 4 + c0 + b for a in range(2) for b in range(2)])
    for i in range(4):
        base = softmax(W @ XS[i])[T[i]]
        ref = np.zeros(16)
        for p in patches:
            x = XS[i].copy()
            x[p] = 0.5
            ref[p] = base - softmax(W @ x)[T[i]]
        assert np.allclose(occ[i], ref, atol=1e-12)


def _design(df, draws, cells, value="m"):
    out = np.zeros((draws, cells))
    for r in df.collect():
        out[r["draw"], r["cell"]] = r[value]
    return out


def test_rise(spark, inputs):
    mdl, smp, tgt = inputs
    got = maps_to_numpy(E.rise(mdl, smp, tgt, SHAPE, nb_samples=20, grid_size=2, preservation_probability=0.5,
                               mask_value=0.0, seed=3), 4, 16)
    m = _design(D.binary_design(spark, 20, 4, 0.5, seed=3), 20, 4)
    cell = np.array([(r // 2) * 2 + c // 2 for r in range(4) for c in range(4)])
    for i in range(4):
        y = np.array([softmax(W @ (XS[i] * m[k][cell]))[T[i]] for k in range(20)])
        num = (m * y[:, None]).sum(0)
        den = m.sum(0)
        ref = np.where(den > 0, num / np.where(den > 0, den, 1), 0.0)[cell]
        assert np.allclose(got[i], ref, atol=1e-12)


def test_lime_matches_numpy(spark, inputs):
    mdl, smp, tgt = inputs
    got = maps_to_numpy(E.lime(mdl, smp, tgt, SHAPE, nb_samples=40, grid_size=2, distance_mode="euclidean",
                               kernel_width=3.0, alpha=2.0, seed=1), 4, 16)
    Z = _design(D.binary_design(spark, 40, 4, 0.5, seed=1), 40, 4)
    cell = np.array([(r // 2) * 2 + c // 2 for r in range(4) for c in range(4)])
    for i in range(4):
        xs = np.array([XS[i] * z[cell] for z in Z])
        y = np.array([softmax(W @ x)[T[i]] for x in xs])
        w = np.exp(-np.sum((xs - XS[i]) ** 2, axis=1) / 9.0)
        # ridge with a free intercept through an augmented, unpenalised column
        A = np.hstack([Z, np.ones((40, 1))])
        P = np.diag([2.0] * 4 + [0.0])
        beta = np.linalg.solve(A.T @ (w[:, None] * A) + P, A.T @ (w * y))
        assert np.allclose(got[i], beta[:4][cell], atol=1e-9)


def test_similarity_fallback_and_width(spark):
    rows = [(0, d, 1e6, 1.0, 1.0, 1.0) for d in range(3)]
    df = spark.createDataFrame(rows, "sample_id BIGINT, draw INT, sq DOUBLE, xx DOUBLE, xp DOUBLE, pp DOUBLE")
    sims = [r["sim"] for r in X.similarity_weights(df, "euclidean", 1.0).collect()]
    assert sims == [1.0, 1.0, 1.0]  # every similarity underflows to 0 -> uniform weights
    sims = [r["sim"] for r in X.similarity_weights(df, "cosine", -5.0).collect()]
    assert sims == [1.0, 1.0, 1.0]  # cosine distance 0, width <= 0 -> 1e-8


def test_constrained_shap_exact_on_small_game():
    m = 4
    v = {s: float(len(s) ** 2 + (2 in s) * 3 + (0 in s and 1 in s)) for s in
         (frozenset(c) for k in range(m + 1) for c in itertools.combinations(range(m), k))}
    Z, y = [], []
    for s, val in v.items():
        if 0 < len(s) < m:
            Z.append([1.0 if j in s else 0.0 for j in range(m)])
            y.append(val)
    phi = X.constrained_shap(np.array(Z), np.array([y]), np.array([v[frozenset()]]), np.array([v[frozenset(range(m))]]))[0]
    exact = []
    for j in range(m):
        tot = 0.0
        for s, val in v.items():
            if j in s:
                continue
            wgt = math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m)
            tot += wgt * (v[s | {j}] - val)
        exact.append(tot)
    assert np.allclose(phi, exact, atol=1e-10)


def test_kernel_shap_efficiency(spark, inputs):
    mdl, smp, tgt = inputs
    got = maps_to_numpy(E.kernel_shap(mdl, smp, tgt, SHAPE, nb_samples=60, grid_size=2), 4, 16)
    for i in range(4):
        per_cell = got[i][[0, 2, 8, 10]]
        assert per_cell.sum() == pytest.approx(softmax(W @ XS[i])[T[i]] - softmax(W @ np.zeros(16))[T[i]], abs=1e-9)


def test_sobol_attribution_matches_rescoring(spark, inputs):
    mdl, smp, tgt = inputs
    got = maps_to_numpy(E.sobol_attribution(mdl, smp, tgt, SHAPE, grid_size=2, nb_design=8), 4, 16)
    a, b = D.sobol_ab(spark, 8, 4)
    A, B = _design(a, 8, 4), _design(b, 8, 4)
    cell = np.array([(r // 2) * 2 + c // 2 for r in range(4) for c in range(4)])
    from salient.operators.masking import _axis_weights
    R = np.zeros((4, 2))
    for o, ii, wv in _axis_weights(4, 2):
        R[o, ii] += wv
    for i in range(4):
        f = lambda m: softmax(W @ (XS[i] * m[cell]))[T[i]]
        ya = np.array([f(A[j]) for j in range(8)])
        sti = []
        for c in range(4):
            yc = []
            for j in range(8):
                m = A[j].copy()
                m[c] = B[j, c]
                yc.append(f(m))
            sti.append(np.sum((ya - np.array(yc)) ** 2) / (2 * 8 * ya.var(ddof=1)))
        heat = R @ np.array(sti).reshape(2, 2) @ R.T
        assert np.allclose(got[i], heat.reshape(-1), atol=1e-10)


def test_jansen_additive_function(spark):
    """Total indices of an additive function are its variance shares."""
    n, d = 4096, 3
    coef = np.array([1.0, 2.0, 3.0])
    ua = RNG.random((n, d))
    ub = RNG.random((n, d))
    ya = ua @ coef
    rows = []
    for i in range(d):
        uc = ua.copy()
        uc[:, i] = ub[:, i]
        yc = uc @ coef
        rows += [(0, j, i, float(ya[j]), float(yc[j])) for j in range(n)]
    df = spark.createDataFrame(rows, "sample_id BIGINT, draw INT, rep INT, ya DOUBLE, yc DOUBLE")
    got = {r["rep"]: r["v"] for r in df.groupBy("rep").agg(X.jansen_total_index(F.col("ya"), F.col("yc"), n).alias("v")).collect()}
    share = coef ** 2 / np.sum(coef ** 2)
    for i in range(d):
        assert got[i] == pytest.approx(share[i], abs=0.05)


def test_hsic_binary_closed_form():
    """For binary masks HSIC equals s_c^T L s_c / (2n) with s_c the centred sign column."""
    rng = np.random.default_rng(4)
    M = rng.integers(0, 2, size=(12, 5)).astype(float)
    y = rng.random(12)
    got = X.hsic_scores(M, y[None], "binary")[0]
    L = X.output_rbf(y)
    for i in range(5):
        s = 2 * M[:, i] - 1
        sc = s - s.mean()
        assert got[i] == pytest.approx(sc @ L @ sc / (2 * 12), abs=1e-12)


def test_hsic_attribution_matches_numpy(spark, inputs):
    mdl, smp, tgt = inputs
    got = maps_to_numpy(E.hsic_attribution(mdl, smp, tgt, SHAPE, grid_size=2, nb_design=8), 4, 16)
    Mb = _design(D.sobol_design(spark, 8, 4, binary=True), 8, 4)
    cell = np.array([(r // 2) * 2 + c // 2 for r in range(4) for c in range(4)])
    from salient.operators.masking import _axis_weights
    R = np.zeros((4, 2))
    for o, ii, wv in _axis_weights(4, 2):
        R[o, ii] += wv
    for i in range(4):
        y = np.array([softmax(W @ (XS[i] * m[cell]))[T[i]] for m in Mb])
        sc = X.hsic_scores(Mb, y[None], "binary")[0]
        assert np.allclose(got[i], (R @ sc.reshape(2, 2) @ R.T).reshape(-1), atol=1e-10)


@pytest.mark.parametrize("kind", ["binary", "rbf", "sobolev"])
def test_hsic_forms_agree(kind):
    """The quadratic form of binary masks and the tables of real ones equal the definition; a width of 0 is undefined."""
    rng = np.random.default_rng(9)
    for M in (rng.integers(0, 2, size=(14, 3)).astype(float), rng.random((14, 3))):
        ys = np.stack([rng.random(14), np.zeros(14), rng.random(14)])
        got = X.hsic_scores(M, ys, kind)
        H = np.eye(14) - 1 / 14
        k = X.input_kernel(kind)
        for y, row in zip(ys, got):
            if not y.any():
                assert np.isnan(row).all()
                continue
            L = X.output_rbf(y)
            want = [np.sum((H @ (1 + k(M[:, i][:, None], M[:, i][None, :])) @ H) * (H @ L @ H).T) / 14 for i in range(3)]
            assert np.allclose(row, want, atol=1e-12)


# --- any batch function as the model (S3) --------------------------------------------

V = RNG.normal(size=(5, 16))
U = RNG.normal(size=(3, 5))


def network(x):
    """A small net: nothing about it is linear."""
    return softmax(np.tanh(x @ V.T) @ U.T)


def brute(x, t, masks, cell, ref):
    return np.array([network((x * m[cell] + ref * (1 - m[cell]))[None])[0][t] for m in masks])


CELL = np.array([(r // 2) * 2 + c // 2 for r in range(4) for c in range(4)])


@pytest.fixture(params=[1 << 22, 40])
def held(request, monkeypatch):
    """All copies at once, and hardly any at once."""
    from salient.operators import copies
    monkeypatch.setattr(copies, "VALUES", request.param)
    monkeypatch.setattr(copies, "KEEP", 10 if request.param == 40 else 1 << 20)


def test_batch_functions_equal_the_linear_model(spark, inputs, held):
    mdl, smp, tgt = inputs
    fn = lambda x: softmax(x @ W.T)
    for run in (lambda m: E.occlusion(m, smp, tgt, SHAPE, patch_size=2, patch_stride=1, occlusion_value=0.3),
                lambda m: E.occlusion(m, smp, tgt, Shape(2, 4, 2), patch_size=2, patch_stride=1),
                lambda m: E.rise(m, smp, tgt, SHAPE, nb_samples=20, grid_size=2, mask_value=0.3),
                lambda m: E.lime(m, smp, tgt, SHAPE, nb_samples=30, grid_size=2, ref_value=0.2),
                lambda m: E.kernel_shap(m, smp, tgt, SHAPE, nb_samples=30, grid_size=2),
                lambda m: E.sobol_attribution(m, smp, tgt, SHAPE, grid_size=2, nb_design=8, perturbation="blurring"),
                lambda m: E.hsic_attribution(m, smp, tgt, SHAPE, grid_size=2, nb_design=16)):
        assert np.allclose(maps_to_numpy(run(mdl), 4, 16), maps_to_numpy(run(fn), 4, 16), atol=1e-9)


def test_explainers_of_a_network_match_rescoring(spark, inputs, held):
    _, smp, _ = inputs
    t = np.argmax(network(XS), axis=1)
    tgt = targets_df(spark, t)
    m = _design(D.binary_design(spark, 24, 4, 0.5, seed=2), 24, 4)
    rise = maps_to_numpy(E.rise(network, smp, tgt, SHAPE, nb_samples=24, grid_size=2, mask_value=0.1, seed=2), 4, 16)
    lime = maps_to_numpy(E.lime(network, smp, tgt, SHAPE, nb_samples=24, grid_size=2, ref_value=0.1, seed=2,
                                kernel=lambda sq, xx, xp, pp: 1.0 / (1.0 + sq)), 4, 16)
    half = lambda x: 0.5 * x
    a, b = D.sobol_ab(spark, 8, 4)
    A, B = _design(a, 8, 4), _design(b, 8, 4)
    sobol = maps_to_numpy(E.sobol_attribution(network, smp, tgt, Shape(2, 8, 1), grid_size=2, nb_design=8, perturbation=half), 4, 16)
    from salient.operators.masking import bicubic_matrix
    wide = np.array([(r * 2) + c // 4 for r in range(2) for c in range(8)])
    for i in range(4):
        y = brute(XS[i], t[i], m, CELL, 0.1)
        assert np.allclose(rise[i], ((m * y[:, None]).sum(0) / m.sum(0))[CELL], atol=1e-12)
        w = 1 / (1 + np.array([np.sum((XS[i] - (XS[i] * z[CELL] + 0.1 * (1 - z[CELL]))) ** 2) for z in m]))
        F1 = np.hstack([m, np.ones((24, 1))])
        beta = np.linalg.solve(F1.T @ (w[:, None] * F1) + np.diag([2.0] * 4 + [0.0]), F1.T @ (w * y))
        assert np.allclose(lime[i], beta[:4][CELL], atol=1e-9)
        ya = brute(XS[i], t[i], A, wide, half(XS[i]))
        total = []
        for c in range(4):
            C = A.copy()
            C[:, c] = B[:, c]
            total.append(np.sum((ya - brute(XS[i], t[i], C, wide, half(XS[i]))) ** 2) / (16 * ya.var(ddof=1)))
        assert np.allclose(sobol[i], bicubic_matrix(2, Shape(2, 8, 1)) @ np.array(total), atol=1e-10)


def test_segment_maps_of_each_sample(spark, inputs):
    mdl, smp, tgt = inputs
    own = [CELL, np.zeros(16, int), np.arange(16) % 3, np.arange(16)]
    table = spark.createDataFrame([(i, p, int(c)) for i, cells in enumerate(own) for p, c in enumerate(cells)], "sample_id BIGINT, pix INT, cell INT")
    got = maps_to_numpy(E.lime(mdl, smp, tgt, SHAPE, nb_samples=40, segments=table, seed=1), 4, 16)
    shap = maps_to_numpy(E.kernel_shap(mdl, smp.where("sample_id <> 1"), tgt, SHAPE, nb_samples=40, segments=table, seed=1), 4, 16)
    for i, cells in enumerate(own):
        one = smp.where(F.col("sample_id") == i)
        if i:  # a literal map gives the same as the sample's row of the table, whose design begins with the same columns
            Z = _design(D.binary_design(spark, 40, 16, 0.5, seed=1), 40, 16)[:, :cells.max() + 1]
            y = np.array([softmax(W @ (XS[i] * z[cells]))[T[i]] for z in Z])
            xs = np.array([XS[i] * z[cells] for z in Z])
            norm = np.linalg.norm(XS[i]) * np.linalg.norm(xs, axis=1)
            cos = np.divide(xs @ XS[i], norm, out=np.zeros(40), where=norm > 0)
            w = np.exp(-((1 - cos) ** 2) / 46.0 ** 2)
            A = np.hstack([Z, np.ones((40, 1))])
            P = np.diag([2.0] * Z.shape[1] + [0.0])
            beta = np.linalg.solve(A.T @ (w[:, None] * A) + P, A.T @ (w * y))
            assert np.allclose(got[i], beta[:-1][cells], atol=1e-9)
        if i == 0:
            assert got[i][[0, 2, 8, 10]].std() > 0 and len(set(np.round(got[i], 12))) <= 4 and one.count() == 1
        if i in (0, 2):
            first = [int(np.flatnonzero(cells == c)[0]) for c in range(cells.max() + 1)]
            assert shap[i][first].sum() == pytest.approx(softmax(W @ XS[i])[T[i]] - softmax(W @ np.zeros(16))[T[i]], abs=1e-9)
    with pytest.raises(Exception, match="has no segment map"):
        E.lime(mdl, smp, tgt, SHAPE, nb_samples=5, segments=table.where("sample_id < 3")).collect()
    with pytest.raises(ValueError, match="segment numbers"):
        E.lime(mdl, smp, tgt, SHAPE, nb_samples=5, segments=[0, 1])


def test_lime_reference_of_each_channel(spark, inputs):
    mdl, smp, tgt = inputs
    shape = Shape(2, 4, 2)
    got = maps_to_numpy(E.lime(mdl, smp, tgt, shape, nb_samples=30, grid_size=2, distance_mode="euclidean", kernel_width=2.0, ref_value=[0.1, -0.4], seed=3), 4, 16)
    cells = np.repeat(np.array([(r * 2) + c // 2 for r in range(2) for c in range(4)]), 2)
    ref = np.tile([0.1, -0.4], 8)
    Z = _design(D.binary_design(spark, 30, 4, 0.5, seed=3), 30, 4)
    for i in range(4):
        xs = np.array([XS[i] * z[cells] + ref * (1 - z[cells]) for z in Z])
        y = np.array([softmax(W @ x)[T[i]] for x in xs])
        w = np.exp(-np.sum((xs - XS[i]) ** 2, axis=1) / 4.0)
        A = np.hstack([Z, np.ones((30, 1))])
        beta = np.linalg.solve(A.T @ (w[:, None] * A) + np.diag([2.0] * 4 + [0.0]), A.T @ (w * y))
        assert np.allclose(got[i], beta[:4][cells], atol=1e-9)
    with pytest.raises(ValueError, match="reference values"):
        E.lime(mdl, smp, tgt, shape, nb_samples=5, grid_size=2, ref_value=[0.1])


def peak_mb(work) -> float:
    import tracemalloc
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 2 ** 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("kind", ["rbf", "sobolev"])
def test_hsic_of_real_masks_by_tables(monkeypatch, kind):
    """the input kernels are made once for all samples, whatever the size of the tables."""
    rng = np.random.default_rng(5)
    z, y = rng.random((23, 4)), rng.random((9, 23)) + 0.1
    y[4] = 0.0
    k = X.input_kernel(kind)
    want = np.full((9, 4), np.nan)
    for i in range(9):
        if X.output_rbf(y[i]) is not None:
            want[i] = [(X.centred(1.0 + k(z[:, c][:, None], z[:, c][None, :])) * X.output_rbf(y[i])).sum() / 23 for c in range(4)]
    for values, kept in ((1 << 20, 1 << 23), (200, 1 << 23), (1, 0)):
        monkeypatch.setattr(X, "PAIR_VALUES", values)
        monkeypatch.setattr(X, "PAIRS_KEPT", kept)
        monkeypatch.setattr(X, "PAIR_SAMPLES", 4)
        tables = X.InputKernels(z, kind)
        np.testing.assert_allclose(X.hsic_scores(z, y, kind, tables), want, rtol=0, atol=1e-13)
        made = []
        monkeypatch.setattr(tables, "kernel", lambda a, b: made.append(1) or k(a, b))
        np.testing.assert_allclose(X.hsic_scores(z, y, kind, tables), want, rtol=0, atol=1e-13)
        assert bool(made) == (not kept)


@pytest.mark.parametrize("binary", [True, False])
def test_hsic_holds_no_kernel_for_each_sample(binary):
    """300 output kernels of 300 x 300 were held together (208 MB, and 618 MB for real masks)."""
    z = np.random.default_rng(1).random((300, 5))
    y = np.random.default_rng(2).random((300, 300)) + 0.1
    assert peak_mb(lambda: X.hsic_scores(np.round(z) if binary else z, y, "rbf")) < 60


@pytest.mark.parametrize("name", ["smoothgrad", "lime"])
def test_explainers_hold_little(spark, monkeypatch, name):
    """one full Arrow batch of samples at the benchmark's draws took 142 MB (smoothgrad), 1,000 samples 147 MB (lime)."""
    import pyarrow as pa
    mdl = model(spark, RNG.normal(size=(10, 64)))
    smp, tgt = samples_df(spark, RNG.normal(size=(2, 64))), targets_df(spark, [0, 1])
    found, frame = [], type(smp)
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, fn, *a, **kw: found.append(fn) or plain(self, fn, *a, **kw))
    if name == "smoothgrad":
        E.smoothgrad(mdl, smp, tgt, **E.SMOOTHGRAD)
    else:
        E.lime(lambda x: np.full((len(x), 10), 0.1), smp, tgt, Shape(8, 8, 1), grid_size=8, **E.LIME)
    n = 10000 if name == "smoothgrad" else 1000
    x = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 64, pa.int32()), pa.array(np.zeros(n * 64)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), x, pa.array(np.zeros(n, np.int32))], ["sample_id", "x", "target"])
    assert peak_mb(lambda: sum(b.num_rows for b in found[-1](iter([batch])))) < 110
