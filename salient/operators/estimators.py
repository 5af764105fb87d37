"""Estimators of the perturbation explainers (E9, E10a, E10b, E11a, E12a-c).

Each works on a block of samples at once: ``y`` is (samples, draws), the scores
of every sample's copies, and ``z`` (draws, cells) the design they share.  What
depends on the design alone (the Shapley solve, the centred mask signs, input
kernels) is worked out once for a block; what depends on a sample is a product
of its scores with that.  The similarity kernel and the Jansen index also exist
as column expressions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KERNEL_WIDTH_EPS = 1e-8  # fixed: width <= 0 falls back to this value


# --- E10a similarity kernel ----------------------------------------------------------

def exp_kernel(distance: Column, width: float) -> Column:
    """``exp(-D^2 / max(w^2, 1e-8))``; a width <= 0 becomes 1e-8."""
    w = float(width) if width > 0 else KERNEL_WIDTH_EPS
    return F.exp(-(distance * distance) / F.lit(max(w * w, KERNEL_WIDTH_EPS)))


def similarity_weights(draw_sums: DataFrame, mode: str, width: float, reference_sign: bool = False,
                       keep=()) -> DataFrame:
    """``(sample_id, draw, sim)`` from per-draw sums.

    ``draw_sums`` carries ``sq`` (squared euclidean distance), ``xx`` (|x|^2),
    ``xp`` (x . x') and ``pp`` (|x'|^2).  Cosine distance is ``1 - cos`` (or
    ``1 + cos`` with ``reference_sign``, the sign convention of a loss-style
    cosine similarity).  When all similarities of a sample are 0 every weight
    becomes 1.  ``keep`` columns are carried along (a window, not a join).
    """
    if mode == "euclidean":
        dist = F.sqrt(F.greatest(F.col("sq"), F.lit(0.0)))
    elif mode == "cosine":
        cos = F.coalesce(F.col("xp") / F.nullif(F.sqrt(F.col("xx")) * F.sqrt(F.col("pp")), F.lit(0.0)), F.lit(0.0))
        dist = (F.lit(1.0) + cos) if reference_sign else (F.lit(1.0) - cos)
    else:
        raise ValueError(f"unknown distance {mode!r}: cosine or euclidean")
    sim = exp_kernel(dist, width)
    total = F.sum(sim).over(Window.partitionBy("sample_id"))
    return draw_sums.select("sample_id", "draw", *keep, F.when(total == 0, F.lit(1.0)).otherwise(sim).alias("sim"))


def similarity_arrays(mode: str, width: float, sq: np.ndarray, xx: np.ndarray, xp: np.ndarray, pp: np.ndarray,
                      reference_sign: bool = False) -> np.ndarray:
    """E10a on (samples, draws) sums, as :func:`similarity_weights`."""
    if mode == "euclidean":
        dist = np.sqrt(np.maximum(sq, 0.0))
    elif mode == "cosine":
        size = np.sqrt(xx) * np.sqrt(np.maximum(pp, 0.0))
        cos = np.divide(xp, size, out=np.zeros(np.broadcast(xp, size).shape), where=size != 0)
        dist = 1.0 + cos if reference_sign else 1.0 - cos
    else:
        raise ValueError(f"unknown distance {mode!r}: cosine or euclidean")
    w = float(width) if width > 0 else KERNEL_WIDTH_EPS
    sim = np.exp(-(dist * dist) / max(w * w, KERNEL_WIDTH_EPS))
    return np.where(sim.sum(1, keepdims=True) == 0, 1.0, sim)


# --- E10b / E9 weighted least squares ------------------------------------------------------

def weighted_ridge(z: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    """(samples, cells) ridge coefficients with a free intercept and sample weights ``w`` (samples, draws).

    Each sample's sufficient statistics (weighted means, ``Z'WZ`` and ``Z'Wy``) are
    centred normal equations, solved for all samples of the block together.
    """
    total = w.sum(1)
    wz = w @ z
    zbar, ybar = wz / total[:, None], (w * y).sum(1) / total
    gram = np.matmul(z.T[None, :, :] * w[:, None, :], z) - wz[:, :, None] * zbar[:, None, :]
    right = (w * y) @ z - wz * ybar[:, None]
    return np.linalg.solve(gram + alpha * np.eye(z.shape[1]), right[:, :, None])[:, :, 0]


def shapley_kernel_weight(m: int, k: np.ndarray) -> np.ndarray:
    """``(M-1) / (C(M,k) k (M-k))`` for 0 < k < M."""
    comb = np.array([math.comb(m, int(v)) for v in k], dtype=float)
    return (m - 1) / (comb * k * (m - k))


def shapley_solution(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the design alone decides: (draws that count, the solve as one matrix, their last column).

    The last coefficient is eliminated by the constraint, so the others are
    ``solve @ (y - f_empty - last * total)``.
    """
    m = z.shape[1]
    k = z.sum(1)
    use = (k > 0) & (k < m)
    body, w = z[use], shapley_kernel_weight(m, k[use])
    a = body[:, :-1] - body[:, -1:]
    # weights span many orders of magnitude; their scale cancels
    w = w / w.max() if len(w) else w
    return use, np.linalg.lstsq((a * w[:, None]).T @ a, (a * w[:, None]).T, rcond=None)[0] if len(w) else np.zeros((m - 1, 0)), body[:, -1]


def constrained_shap(z: np.ndarray, y: np.ndarray, f_empty: np.ndarray, f_full: np.ndarray) -> np.ndarray:
    """(samples, cells) Shapley-kernel coefficients with ``sum(phi) = f(x) - f(empty)``."""
    use, solve, last = shapley_solution(z)
    total = f_full - f_empty
    phi = (y[:, use] - f_empty[:, None] - last * total[:, None]) @ solve.T
    return np.concatenate([phi, (total - phi.sum(1))[:, None]], axis=1)


# --- M8 ----------------------------------------------------------------------------------

def spearman_arrays(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """M8 on (samples, n) arrays: ordinal Spearman of each row, ties ranked by place; NaN for n < 2."""
    n = a.shape[1]
    if n < 2:
        return np.full(len(a), np.nan)
    ranks = []
    for v in (a, b):
        rank = np.empty(v.shape, np.int64)
        np.put_along_axis(rank, np.argsort(v, axis=1, kind="stable"), np.arange(n)[None, :], axis=1)
        ranks.append(rank)
    return 1.0 - 6.0 * ((ranks[0] - ranks[1]) ** 2).sum(1) / (n * (float(n) * n - 1.0))


# --- E11a Jansen -------------------------------------------------------------------------

def jansen_total_index(ya: Column, yc: Column, n: int) -> Column:
    """E11a aggregate over draws: ``sum (yA - yC_i)^2 / (2 n var_samp(yA))``; NULL when yA is constant."""
    num = F.sum((ya - yc) * (ya - yc))
    return num / F.nullif(F.lit(2.0 * n) * F.var_samp(ya), F.lit(0.0))


def jansen_arrays(ya: np.ndarray, yc: np.ndarray) -> np.ndarray:
    """(samples, cells) total indices from (samples, draws) and (samples, cells, draws) scores; NaN when yA is constant."""
    n = ya.shape[1]
    spread = 2.0 * n * ya.var(1, ddof=1) if n > 1 else np.zeros(len(ya))
    num = ((ya[:, None, :] - yc) ** 2).sum(2)
    return np.divide(num, spread[:, None], out=np.full(num.shape, np.nan), where=spread[:, None] != 0)


# --- E12 HSIC ------------------------------------------------------------------------------

INPUT_RBF_WIDTH = 0.5  # fixed: width of the RBF input kernel


def input_kernel(kind: str):
    """Kernel on one mask coordinate, applied to (n,1) x (1,n) arrays."""
    if kind == "binary":
        return lambda a, b: (a == b).astype(float) - 0.5
    if kind == "rbf":
        return lambda a, b: np.exp(-((a - b) ** 2) / (2 * INPUT_RBF_WIDTH ** 2))
    if kind == "sobolev":
        return lambda a, b: (a - 0.5) * (b - 0.5) + 0.5 * ((a - b) ** 2 - np.abs(a - b) + 1.0 / 6.0)
    raise ValueError(f"unknown input kernel {kind!r}")


def output_rbf(y: np.ndarray) -> np.ndarray | None:
    """RBF kernel of one sample's outputs with width = median (linear interpolation); None if 0."""
    width = float(np.percentile(y, 50.0))
    if width == 0.0:
        return None
    d = y[:, None] - y[None, :]
    return np.exp(-(d * d) / (2.0 * width * width))


def centred(k: np.ndarray) -> np.ndarray:
    """``H K H`` with ``H = I - 1/n``."""
    return k - k.mean(0) - k.mean(1)[:, None] + k.mean()


#: Doubles of the pair tables worked on at once (8 MB), and of those kept for all samples of a task.
PAIR_VALUES, PAIRS_KEPT = 1 << 20, 1 << 23
#: Samples scored together against a table of pairs.
PAIR_SAMPLES = 64


class InputKernels:
    """E12c for a design: the centred kernels of all its coordinates, one row for each pair of draws, in tables of bounded size.

    A pair ``j < l`` stands for ``(l, j)`` too and counts twice.  The tables are
    made once where they are few, else again for each use.
    """

    def __init__(self, z: np.ndarray, kind: str):
        self.z, self.kernel = z, input_kernel(kind)
        n, d = z.shape
        self.means = np.zeros((n, d))  # of each row of 1 + k_in
        step = max(1, PAIR_VALUES // max(1, n * d))
        for a in range(0, n, step):
            self.means[a:a + step] = (1.0 + self.kernel(z[a:a + step, None, :], z[None, :, :])).mean(1)
        self._kept = [] if n * (n + 1) // 2 * d <= PAIRS_KEPT else None

    def tables(self):
        """(first draws, second draws, (pairs, coordinates) centred kernels times how often the pair counts)."""
        if self._kept:
            yield from self._kept
            return
        n, d = self.z.shape
        rows = max(1, PAIR_VALUES // max(1, n * max(d, PAIR_SAMPLES)))
        mean = self.means.mean(0)
        for a in range(0, n, rows):
            many = n - np.arange(a, min(a + rows, n))
            i = np.repeat(np.arange(a, a + len(many)), many)
            j = i + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            k = 1.0 + self.kernel(self.z[i], self.z[j]) - self.means[i] - self.means[j] + mean
            k[i != j] *= 2.0
            if self._kept is not None:
                self._kept.append((i, j, k))
            yield i, j, k


def hsic_scores(z: np.ndarray, y: np.ndarray, kind: str, kernels: InputKernels | None = None) -> np.ndarray:
    """``(1/n) sum (H K_i H) o L`` for every sample and mask coordinate i (K = 1 + k_in); NaN for a width of 0.

    On a binary mask any kernel is ``a + b (s + s') + g s s'`` with the signs
    ``s = 2 z - 1``; centring leaves ``g (Hs)(Hs)'``, so the score is the one
    quadratic form ``g (Hs)' L (Hs) / n``.  For real masks the output kernels of some samples, pair by
    pair, are multiplied by the tables of the centred input kernels (``kernels``, where the caller keeps them).
    """
    n, d = z.shape
    out = np.full((len(y), d), np.nan)
    if np.isin(z, (0.0, 1.0)).all():
        kernel = input_kernel(kind)
        at = lambda a, b: float(kernel(np.array([[a]]), np.array([[b]]))[0, 0])
        g = (at(1.0, 1.0) + at(0.0, 0.0) - at(0.0, 1.0) - at(1.0, 0.0)) / 4.0
        s = 2.0 * z - 1.0
        s = s - s.mean(0)
        for i, row in enumerate(y):
            k = output_rbf(row)
            if k is not None:
                out[i] = g * (s * (k @ s)).sum(0) / n
        return out
    width = np.percentile(y, 50.0, axis=1) if len(y) else np.zeros(0)
    some = np.flatnonzero(width != 0.0)
    if len(some):
        kernels = InputKernels(z, kind) if kernels is None else kernels
    for a in range(0, len(some), PAIR_SAMPLES):
        part = some[a:a + PAIR_SAMPLES]
        scores, total, spread = y[part], np.zeros((len(part), d)), (-2.0 * width[part] ** 2)[:, None]
        for i, j, k in kernels.tables():
            v = scores[:, i] - scores[:, j]
            v *= v
            v /= spread
            total += np.exp(v, out=v) @ k
        out[part] = total / n
    return out
