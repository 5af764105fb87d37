"""Perturbation designs (D6-D9, D15) as data-free DataFrames.

A design row is ``(draw, cell, m)`` with ``m`` the keep value of the cell
(1 keeps the input, 0 writes the replacement).  Designs depend only on the
parameters (draws x cells), never on the data, so they are generated with
``spark.range`` on the executors and broadcast to the joins that use them.

Random designs use the seeded key hash of :mod:`salient.functions.hashing`;
the low-discrepancy design builds Sobol points from primitive polynomials
over GF(2) found by search (initial direction numbers all 1, which is valid
for every polynomial; projections are weaker than tuned tables).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.functions.hashing import hash_int, hash_uniform

SOBOL_BITS = 30


def _grid(spark: SparkSession, draws: int, cells: int) -> DataFrame:
    return spark.range(draws * cells).select((F.col("id") / F.lit(cells)).cast("int").alias("draw"),
                                             (F.col("id") % F.lit(cells)).cast("int").alias("cell"))


def random_grid_mask(spark: SparkSession, grid: int, subset_percent: float, draws: int,
                     seed: int = 0) -> DataFrame:
    """G x g masks, a cell is kept when ``u > p`` (so a share p goes to the baseline)."""
    d = _grid(spark, draws, grid * grid)
    keep = hash_uniform(seed, F.col("draw"), F.col("cell")) > F.lit(float(subset_percent))
    return d.withColumn("m", F.when(keep, 1.0).otherwise(0.0))


def binary_design(spark: SparkSession, draws: int, dims: int, prob: float = 0.5, seed: int = 0) -> DataFrame:
    """Samples in {0,1}^d, 1 when ``prob > u``."""
    d = _grid(spark, draws, dims)
    one = F.lit(float(prob)) > hash_uniform(seed, F.col("draw"), F.col("cell"))
    return d.withColumn("m", F.when(one, 1.0).otherwise(0.0))


def uniform_design(spark: SparkSession, draws: int, dims: int, seed: int = 0) -> DataFrame:
    """Hash design in [0,1)^d (the random alternative to Sobol points)."""
    return _grid(spark, draws, dims).withColumn("m", hash_uniform(seed, F.col("draw"), F.col("cell")))


# --- D8 Sobol points ------------------------------------------------------------------

def _poly_mod_pow_x(exp: int, poly: int, deg: int) -> int:
    """x^exp mod poly over GF(2) (poly includes its leading bit)."""
    result, base = 1, 2  # polynomials as bit masks; base = x
    while exp:
        if exp & 1:
            result = _mulmod(result, base, poly, deg)
        base = _mulmod(base, base, poly, deg)
        exp >>= 1
    return result


def _mulmod(a: int, b: int, poly: int, deg: int) -> int:
    r = 0
    while b:
        if b & 1:
            r ^= a
        b >>= 1
        a <<= 1
        if a >> deg & 1:
            a ^= poly
    return r


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    if n > 1:
        out.append(n)
    return out


def _is_primitive(poly: int, deg: int) -> bool:
    order = (1 << deg) - 1
    if _poly_mod_pow_x(order, poly, deg) != 1:
        return False
    return all(_poly_mod_pow_x(order // q, poly, deg) != 1 for q in _prime_factors(order))


@lru_cache(maxsize=None)
def primitive_polynomials(count: int) -> tuple[tuple[int, int], ...]:
    """The first ``count`` primitive polynomials by (degree, value): ``(degree, bits)``."""
    out: list[tuple[int, int]] = []
    deg = 1
    while len(out) < count:
        for poly in range((1 << deg) | 1, 1 << (deg + 1), 2):
            if _is_primitive(poly, deg):
                out.append((deg, poly))
                if len(out) == count:
                    break
        deg += 1
    return tuple(out)


@lru_cache(maxsize=None)
def direction_numbers(dims: int, bits: int = SOBOL_BITS) -> tuple[tuple[int, ...], ...]:
    """Integer direction numbers ``V[i][b]`` (scaled by 2^bits) of the first ``dims`` dimensions."""
    table = [tuple(1 << (bits - 1 - b) for b in range(bits))]  # dimension 0: van der Corput
    for deg, poly in primitive_polynomials(max(dims - 1, 0)):
        m = [1] * deg  # odd initial values m_k < 2^k (k = 1..deg)
        for k in range(deg, bits):
            v = m[k - deg] ^ (m[k - deg] << deg)
            for j in range(1, deg):
                if poly >> (deg - j) & 1:
                    v ^= m[k - j] << j
            m.append(v)
        table.append(tuple(m[b] << (bits - 1 - b) for b in range(bits)))
    return tuple(table[:dims])


def sobol_design(spark: SparkSession, draws: int, dims: int, binary: bool = False, skip: int = 0) -> DataFrame:
    """Sobol points ``(draw, cell, m)`` in [0,1)^d; ``round`` when ``binary``.

    Point j is the XOR of the direction numbers of the set bits of j; the
    direction table (dims x 30 integers, from the parameters only) is
    broadcast and the bit work runs in SQL expressions.
    """
    table = direction_numbers(dims)
    dirs = F.broadcast(spark.createDataFrame([(i, list(v)) for i, v in enumerate(table)],
                                             "cell INT, v ARRAY<BIGINT>"))
    d = _grid(spark, draws, dims).join(dirs, "cell")
    j = F.col("draw").cast("bigint") + F.lit(skip)
    acc = F.aggregate(F.sequence(F.lit(0), F.lit(SOBOL_BITS - 1)), F.lit(0).cast("bigint"),
                      lambda a, b: F.when((j / F.pow(F.lit(2.0), b)).cast("bigint") % 2 == 1,
                                          a.bitwiseXOR(F.element_at(F.col("v"), b + 1))).otherwise(a))
    m = acc.cast("double") / F.lit(float(1 << SOBOL_BITS))
    if binary:
        m = F.round(m, 0)  # half-up; x = 0.5 exactly -> 1
    return d.select("draw", "cell", m.alias("m"))


# --- D9 replicated design --------------------------------------------------------------

def replicated_design(a: DataFrame, b: DataFrame, dims: int) -> DataFrame:
    """Blocks A, B and C_i = A with column i from B, as ``(block, rep, draw, cell, m)``.

    ``rep`` is the replaced column for block C (-1 for A and B).  Every C row
    is a lookup of the A and B values of the same (draw, cell): an equi-join
    on ``(draw, cell)`` of the two parameter-sized designs, exploded over ``rep``.
    """
    ab = (a.select("draw", "cell", F.col("m").alias("ma"))
          .join(b.select("draw", "cell", F.col("m").alias("mb")), ["draw", "cell"]))
    c = (ab.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))))
         .select(F.lit("C").alias("block"), "rep", "draw", "cell",
                 F.when(F.col("cell") == F.col("rep"), F.col("mb")).otherwise(F.col("ma")).alias("m")))
    return (a.select(F.lit("A").alias("block"), F.lit(-1).alias("rep"), "draw", "cell", "m")
            .unionByName(b.select(F.lit("B").alias("block"), F.lit(-1).alias("rep"), "draw", "cell", "m"))
            .unionByName(c))


def sobol_ab(spark: SparkSession, draws: int, dims: int) -> tuple[DataFrame, DataFrame]:
    """A and B from one 2d-dimensional Sobol sequence (first and second half of the dimensions)."""
    both = sobol_design(spark, draws, 2 * dims)
    a = both.filter(F.col("cell") < dims)
    b = both.filter(F.col("cell") >= dims).withColumn("cell", F.col("cell") - F.lit(dims))
    return a, b


# --- D15 off-class targets ------------------------------------------------------------

def off_class(true_class: Column, n_classes: int, seed: int, key: Column) -> Column:
    """Uniform class different from ``true_class`` by the shift trick."""
    rnd = hash_int(seed, n_classes - 1, key)
    return F.when(rnd >= true_class, rnd + 1).otherwise(rnd)
