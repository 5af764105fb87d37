"""Column expressions over one sample's array (no shuffle, stays in the JVM).

Maps are flattened row-major ``(r, c, ch)`` -> ``(r*W + c)*C + ch``; every
function here works on one row, so it runs inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the complexity metrics (stabilisers of the published formulas).
ENTROPY_EPS = 1e-8
GINI_SHIFT = 1e-7


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value, fn) -> Column:
    """Bind ``value`` once and use it in ``fn(v)``.

    Inside higher-order functions Spark re-evaluates captured outer expressions
    for every element; binding through a one-element ``transform`` evaluates
    the value once per row and keeps array metrics linear in the map size.
    """
    return F.element_at(F.transform(F.array(_c(value)), fn), 1)


def array_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, v: acc + v)


def channel_reduce(arr, channels: int) -> Column:
    """Mean over the last axis of an ``(H, W, C)`` map -> ``(H, W)``; identity for C == 1."""
    a = _c(arr)
    if channels == 1:
        return a

    def reduce(m):
        n = (F.size(m) / F.lit(channels)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.aggregate(F.slice(m, i * channels + 1, F.lit(channels)), F.lit(0.0),
                                  lambda acc, v: acc + v) / F.lit(float(channels)))
    return let(a, reduce)


def normalized_abs(arr) -> Column:
    """p = |e| / (sum |e| + 1e-8)."""
    def norm(a):
        return let(array_sum(a), lambda total: F.transform(a, lambda v: v / (total + F.lit(ENTROPY_EPS))))
    return let(F.transform(_c(arr), lambda v: F.abs(v)), norm)


def entropy(arr) -> Column:
    """Complexity: -sum p ln(p + 1e-8) with p the normalized absolute map."""
    return let(normalized_abs(arr), lambda p: -F.aggregate(
        p, F.lit(0.0), lambda acc, v: acc + v * F.log(v + F.lit(ENTROPY_EPS))))


def gini(arr) -> Column:
    """Sparseness: Gini index of the normalized absolute map, sorted ascending + 1e-7."""
    def g(s):
        n = F.size(s)
        weighted = F.aggregate(
            F.zip_with(s, F.sequence(F.lit(1), n), lambda v, i: (F.lit(2) * i - n - F.lit(1)) * v),
            F.lit(0.0), lambda acc, v: acc + v)
        return weighted / (array_sum(s) * n)
    return let(F.transform(F.array_sort(normalized_abs(arr)), lambda v: v + F.lit(GINI_SHIFT)), g)


def to_long(df: DataFrame, array_col: str, value_name: str, keys=("sample_id",)) -> DataFrame:
    """``(keys, arr)`` -> ``(keys, pos, value)`` with 0-based positions."""
    return df.select(*keys, F.posexplode(array_col).alias("pos", value_name))


def to_array(long_df: DataFrame, value_col: str, out_name: str, keys=("sample_id",),
             pos_col: str = "pos") -> DataFrame:
    """``(keys, pos, value)`` -> ``(keys, arr)`` ordered by position.

    The collected group is one sample's own map, bounded by the map size.
    """
    return (long_df.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"),
                                                      F.col(value_col).alias("v")))).alias("_s"))
            .select(*keys, F.transform("_s", lambda s: s["v"]).alias(out_name)))


def rounded(col, digits: int = 6) -> Column:
    """Round for comparison and drop the sign of zero."""
    return F.round(_c(col), digits) + F.lit(0.0)
