"""Seeded uniforms computed from keys.

A design value is a pure function of ``(seed, draw, cell, ...)``, so designs
never have to be generated on the driver, stored or shuffled: every task
recomputes the value it needs, the result does not depend on partitioning,
and DuckDB reproduces it with the same expression.

    u = (h + 0.5) / 2^32,  h = first 32 bits of md5('seed|k1|k2|...')

``u`` lies strictly inside (0, 1), so ``ln(u)`` is always finite.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(seed: int, *parts) -> Column:
    cols = [F.lit(str(seed))]
    for p in parts:
        cols.append((p if isinstance(p, Column) else F.lit(p)).cast("string"))
    return F.concat_ws("|", *cols)


def hash_uniform(seed: int, *parts) -> Column:
    """Uniform in (0, 1) from md5 of ``seed|part1|part2...`` (integer parts)."""
    h = F.conv(F.substring(F.md5(_key(seed, *parts)), 1, 8), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(TWO_32)


def hash_int(seed: int, k: int, *parts) -> Column:
    """Integer uniform in [0, k)."""
    return F.floor(hash_uniform(seed, *parts) * F.lit(k)).cast("int")


def hash_normal(seed: int, *parts) -> Column:
    """Standard normal by Box-Muller on two hash uniforms (streams 0 and 1)."""
    u1 = hash_uniform(seed, *parts, 0)
    u2 = hash_uniform(seed, *parts, 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# --- the same expressions as DuckDB SQL text (used by the oracle queries) ----

def sql_uniform(seed: int, *parts: str) -> str:
    key = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return (f"((('0x' || substr(md5(concat_ws('|', {key})), 1, 8))::BIGINT + 0.5) "
            f"/ {TWO_32})")


def sql_normal(seed: int, *parts: str) -> str:
    u1 = sql_uniform(seed, *parts, "0")
    u2 = sql_uniform(seed, *parts, "1")
    return f"(sqrt(-2.0 * ln({u1})) * cos(CAST({2.0 * math.pi!r} AS DOUBLE) * {u2}))"
