"""Scoring perturbed copies of samples without materialising the copies.

For the linear-softmax scorer the logit of a perturbed copy is the clean logit
plus the contribution of the changed positions.  Masks are constant inside a
cell, so contributions are summed per (sample, cell, class) once and designs
are joined to *cells* instead of positions (R2):

    r(sample, draw, c) = r0(sample, c) + sum_cell drop(draw, cell) * C(sample, cell, c)
    C(sample, cell, c) = sum_{pos in cell} (w[c, pos] - w[t, pos]) * (replacement[pos] - x[pos])

Logits are kept relative to the sample's target class ``t`` so the target
probability of every copy is ``1 / (1 + sum_{c != t} exp r_c)``, a plain hash
aggregate.  The clean logit enters as an always-on pseudo cell
(``BASE_CELL``) that every draw joins, so each (sample, draw) appears even when
a draw changes nothing, and every step stays inside the ``sample_id``
partitioning (the design is broadcast; its size is ``draws x cells``, fixed by
the parameters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salient.operators.scoring import LinearSoftmaxModel, prob_from_relative

BASE_CELL = -1


def relative_contributions(model: LinearSoftmaxModel, rows: DataFrame, replacement: Column,
                           base_rows: DataFrame | None = None) -> DataFrame:
    """``(sample_id, cell, cls, c)`` plus the clean relative logits as ``BASE_CELL``.

    ``rows`` has ``(sample_id, target, pos, cell, x)``; ``replacement`` is the
    value written over ``x`` when the cell is dropped (baseline, blur, ...).
    When a position belongs to several cells (sliding patches) or to none,
    ``base_rows(sample_id, target, pos, x)`` gives every position once.
    """
    rel = model.relative_rows(rows.select("sample_id", "target", "pos", "cell", "x",
                                          (replacement - F.col("x")).alias("d")))
    if base_rows is not None:
        contrib = (rel.groupBy("sample_id", "cell", "cls")
                   .agg(F.sum(F.col("w") * F.col("d")).alias("c")))
        src = model.relative_rows(base_rows.select("sample_id", "target", "pos", "x"))
        base = (src.groupBy("sample_id", "cls").agg(F.sum(F.col("w") * F.col("x")).alias("c"))
                .select("sample_id", F.lit(BASE_CELL).alias("cell"), "cls", "c"))
        return contrib.unionByName(base)
    # One aggregation per (sample, cell, class); the clean logit is the window sum of
    # the cells' x-terms, emitted once per (sample, class): a single pass over the
    # inputs and no extra shuffle (the window reuses the sample partitioning).
    per_cell = (rel.groupBy("sample_id", "cell", "cls")
                .agg(F.sum(F.col("w") * F.col("d")).alias("c"), F.sum(F.col("w") * F.col("x")).alias("s")))
    w = Window.partitionBy("sample_id", "cls")
    per_cell = (per_cell.withColumn("base", F.sum("s").over(w))
                .withColumn("first", F.col("cell") == F.min("cell").over(w)))
    one = F.struct(F.col("cell").alias("cell"), F.col("c").alias("c"))
    both = F.array(one, F.struct(F.lit(BASE_CELL).alias("cell"), F.col("base").alias("c")))
    items = F.when(F.col("first"), both).otherwise(F.array(one))
    return (per_cell.select("sample_id", "cls", F.explode(items).alias("t"))
            .select("sample_id", "t.cell", "cls", "t.c"))


def design_with_base(design: DataFrame, draws: int) -> DataFrame:
    """``(draw, cell, drop)`` plus the always-on pseudo cell for every draw; broadcast.

    Rows with ``drop == 0`` are removed first (they add nothing).
    """
    spark = design.sparkSession
    base = spark.range(draws).select(F.col("id").cast("int").alias("draw"),
                                     F.lit(BASE_CELL).alias("cell"), F.lit(1.0).alias("drop"))
    return F.broadcast(design.filter(F.col("drop") != 0).select("draw", "cell", "drop").unionByName(base))


def design_logits(contrib: DataFrame, design: DataFrame, draws: int) -> DataFrame:
    """``(sample_id, draw, cls, z)``: relative logits of every copy of a shared design."""
    return (contrib.join(design_with_base(design, draws), "cell")
            .groupBy("sample_id", "draw", "cls").agg(F.sum(F.col("drop") * F.col("c")).alias("z")))


def design_scores(contrib: DataFrame, design: DataFrame, draws: int) -> DataFrame:
    """``(sample_id, draw, score)``: target probability of every perturbed copy."""
    return (design_logits(contrib, design, draws)
            .groupBy("sample_id", "draw").agg(prob_from_relative("z").alias("score")))


def clean_scores(contrib: DataFrame) -> DataFrame:
    """``(sample_id, score)``: target probability of the unperturbed input."""
    base = contrib.filter(F.col("cell") == BASE_CELL).groupBy("sample_id", "cls").agg(F.sum("c").alias("c"))
    return base.groupBy("sample_id").agg(prob_from_relative("c").alias("score"))
