"""Registered queries: one per operator, each with its DuckDB oracle.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and ``ORACLES[name] = sql``.
Columns are aliased identically on both sides; doubles are rounded to 6
decimals (sign of zero dropped) so value hashes compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.functions.arrays import rounded
from salient.operators import explainers as E
from salient.operators import metrics as M
from salient.plans import fixtures as fx
from salient.plans.oracle import base_ctes, causal_ctes, grad_coef_cte, project_cte, r6
from salient.sources.tables import summarize_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def per_sample(df: DataFrame) -> DataFrame:
    return df.select(F.col("sample_id").cast("bigint"), rounded("score").alias("score"))


def long_map(df: DataFrame) -> DataFrame:
    return df.select(F.col("sample_id").cast("bigint"), F.col("pos").cast("int"), rounded("e").alias("e"))


def emb_maps(spark, sf_dir):
    """The embedding itself viewed as an 8x8 attribution map."""
    return fx.samples(spark, sf_dir).select("sample_id", F.col("x").alias("e"), "label")


# ---------------------------------------------------------------- M1 / M2 / P8

EMB_MAP_SQL = "SELECT vec_id AS sample_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"


def _entropy_sql(arr: str) -> str:
    tot = f"list_sum(list_transform({arr}, lambda v: abs(v)))"
    return (f"-list_sum(list_transform({arr}, lambda v: (abs(v) / ({tot} + 1e-8)) "
            f"* ln(abs(v) / ({tot} + 1e-8) + 1e-8)))")


def _gini_sql(arr: str) -> str:
    tot = f"list_sum(list_transform({arr}, lambda v: abs(v)))"
    srt = f"list_transform(list_sort(list_transform({arr}, lambda v: abs(v) / ({tot} + 1e-8))), lambda v: v + 1e-7)"
    n = f"len({arr})"
    return (f"(list_sum(list_transform({srt}, lambda v, i: (2 * i - {n} - 1) * v)) "
            f"/ (list_sum({srt}) * {n}))")


@register("complexity", f"""
SELECT sample_id, {r6(_entropy_sql('e'))} AS score FROM ({EMB_MAP_SQL})""")
def q_complexity(spark, sf_dir):
    """M1 entropy of every map."""
    return per_sample(M.complexity(emb_maps(spark, sf_dir)))


@register("sparseness", f"""
SELECT sample_id, {r6(_gini_sql('e'))} AS score FROM ({EMB_MAP_SQL})""")
def q_sparseness(spark, sf_dir):
    """M2 Gini index of every map."""
    return per_sample(M.sparseness(emb_maps(spark, sf_dir)))


@register("sparseness_by_label", f"""
SELECT label, {r6('avg(score)')} AS mean_score, count(*) AS n, CAST(0 AS BIGINT) AS n_undefined
FROM (SELECT label, {_gini_sql('e')} AS score FROM ({EMB_MAP_SQL})) GROUP BY label""")
def q_sparseness_by_label(spark, sf_dir):
    """P1 -> M2 -> P8 summary per label (the minimum end-to-end slice)."""
    maps = emb_maps(spark, sf_dir)
    scores = M.sparseness(maps).join(maps.select("sample_id", "label"), "sample_id")
    s = summarize_scores(scores, keys=("label",))
    return s.select("label", rounded("mean_score").alias("mean_score"), "n", "n_undefined")


# ------------------------------------------------------------------ E2 -> M5 flagship

def _flagship(spark, sf_dir, steps=200):
    smp, mdl, tgt = fx.setup(spark, sf_dir)
    maps = E.gradient_input(mdl, smp, tgt)
    from salient.functions.arrays import to_array
    emaps = to_array(maps, "e", "e")
    trip = M.metric_triplets(smp, tgt.withColumnRenamed("target", "pred"), emaps)
    return smp, M.deletion(mdl, trip, steps=steps)


FLAGSHIP_SQL = f"""
WITH {base_ctes()},
{grad_coef_cte()},
{project_cte('gi', 'co', 'x * g')},
{causal_ctes('gi', 'deletion', 200)}
"""


@register("deletion_gradient_input", FLAGSHIP_SQL + f"SELECT sample_id, {r6('score')} AS score FROM auc")
def q_deletion_gradient_input(spark, sf_dir):
    """E2 gradient x input maps -> M5 deletion AUC (200 steps) per sample."""
    return per_sample(_flagship(spark, sf_dir)[1])


@register("deletion_by_label", FLAGSHIP_SQL + f"""
SELECT e.label, {r6('avg(a.score)')} AS mean_score, count(*) AS n
FROM auc a JOIN ex e USING (sample_id) GROUP BY e.label""")
def q_deletion_by_label(spark, sf_dir):
    """Flagship: mean deletion AUC of gradient x input maps per label."""
    smp, scores = _flagship(spark, sf_dir)
    return (scores.join(smp.select("sample_id", "label"), "sample_id")
            .groupBy("label").agg(rounded(F.avg("score")).alias("mean_score"), F.count(F.lit(1)).alias("n")))


# The remaining operators register themselves from these modules.
from salient.plans import core_queries  # noqa: E402,F401
from salient.plans import explainer_queries  # noqa: E402,F401
from salient.plans import metric_queries  # noqa: E402,F401
from salient.plans import manifest_queries  # noqa: E402,F401
