"""Queries for the metrics (M3-M12) over explanation maps computed by the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from salient.functions.arrays import rounded, to_array
from salient.functions.hashing import sql_uniform
from salient.operators import explainers as E
from salient.operators import metrics as M
from salient.plans import fixtures as fx
from salient.plans.catalog import per_sample, register
from salient.session import materialize
from salient.plans.core_queries import GI_MAP_SQL, SAL_MAP_SQL
from salient.plans.explainer_queries import _design_sql, _masked_scores_sql
from salient.plans.oracle import (base_ctes, causal_ctes, cell_sql, grad_coef_cte, project_cte, r6,
                                  softmax_target_cte)


def _triplets(spark, sf_dir, explainer):
    smp, mdl, tgt = fx.setup(spark, sf_dir)
    maps = explainer(mdl, smp, tgt)
    trip = materialize(M.metric_triplets(smp, tgt.withColumnRenamed("target", "pred"), to_array(maps, "e", "e")),
                       key="sample_id")
    return smp, mdl, tgt, maps, trip


def _score_sql(body: str, table: str = "auc") -> str:
    return body + f"SELECT sample_id, {r6('score')} AS score FROM {table}"


# ------------------------------------------------------------------------ M3 / M4 / M6

@register("causal_curve", SAL_MAP_SQL + "," + causal_ctes("sm", "insertion", 10) + f"""
SELECT sample_id, CAST(k AS INTEGER) AS k, {r6('score')} AS score FROM cv""")
def q_causal_curve(spark, sf_dir):
    """M3: insertion curve (10 steps) of saliency maps: target probability per step."""
    _, mdl, _, _, trip = _triplets(spark, sf_dir, E.saliency)
    c = M.causal_curve(mdl, trip, "insertion", 0.0, 10)
    return c.select(F.col("sample_id").cast("bigint"), F.col("k").cast("int"), rounded("score").alias("score"))


@register("insertion_saliency", _score_sql(SAL_MAP_SQL + "," + causal_ctes("sm", "insertion", M.FIDELITY_STEPS)))
def q_insertion_saliency(spark, sf_dir):
    """M6 + M4: insertion AUC (200 steps) of saliency maps."""
    _, mdl, _, _, trip = _triplets(spark, sf_dir, E.saliency)
    return per_sample(M.insertion(mdl, trip, steps=M.FIDELITY_STEPS))


@register("deletion_half_baseline", _score_sql(GI_MAP_SQL + "," + causal_ctes("gi", "deletion", 20, 0.5, 0.5)))
def q_deletion_half_baseline(spark, sf_dir):
    """M5 + D1 + D4: deletion AUC (20 steps) with baseline 0.5 over the top half of the pixels only."""
    _, mdl, _, _, trip = _triplets(spark, sf_dir, E.gradient_input)
    return per_sample(M.deletion(mdl, trip, baseline=0.5, steps=20, max_pct=0.5))


# ------------------------------------------------------------------------------- M7

MU_DRAWS, MU_GRID = M.MUFIDELITY["nb_samples"], M.MUFIDELITY["grid_size"]
MU_DESIGN = _design_sql(MU_DRAWS, MU_GRID ** 2, f"CASE WHEN {sql_uniform(0, 'd', 'c')} > 0.2 THEN 1.0 ELSE 0.0 END")


def _spearman_sql(src: str, a: str, b: str, key: str, idx: str) -> str:
    return f"""sr AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY {a}, {idx}) AS ra,
                      row_number() OVER (PARTITION BY {key} ORDER BY {b}, {idx}) AS rb FROM {src}),
sp AS (SELECT {key} AS sample_id, CASE WHEN count(*) > 1 THEN 1.0 - 6.0 * sum((ra - rb) * (ra - rb))
              / (count(*) * (CAST(count(*) AS DOUBLE) * count(*) - 1)) END AS score FROM sr GROUP BY {key})"""


MU_SQL = GI_MAP_SQL + f""",
{_masked_scores_sql('ms', MU_DESIGN, MU_DRAWS, '0.0', MU_GRID)},
{softmax_target_cte('m0', "(SELECT sample_id, 0 AS draw, cls, z FROM zz)", ['draw'])},
ma AS (SELECT g.sample_id, d.draw, sum(g.e * (1.0 - d.m)) AS attr
       FROM gi g JOIN ms_d d ON d.cell = {cell_sql(MU_GRID, pix='g.pos')} GROUP BY g.sample_id, d.draw),
mp AS (SELECT s.sample_id, s.draw, coalesce(a.attr, 0.0) AS attr, b.score - s.score AS delta
       FROM ms s JOIN (SELECT sample_id, score FROM m0) b USING (sample_id)
       LEFT JOIN ma a ON a.sample_id = s.sample_id AND a.draw = s.draw),
{_spearman_sql('mp', 'attr', 'delta', 'sample_id', 'draw')}
"""


@register("mu_fidelity", _score_sql(MU_SQL, "sp"))
def q_mu_fidelity(spark, sf_dir):
    """M7 + D6 + M8: MuFidelity of gradient x input maps (8x8 grid, p 0.2, 200 draws)."""
    _, mdl, _, _, trip = _triplets(spark, sf_dir, E.gradient_input)
    return per_sample(M.mu_fidelity(mdl, trip, fx.MAP, MU_GRID, 0.2, 0.0, MU_DRAWS, seed=0))


@register("mu_fidelity_udf_scorer", _score_sql(MU_SQL, "sp"))
def q_mu_fidelity_udf_scorer(spark, sf_dir):
    """M7 + S3: the same scores with the copies made and scored by a NumPy model."""
    _, mdl, _, _, trip = _triplets(spark, sf_dir, E.gradient_input)
    return per_sample(M.mu_fidelity(numpy_scorer(mdl), trip, fx.MAP, MU_GRID, 0.2, 0.0, MU_DRAWS, seed=0))


# ------------------------------------------------------------------------------- M8

@register("spearman_maps", _score_sql(GI_MAP_SQL + f""",
pr AS (SELECT g.sample_id, g.pos, l.x AS a, g.e AS b FROM gi g JOIN lx l USING (sample_id, pos)),
{_spearman_sql('pr', 'a', 'b', 'sample_id', 'pos')}
""", "sp"))
def q_spearman_maps(spark, sf_dir):
    """M8: ordinal Spearman between each input and its gradient x input map."""
    smp, _, _, maps, _ = _triplets(spark, sf_dir, E.gradient_input)
    pairs = (smp.select("sample_id", F.posexplode("x").alias("pos", "a"))
             .join(maps.withColumnRenamed("e", "b"), ["sample_id", "pos"]))
    return per_sample(M.spearman_maps(pairs))


# ------------------------------------------------------------------------------- M9

#: The benchmark's window of 11 does not fit an 8x8 map.
SSIM_WINDOW = 7


def _ssim_sql(a_map: str, b_map: str, win: int = SSIM_WINDOW, sigma: float = 1.5) -> str:
    nr = 8 - win + 1
    c = (win - 1) / 2.0
    return f"""gw1 AS (SELECT d, exp(-0.5 * (d - {c!r}) * (d - {c!r}) / {sigma * sigma!r}) AS g FROM range({win}) t(d)),
gw AS (SELECT d, g / (SELECT sum(g) FROM gw1) AS g FROM gw1),
wn AS (SELECT CAST(i * {nr} + j AS INTEGER) AS win_id, CAST((i + a.d) * 8 + j + b.d AS BIGINT) AS pos, a.g * b.g AS weight
       FROM range({nr}) r(i), range({nr}) s(j), gw a, gw b),
pq AS (SELECT a.sample_id, a.pos, a.e AS a, b.e AS b FROM {a_map} a JOIN {b_map} b USING (sample_id, pos)),
rg AS (SELECT sample_id, greatest(max(a), max(b)) - least(min(a), min(b)) AS L FROM pq GROUP BY sample_id),
mo AS (SELECT sample_id, win_id, sum(weight * a) AS ma, sum(weight * b) AS mb,
              sum(weight * (a * a + b * b)) AS m2, sum(weight * a * b) AS mab
       FROM pq JOIN wn USING (pos) GROUP BY sample_id, win_id),
sw AS (SELECT m.sample_id, ((2 * ma * mb + (0.01 * L) * (0.01 * L)) / (ma * ma + mb * mb + (0.01 * L) * (0.01 * L)))
              * ((2 * mab - 2 * ma * mb + (0.03 * L) * (0.03 * L)) / (m2 - ma * ma - mb * mb + (0.03 * L) * (0.03 * L))) AS s, L
       FROM mo m JOIN rg USING (sample_id)),
ss AS (SELECT sample_id, CASE WHEN max(L) > 0 THEN avg(s) ELSE 1.0 END AS score FROM sw GROUP BY sample_id)"""


SSIM_SQL = f"""WITH {base_ctes()},
{grad_coef_cte()},
{project_cte('gi', 'co', 'x * g')},
{project_cte('sm', 'co', 'abs(g)')},
{_ssim_sql('gi', 'sm')}
"""


@register("ssim", _score_sql(SSIM_SQL, "ss"))
def q_ssim(spark, sf_dir):
    """M9: SSIM (window 7, sigma 1.5) between gradient x input and saliency maps."""
    smp, mdl, tgt = fx.setup(spark, sf_dir)
    a = E.gradient_input(mdl, smp, tgt).withColumnRenamed("e", "a")
    b = E.saliency(mdl, smp, tgt).withColumnRenamed("e", "b")
    return per_sample(M.ssim(a.join(b, ["sample_id", "pos"]), fx.MAP, win=SSIM_WINDOW))


# ------------------------------------------------------------------------------ M10

RANDOM_LOGIT_SQL = f"""WITH {base_ctes()},
ot AS (SELECT sample_id, CAST(CASE WHEN r >= target THEN r + 1 ELSE r END AS INTEGER) AS target
       FROM (SELECT sample_id, target, CAST(floor({sql_uniform(42, 'sample_id')} * ((SELECT count(DISTINCT cls) FROM wt) - 1)) AS INTEGER) AS r FROM tg)),
{grad_coef_cte()},
{grad_coef_cte('co2', 'pp', 'ot')},
{project_cte('gi', 'co', 'x * g')},
{project_cte('go', 'co2', 'x * g')},
{_ssim_sql('gi', 'go')}
"""


@register("random_logit", _score_sql(RANDOM_LOGIT_SQL, "ss"))
def q_random_logit(spark, sf_dir):
    """M10 + D15: SSIM (window 7) between gradient x input maps of the predicted and a random other class."""
    smp, mdl, tgt = fx.setup(spark, sf_dir)
    maps = E.gradient_input(mdl, smp, tgt)
    return per_sample(M.random_logit(E.gradient_input, mdl, smp, tgt, maps, fx.MAP, seed=42, win=SSIM_WINDOW))


# ------------------------------------------------------------------------ M11 / M12

RAND_W_SQL = f"""
ex AS (SELECT vec_id AS sample_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
lx AS (SELECT sample_id, label, unnest(generate_series(0, len(x) - 1)) AS pos, unnest(x) AS x FROM ex),
ce AS (SELECT label AS cls, pos, avg(x) AS w FROM lx GROUP BY label, pos),
sc AS (SELECT DISTINCT pos, {sql_uniform(42, "'0'", "'-1'", 'pos')} AS u FROM ce)"""


@register("randomize_layers", f"""WITH {RAND_W_SQL}
SELECT 0 AS layer_idx, 'scale' AS layer_name, -1 AS cls, CAST(pos AS INTEGER) AS pos, {r6('u')} AS w FROM sc
UNION ALL
SELECT 1, 'centroids', CAST(cls AS INTEGER), CAST(pos AS INTEGER), {r6('w')} FROM ce""")
def q_randomize_layers(spark, sf_dir):
    """Progressive layer randomization of the scorer's weight table (stop at layer index 1)."""
    w = M.randomize_layers(fx.weights_from_samples(fx.samples(spark, sf_dir)), 1, seed=42)
    return w.select(F.col("layer_idx").cast("int"), "layer_name", F.col("cls").cast("int"),
                    F.col("pos").cast("int"), rounded("w").alias("w"))


MODEL_RAND_SQL = f"""WITH {base_ctes()},
sc AS (SELECT DISTINCT pos, {sql_uniform(42, "'0'", "'-1'", 'pos')} AS u FROM wt),
w2 AS (SELECT c.cls, c.pos, ({fx.TAU!r} * s.u) * c.w0 AS w
       FROM (SELECT label AS cls, pos, avg(x) AS w0 FROM lx GROUP BY label, pos) c JOIN sc s USING (pos)),
z2 AS (SELECT sample_id, cls, sum(x * w) AS z FROM lx JOIN w2 USING (pos) GROUP BY sample_id, cls),
m2 AS (SELECT sample_id, max(z) AS m FROM z2 GROUP BY sample_id),
p2 AS (SELECT sample_id, cls, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY sample_id) AS p
       FROM z2 JOIN m2 USING (sample_id)),
{grad_coef_cte()},
{grad_coef_cte('co2', 'p2', 'tg')},
{project_cte('gi', 'co', 'x * g')},
{project_cte('g2', 'co2', 'x * g', weights='w2')},
pr AS (SELECT a.sample_id, a.pos, a.e AS a, b.e AS b FROM gi a JOIN g2 b USING (sample_id, pos)),
{_spearman_sql('pr', 'a', 'b', 'sample_id', 'pos')}
"""


@register("model_randomization", _score_sql(MODEL_RAND_SQL, "sp"))
def q_model_randomization(spark, sf_dir):
    """M12 + M11: Spearman between gradient x input maps before and after randomizing layer 0."""
    smp, mdl, tgt = fx.setup(spark, sf_dir)
    maps = E.gradient_input(mdl, smp, tgt)
    return per_sample(M.model_randomization(E.gradient_input, mdl, smp, tgt, maps, stop=1, seed=42))



def numpy_scorer(mdl):
    """The scorer as a NumPy batch function (a user model for S3); tasks read its weights from the shared folder."""
    from salient.operators.scoring import SharedLinearSoftmax
    return SharedLinearSoftmax(mdl)


@register("deletion_udf_scorer", _score_sql(GI_MAP_SQL + "," + causal_ctes("gi", "deletion", M.FIDELITY_STEPS)))
def q_deletion_udf_scorer(spark, sf_dir):
    """M3 + M5 + D4 + S3: deletion AUC (200 steps) of gradient x input maps with the path materialized
    and scored by a NumPy model in mapInPandas (the general-scorer path)."""
    _, mdl, _, _, trip = _triplets(spark, sf_dir, E.gradient_input)
    curve = M.causal_curve_scored(numpy_scorer(mdl), trip, "deletion", 0.0, M.FIDELITY_STEPS)
    return per_sample(M.curve_auc(curve, M.FIDELITY_STEPS))


@register("scores_json_roundtrip", f"""WITH {base_ctes()},
{grad_coef_cte()},
{project_cte('gi', 'co', 'x * g')},
ga AS (SELECT sample_id, list(abs(e) ORDER BY pos) AS a FROM gi GROUP BY sample_id),
gs AS (SELECT sample_id, list_transform(a, lambda v: v / (list_sum(a) + 1e-8)) AS p FROM ga),
sc AS (SELECT -list_sum(list_transform(p, lambda v: v * ln(v + 1e-8))) AS score FROM gs)
SELECT 'centroid' AS model, 'gradient_input' AS explainer, 'complexity' AS metric,
       {r6('avg(score)')} AS mean_score, count(*) AS n, CAST(0 AS BIGINT) AS n_undefined FROM sc""")
def q_scores_json_roundtrip(spark, sf_dir):
    """Per-sample complexity scores of gradient x input maps written as JSON (partitioned by
    model / explainer / metric), read back and summarized."""
    from salient.functions.arrays import rounded as rnd
    from salient.session import scratch_path
    from salient.sources import tables as T
    _, _, _, maps, _ = _triplets(spark, sf_dir, E.gradient_input)
    scores = (M.complexity(to_array(maps, "e", "e"))
              .select("sample_id", "score", F.lit("centroid").alias("model"),
                      F.lit("gradient_input").alias("explainer"), F.lit("complexity").alias("metric")))
    path = scratch_path(spark, "scores")
    T.write_scores(scores, path)
    back = spark.read.schema("sample_id BIGINT, score DOUBLE, model STRING, explainer STRING, metric STRING").json(path)
    s = T.summarize_scores(back)
    return s.select("model", "explainer", "metric", rnd("mean_score").alias("mean_score"), "n", "n_undefined")


@register("deletion_channels", _score_sql(f"""WITH {base_ctes()},
em AS (SELECT sample_id, pos // 4 AS pos, avg(x) AS e FROM lx GROUP BY sample_id, pos // 4),
""" + causal_ctes("em", "deletion", 10, channels=4).lstrip("\n") + "\n"))
def q_deletion_channels(spark, sf_dir):
    """M5 + P11 with channels: inputs and maps viewed as 4x4x4; the map is channel-averaged, ranked per
    pixel, and all channels of a pixel go to the baseline together (10 steps)."""
    smp, mdl, tgt = fx.setup(spark, sf_dir)
    trip = M.metric_triplets(smp, tgt.withColumnRenamed("target", "pred"), smp.select("sample_id", F.col("x").alias("e")))
    return per_sample(M.deletion(mdl, trip, steps=10, channels=fx.MAP_CH.c))
