"""Queries for sources, scoring, designs and masking (P, S, D rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from salient.functions.arrays import channel_reduce, rounded, to_array
from salient.functions.hashing import sql_uniform
from salient.operators import designs as D
from salient.operators import explainers as E
from salient.operators import masking as K
from salient.operators import metrics as M
from salient.operators import scoring as S
from salient.plans import fixtures as fx
from salient.plans.catalog import long_map, per_sample, register
from salient.plans.oracle import base_ctes, grad_coef_cte, project_cte, r6
from salient.session import scratch_path
from salient.sources import tables as T

LONG_X_SQL = ("SELECT vec_id AS sample_id, unnest(generate_series(0, len(embedding) - 1)) AS pos, "
              "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")


# ----------------------------------------------------------------------------- P1-P11

@register("read_samples", f"SELECT sample_id, CAST(pos AS INTEGER) AS pos, {r6('x')} AS x FROM ({LONG_X_SQL})")
def q_read_samples(spark, sf_dir):
    """Samples as (sample_id, pos, x)."""
    smp = fx.samples(spark, sf_dir)
    return smp.select("sample_id", F.posexplode("x").alias("pos", "x")).select(
        "sample_id", F.col("pos").cast("int"), rounded("x").alias("x"))


GI_MAP_SQL = f"""WITH {base_ctes()},
{grad_coef_cte()},
{project_cte('gi', 'co', 'x * g')}
"""
SAL_MAP_SQL = f"""WITH {base_ctes()},
{grad_coef_cte()},
{project_cte('sm', 'co', 'abs(g)')}
"""


def _written_maps(spark, sf_dir):
    """Gradient maps of two explainers and two model temperatures, written partitioned."""
    smp, mdl, tgt = fx.setup(spark, sf_dir)
    hot = fx.model(smp, tau=5.0)
    parts = []
    for model_name, m, explainer, fn in (("centroid", mdl, "saliency", E.saliency),
                                         ("centroid", mdl, "gradient_input", E.gradient_input),
                                         ("centroid_tau5", hot, "saliency", E.saliency)):
        maps = to_array(fn(m, smp, tgt), "e", "e")
        parts.append(maps.select("sample_id", "e", F.lit(model_name).alias("model"),
                                 F.lit(explainer).alias("explainer")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    path = scratch_path(spark, "explanations")
    T.write_explanations(out, path)
    return path


@register("explanations_roundtrip", GI_MAP_SQL + f"SELECT sample_id, CAST(pos AS INTEGER) AS pos, {r6('e')} AS e FROM gi")
def q_explanations_roundtrip(spark, sf_dir):
    """P3 write (partitioned by model, explainer) -> P2 read of one pair by partition pruning."""
    path = _written_maps(spark, sf_dir)
    maps = T.read_explanations(spark, path, "centroid", "gradient_input")
    return long_map(maps.select("sample_id", F.posexplode("e").alias("pos", "e")))


@register("coverage_matrix", """
SELECT m.model, e.explainer, CAST(CASE WHEN m.model = 'centroid_tau5' AND e.explainer = 'gradient_input'
       THEN 0 ELSE (SELECT count(*) FROM embeddings) END AS BIGINT) AS n_maps
FROM (VALUES ('centroid'), ('centroid_tau5')) m(model), (VALUES ('saliency'), ('gradient_input')) e(explainer)""")
def q_coverage_matrix(spark, sf_dir):
    """Model x explainer map counts; missing pairs come out as 0."""
    return T.coverage_matrix(T.read_explanations(spark, _written_maps(spark, sf_dir)))


@register("predictions", f"""WITH {base_ctes()}
SELECT t.sample_id, CAST(t.target AS INTEGER) AS pred, {r6('p.p')} AS p_pred
FROM tg t JOIN pp p ON p.sample_id = t.sample_id AND p.cls = t.target""")
def q_predictions(spark, sf_dir):
    """Argmax class (lowest on ties) and its probability."""
    smp, mdl, _ = fx.setup(spark, sf_dir)
    pr = S.predictions(mdl, smp)
    return pr.select("sample_id", F.col("pred").cast("int"), rounded("p_pred").alias("p_pred"))


@register("materialize_or_load", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def q_materialize_or_load(spark, sf_dir):
    """P5: build the prepared table once (errorifexists), then always read it back."""
    path = scratch_path(spark, "prepared")
    T.materialize_or_load(spark, path, lambda: fx.samples(spark, sf_dir))
    again = T.materialize_or_load(spark, path, None)
    return again.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("metric_triplets", f"""WITH {base_ctes()}
SELECT e.sample_id, CAST(t.target AS INTEGER) AS target, CAST(len(e.x) AS INTEGER) AS n_x
FROM ex e JOIN tg t USING (sample_id)""")
def q_metric_triplets(spark, sf_dir):
    """Keyed join of inputs, predictions and maps (with the missing-map check)."""
    smp, mdl, tgt = fx.setup(spark, sf_dir)
    maps = smp.select("sample_id", F.col("x").alias("e"))
    trip = M.metric_triplets(smp, tgt.withColumnRenamed("target", "pred"), maps, check=True)
    return trip.select("sample_id", F.col("target").cast("int"), F.size("x").cast("int").alias("n_x"))


@register("subsample_first", "SELECT vec_id AS sample_id, label FROM embeddings ORDER BY vec_id LIMIT 100")
def q_subsample_first(spark, sf_dir):
    """The first 100 samples by key (a top-n, as the randomization metrics use)."""
    return M.subsample_first(fx.samples(spark, sf_dir), 100).select("sample_id", "label")


@register("score_summary", """
SELECT metric, round(avg(score), 6) + 0.0 AS mean_score, count(*) AS n, CAST(0 AS BIGINT) AS n_undefined
FROM (SELECT 'complexity' AS metric, -list_sum(list_transform(p, lambda v: v * ln(v + 1e-8))) AS score
      FROM (SELECT list_transform(e, lambda v: abs(v) / (list_sum(list_transform(e, lambda u: abs(u))) + 1e-8)) AS p
            FROM (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings))
      UNION ALL
      SELECT 'max_abs' AS metric, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda v: abs(v))) FROM embeddings)
GROUP BY metric""")
def q_score_summary(spark, sf_dir):
    """Scores of several metrics in one table -> mean / count / undefined per metric."""
    maps = fx.samples(spark, sf_dir).select("sample_id", F.col("x").alias("e"))
    a = M.complexity(maps).withColumn("metric", F.lit("complexity"))
    b = maps.select("sample_id", F.array_max(F.transform("e", lambda v: F.abs(v))).alias("score"),
                    F.lit("max_abs").alias("metric"))
    s = T.summarize_scores(a.unionByName(b), keys=("metric",))
    return s.select("metric", rounded("mean_score").alias("mean_score"), "n", "n_undefined")


@register("channel_mean", f"""
SELECT CAST(pos % 4 AS INTEGER) AS channel, {r6('avg(x)')} AS mean FROM ({LONG_X_SQL}) GROUP BY pos % 4""")
def q_channel_mean(spark, sf_dir):
    """P10: per-channel mean pixel of the dataset (inputs viewed as 4x4x4)."""
    return T.channel_mean(fx.samples(spark, sf_dir), fx.MAP_CH.c).select("channel", rounded("mean").alias("mean"))


@register("channel_reduce", f"""
SELECT sample_id, CAST(pos // 4 AS INTEGER) AS pix, {r6('avg(x)')} AS v FROM ({LONG_X_SQL}) GROUP BY sample_id, pos // 4""")
def q_channel_reduce(spark, sf_dir):
    """Mean over the channel axis of 4x4x4 maps -> 4x4."""
    smp = fx.samples(spark, sf_dir)
    r = smp.select("sample_id", channel_reduce("x", fx.MAP_CH.c).alias("v"))
    return r.select("sample_id", F.posexplode("v").alias("pix", "v")).select(
        "sample_id", F.col("pix").cast("int"), rounded("v").alias("v"))


# ----------------------------------------------------------------------------- S1-S3

@register("target_score", f"""WITH {base_ctes()}
SELECT e.sample_id, {r6('p.p')} AS score FROM ex e JOIN pp p ON p.sample_id = e.sample_id AND p.cls = e.label""")
def q_target_score(spark, sf_dir):
    """f(x)[y] for the true label y (one-hot target)."""
    smp = fx.samples(spark, sf_dir)
    mdl = fx.model(smp)
    return per_sample(S.target_scores(mdl, smp, smp.select("sample_id", F.col("label").alias("target"))))


@register("class_probabilities", f"""WITH {base_ctes()}
SELECT sample_id, CAST(cls AS INTEGER) AS cls, {r6('p')} AS p FROM pp""")
def q_class_probabilities(spark, sf_dir):
    """Linear-softmax scorer over the centroid weight table."""
    smp = fx.samples(spark, sf_dir)
    mdl = fx.model(smp)
    p = S.class_probabilities(mdl.logits(smp))
    return p.select("sample_id", F.col("cls").cast("int"), rounded("p").alias("p"))


@register("model_weights", f"""WITH {base_ctes()}
SELECT CAST(cls AS INTEGER) AS cls, CAST(pos AS INTEGER) AS pos, {r6('w')} AS w FROM wt""")
def q_model_weights(spark, sf_dir):
    """S2 parameters: effective weights tau * scale * centroid, one row per (class, position)."""
    mdl = fx.model(fx.samples(spark, sf_dir))
    return mdl._W.select(F.col("cls").cast("int"), F.col("pos").cast("int"), rounded("w").alias("w"))


@register("udf_scorer", f"""WITH {base_ctes()}
SELECT t.sample_id, {r6('p.p')} AS score FROM tg t JOIN pp p ON p.sample_id = t.sample_id AND p.cls = t.target""")
def q_udf_scorer(spark, sf_dir):
    """S3: a NumPy batch scorer run with mapInPandas (Arrow batches) on the predicted class."""
    smp, mdl, tgt = fx.setup(spark, sf_dir)
    scored = S.udf_scorer(smp.join(tgt, "sample_id"), S.SharedLinearSoftmax(mdl))
    return per_sample(scored)


# ----------------------------------------------------------------------------- D1-D15

@register("rank_positions", f"""
SELECT sample_id, CAST(pos AS INTEGER) AS pos,
       CAST(row_number() OVER (PARTITION BY sample_id ORDER BY x DESC, pos) - 1 AS INTEGER) AS rank
FROM ({LONG_X_SQL})""")
def q_rank_positions(spark, sf_dir):
    """D3: ordinal rank of every position of the map, high to low."""
    smp = fx.samples(spark, sf_dir)
    long = smp.select("sample_id", F.posexplode("x").alias("pix", "e"))
    r = K.rank_positions(long)
    return r.select("sample_id", F.col("pix").cast("int").alias("pos"), F.col("rank").cast("int"))


@register("prefix_masks", f"""
WITH r AS (SELECT sample_id, pos, x, row_number() OVER (PARTITION BY sample_id ORDER BY x DESC, pos) - 1 AS rank
           FROM ({LONG_X_SQL})),
st AS (SELECT range AS k, (range * 63) // 4 AS t FROM range(5))
SELECT r.sample_id, CAST(st.k AS INTEGER) AS k, CAST(r.pos AS INTEGER) AS pos,
       {r6('CASE WHEN r.rank <= st.t THEN 0.0 ELSE r.x END')} AS v
FROM r, st""")
def q_prefix_masks(spark, sf_dir):
    """D4 + D1: deletion path of 5 steps with the map = the input (baseline 0)."""
    smp = fx.samples(spark, sf_dir)
    long = smp.select("sample_id", F.posexplode("x").alias("pos", "x")).withColumn("e", F.col("x"))
    ranked = K.rank_positions(long, "e", "pos")
    out = K.prefix_masks(ranked, 64, 5, "deletion", 0.0)
    return out.select("sample_id", F.col("k").cast("int"), F.col("pos").cast("int"), rounded("v").alias("v"))


def _cell_sums(spark, sf_dir, grid: int):
    """(sample_id, cell, s): input mass per cell of a g x g grid (R2 pre-aggregation)."""
    smp = fx.samples(spark, sf_dir)
    rows = smp.select("sample_id", F.posexplode("x").alias("pos", "x"))
    return (rows.withColumn("cell", K.grid_cell(F.col("pos"), fx.MAP, grid))
            .groupBy("sample_id", "cell").agg(F.sum("x").alias("s")))


def _apply_design(cells, design, value):
    """sum over cells of value(m, s) per (sample, draw): designs join to cells, broadcast."""
    return (cells.join(F.broadcast(design), "cell").groupBy("sample_id", "draw")
            .agg(rounded(F.sum(value)).alias("s")))


def _cell_sql(grid: int) -> str:
    return (f"CAST(floor((floor(pos / 8) + 0.5) * {grid} / 8) * {grid} "
            f"+ floor(((pos % 8) + 0.5) * {grid} / 8) AS INTEGER)")


def _cells_cte(grid: int) -> str:
    return f"cs AS (SELECT sample_id, {_cell_sql(grid)} AS cell, sum(x) AS s FROM ({LONG_X_SQL}) GROUP BY ALL)"


def _design_sql(draws: int, cells: int, expr: str) -> str:
    return (f"SELECT CAST(d AS INTEGER) AS draw, CAST(c AS INTEGER) AS cell, {expr} AS m "
            f"FROM range({draws}) t1(d), range({cells}) t2(c)")


@register("random_grid_mask", f"""WITH {_cells_cte(4)},
dz AS ({_design_sql(20, 16, f"CASE WHEN {sql_uniform(7, 'd', 'c')} > 0.2 THEN 1.0 ELSE 0.0 END")})
SELECT sample_id, draw, {r6('sum(m * s)')} AS s FROM cs JOIN dz USING (cell) GROUP BY sample_id, draw""")
def q_random_grid_mask(spark, sf_dir):
    """D6 + D13: kept input mass under 4x4 grid masks (p = 0.2 dropped), 20 draws, seed 7."""
    return _apply_design(_cell_sums(spark, sf_dir, 4), D.random_grid_mask(spark, 4, 0.2, 20, seed=7),
                         F.col("m") * F.col("s"))


@register("binary_design", f"""WITH {_cells_cte(4)},
dz AS ({_design_sql(20, 16, f"CASE WHEN 0.5 > {sql_uniform(3, 'd', 'c')} THEN 1.0 ELSE 0.0 END")})
SELECT sample_id, draw, {r6('sum(m * s)')} AS s FROM cs JOIN dz USING (cell) GROUP BY sample_id, draw""")
def q_binary_design(spark, sf_dir):
    """LIME-style {0,1}^16 samples (prob 0.5, seed 3) applied to the inputs' cells."""
    return _apply_design(_cell_sums(spark, sf_dir, 4), D.binary_design(spark, 20, 16, 0.5, seed=3),
                         F.col("m") * F.col("s"))


def _sobol_values_sql(dims: int) -> str:
    rows = ", ".join(f"({i}, {b}, {v})" for i, vec in enumerate(D.direction_numbers(dims))
                     for b, v in enumerate(vec))
    return f"dn(cell, bit, v) AS (VALUES {rows})"


def _sobol_cte(draws: int, dims: int, name: str = "sb") -> str:
    return f"""{_sobol_values_sql(dims)},
{name} AS (SELECT CAST(t.d AS INTEGER) AS draw, CAST(dn.cell AS INTEGER) AS cell,
       CAST(bit_xor(CASE WHEN (t.d >> dn.bit) & 1 = 1 THEN dn.v ELSE 0 END) AS DOUBLE) / {float(1 << D.SOBOL_BITS)} AS m
       FROM range({draws}) t(d), dn GROUP BY t.d, dn.cell)"""


@register("sobol_design", f"""WITH {_cells_cte(4)},
{_sobol_cte(16, 16)}
SELECT sample_id, draw, {r6('sum(m * s)')} AS s FROM cs JOIN sb USING (cell) GROUP BY sample_id, draw""")
def q_sobol_design(spark, sf_dir):
    """D8 + D11 amplitude: inputs scaled cell-wise by 16 Sobol points in [0,1)^16."""
    return _apply_design(_cell_sums(spark, sf_dir, 4), D.sobol_design(spark, 16, 16), F.col("m") * F.col("s"))


@register("replicated_design", f"""WITH {_cells_cte(4)},
a AS ({_design_sql(4, 16, sql_uniform(11, 'd', 'c'))}),
b AS ({_design_sql(4, 16, sql_uniform(12, 'd', 'c'))}),
dz AS (SELECT 'A' AS block, -1 AS rep, draw, cell, m FROM a
       UNION ALL SELECT 'B', -1, draw, cell, m FROM b
       UNION ALL SELECT 'C', CAST(r AS INTEGER), a.draw, a.cell, CASE WHEN a.cell = r THEN b.m ELSE a.m END
       FROM a JOIN b USING (draw, cell), range(16) t(r))
SELECT sample_id, block, CAST(rep AS INTEGER) AS rep, draw, {r6('sum(m * s)')} AS s
FROM cs JOIN dz USING (cell) GROUP BY sample_id, block, rep, draw""")
def q_replicated_design(spark, sf_dir):
    """A, B and C_i designs (4 draws x 16 cells) applied to the inputs' cells."""
    a = D.uniform_design(spark, 4, 16, seed=11)
    b = D.uniform_design(spark, 4, 16, seed=12)
    rep = D.replicated_design(a, b, 16)
    cells = _cell_sums(spark, sf_dir, 4)
    return (cells.join(F.broadcast(rep), "cell").groupBy("sample_id", "block", "rep", "draw")
            .agg(rounded(F.sum(F.col("m") * F.col("s"))).alias("s")))


@register("blend", f"""
WITH dz AS ({_design_sql(4, 16, f"CASE WHEN 0.5 > {sql_uniform(5, 'd', 'c')} THEN 1.0 ELSE 0.0 END")}),
lx AS (SELECT sample_id, pos, x, {_cell_sql(4)} AS cell FROM ({LONG_X_SQL}))
SELECT sample_id, draw, CAST(pos AS INTEGER) AS pos, {r6('x * m + 0.25 * (1.0 - m)')} AS v
FROM lx JOIN dz USING (cell)""")
def q_blend(spark, sf_dir):
    """D10 + D13: perturbed inputs x*m + ref*(1-m) (ref 0.25) for 4 binary cell masks."""
    smp = fx.samples(spark, sf_dir)
    rows = (smp.select("sample_id", F.posexplode("x").alias("pos", "x"))
            .withColumn("cell", K.grid_cell(F.col("pos"), fx.MAP, 4)))
    design = D.binary_design(spark, 4, 16, 0.5, seed=5)
    out = rows.join(F.broadcast(design), "cell")
    return out.select("sample_id", "draw", F.col("pos").cast("int"),
                      rounded(K.blend(F.col("x"), F.col("m"), 0.25)).alias("v"))


@register("box_blur", f"""
WITH lx AS ({LONG_X_SQL})
SELECT a.sample_id, CAST(a.pos AS INTEGER) AS pos, {r6('avg(b.x)')} AS blur
FROM lx a JOIN lx b ON a.sample_id = b.sample_id
 AND abs(floor(a.pos / 8) - floor(b.pos / 8)) <= 1 AND abs((a.pos % 8) - (b.pos % 8)) <= 1
GROUP BY a.sample_id, a.pos""")
def q_box_blur(spark, sf_dir):
    """3x3 box blur clipped at the border (neighbour table joined on position)."""
    smp = fx.samples(spark, sf_dir)
    long = smp.select("sample_id", F.posexplode("x").alias("pos", "x"))
    b = K.box_blur(long, fx.MAP, 1)
    return b.select("sample_id", F.col("pos").cast("int"), rounded("blur").alias("blur"))


@register("segment_sums", f"""WITH {_cells_cte(4)}
SELECT sample_id, cell, {r6('s')} AS s FROM cs""")
def q_segment_sums(spark, sf_dir):
    """Input mass of each 2x2 super-pixel of a 4x4 grid segment map."""
    seg = K.segment_map(spark, fx.MAP, "grid", 4)
    smp = fx.samples(spark, sf_dir)
    rows = smp.select("sample_id", F.posexplode("x").alias("pos", "x")).join(seg, "pos")
    return rows.groupBy("sample_id", "cell").agg(rounded(F.sum("x")).alias("s"))


@register("expand_cells", f"""
WITH lx AS (SELECT sample_id, pos, x, {_cell_sql(4)} AS cell FROM ({LONG_X_SQL})),
cm AS (SELECT sample_id, cell, avg(x) AS v FROM lx GROUP BY ALL)
SELECT l.sample_id, CAST(l.pos AS INTEGER) AS pos, {r6('c.v')} AS v FROM lx l JOIN cm c USING (sample_id, cell)""")
def q_expand_cells(spark, sf_dir):
    """Cell values spread back to their positions (nearest expansion)."""
    seg = K.segment_map(spark, fx.MAP, "grid", 4)
    smp = fx.samples(spark, sf_dir)
    rows = smp.select("sample_id", F.posexplode("x").alias("pos", "x")).join(seg, "pos")
    cm = rows.groupBy("sample_id", "cell").agg(F.avg("x").alias("v"))
    return (cm.join(seg, "cell").select("sample_id", F.col("pos").cast("int"), rounded("v").alias("v")))


def bicubic_sql(grid: int, n_out: int, name: str = "bw") -> str:
    """Keys cubic (a = -1/2) resize weights g -> n, half-pixel centres, clamped borders, in SQL."""
    a = "(-0.5)"
    t = "abs(src - k)"
    w = (f"CASE WHEN {t} <= 1 THEN ({a} + 2) * {t}*{t}*{t} - ({a} + 3) * {t}*{t} + 1 "
         f"WHEN {t} < 2 THEN {a} * {t}*{t}*{t} - 5 * {a} * {t}*{t} + 8 * {a} * {t} - 4 * {a} ELSE 0 END")
    return f"""{name}_ax AS (
  SELECT o, CAST(least(greatest(k, 0), {grid - 1}) AS INTEGER) AS i, sum({w}) AS wt
  FROM (SELECT o, src, floor(src) + j AS k FROM
        (SELECT o, (o + 0.5) * {grid} / {n_out} - 0.5 AS src FROM range({n_out}) t(o)), range(-1, 3) u(j))
  GROUP BY o, least(greatest(k, 0), {grid - 1})),
{name} AS (SELECT CAST(r.i * {grid} + c.i AS INTEGER) AS cell, CAST(r.o * {n_out} + c.o AS INTEGER) AS pix,
                  r.wt * c.wt AS weight FROM {name}_ax r, {name}_ax c)"""


@register("resize_bicubic", f"""
WITH {_cells_cte(4)},
{bicubic_sql(4, 8)}
SELECT sample_id, pix, {r6('sum(weight * s / 4.0)')} AS v FROM cs JOIN bw USING (cell) GROUP BY sample_id, pix""")
def q_resize_bicubic(spark, sf_dir):
    """4x4 cell means upsampled to 8x8 by the static bicubic weight table."""
    cm = _cell_sums(spark, sf_dir, 4).withColumn("v", F.col("s") / 4.0)
    out = K.resize_bicubic(cm, K.bicubic_weights(spark, 4, fx.MAP))
    return out.select("sample_id", F.col("pix").cast("int"), rounded("v").alias("v"))


@register("off_class", f"""WITH {base_ctes()}
SELECT sample_id, CAST(target AS INTEGER) AS target,
       CAST(CASE WHEN r >= target THEN r + 1 ELSE r END AS INTEGER) AS off
FROM (SELECT sample_id, target, CAST(floor({sql_uniform(42, 'sample_id')} * 9) AS INTEGER) AS r FROM tg)""")
def q_off_class(spark, sf_dir):
    """A uniform class different from the predicted one (shift trick, seed 42)."""
    smp, mdl, tgt = fx.setup(spark, sf_dir)
    return tgt.select("sample_id", F.col("target").cast("int"),
                      D.off_class(F.col("target"), mdl.n_classes, 42, F.col("sample_id")).cast("int").alias("off"))


@register("target_score_one_hot", f"""WITH {base_ctes()}
SELECT t.sample_id, {r6('p.p')} AS score FROM tg t JOIN pp p ON p.sample_id = t.sample_id AND p.cls = t.target""")
def q_target_score_one_hot(spark, sf_dir):
    """S1 (array form) + P4: sum_c f(x)_c * y_c with y the one-hot prediction array."""
    smp = fx.samples(spark, sf_dir)
    mdl = fx.model(smp)
    probs = to_array(S.class_probabilities(mdl.logits(smp)), "p", "probs", pos_col="cls")
    pred = S.predictions(mdl, smp).select("sample_id", "one_hot")
    out = probs.join(pred, "sample_id").select("sample_id", S.one_hot_dot(F.col("probs"), F.col("one_hot")).alias("score"))
    return per_sample(out)
