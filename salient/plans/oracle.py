"""DuckDB text of the shared building blocks of the oracle queries.

Each oracle is an independent SQL statement over the driver tables; these
snippets are the common CTEs (samples, centroid weights, logits, targets),
written once so every oracle states the same model.
"""

from __future__ import annotations

TAU_SQL = "10.0"


def base_ctes(with_label: bool = True) -> str:
    """``ex, lx, wt, zz, zm, pp, tg``: samples, long inputs, weights, logits, probabilities, targets."""
    return f"""
ex AS (SELECT vec_id AS sample_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
lx AS (SELECT sample_id, label, unnest(generate_series(0, len(x) - 1)) AS pos, unnest(x) AS x FROM ex),
wt AS (SELECT label AS cls, pos, {TAU_SQL} * avg(x) AS w FROM lx GROUP BY label, pos),
nf AS (SELECT count(DISTINCT pos) AS n FROM wt),
zz AS (SELECT sample_id, cls, sum(x * w) AS z FROM lx JOIN wt USING (pos) GROUP BY sample_id, cls),
zm AS (SELECT sample_id, max(z) AS m FROM zz GROUP BY sample_id),
pp AS (SELECT sample_id, cls, z, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY sample_id) AS p
       FROM zz JOIN zm USING (sample_id)),
tg AS (SELECT sample_id, cls AS target FROM (
         SELECT sample_id, cls, row_number() OVER (PARTITION BY sample_id ORDER BY z DESC, cls) AS rn FROM zz)
       WHERE rn = 1)"""


def grad_coef_cte(name: str = "co", probs: str = "pp", targets: str = "tg") -> str:
    """``a_c = p_t ([c = t] - p_c)`` per (sample, cls)."""
    return f"""
{name} AS (SELECT p.sample_id, p.cls, pt.p * (CASE WHEN p.cls = t.target THEN 1.0 ELSE 0.0 END - p.p) AS a
       FROM {probs} p JOIN {targets} t USING (sample_id)
       JOIN {probs} pt ON pt.sample_id = p.sample_id AND pt.cls = t.target)"""


def project_cte(name: str, coef: str, value: str, weights: str = "wt") -> str:
    """Map ``e = value`` with ``g = sum_c a_c w_c`` (``value`` may use x and g)."""
    return f"""
{name}_g AS (SELECT l.sample_id, l.pos, l.x, sum(c.a * w.w) AS g
       FROM lx l JOIN {coef} c USING (sample_id) JOIN {weights} w ON w.pos = l.pos AND w.cls = c.cls
       GROUP BY l.sample_id, l.pos, l.x),
{name} AS (SELECT sample_id, pos, {value} AS e FROM {name}_g)"""


def causal_ctes(maps: str, mode: str, steps: int, baseline: float = 0.0, max_pct: float = 1.0,
                channels: int = 1) -> str:
    """Curve ``cv(sample_id, k, score)`` and AUC ``auc(sample_id, score)`` for a long map table.

    With ``channels`` > 1 the map is per pixel (``pos`` = pixel) and every
    channel of a pixel is switched with it.
    """
    b = f"CAST({float(baseline)!r} AS DOUBLE)"
    start, delta = ("l.x", f"{b} - l.x") if mode == "deletion" else (b, f"l.x - {b}")
    on = "USING (sample_id, pos)" if channels == 1 else f"ON l.sample_id = r.sample_id AND l.pos // {channels} = r.pos"
    return f"""
rk AS (SELECT sample_id, pos, dense_rank() OVER (PARTITION BY sample_id ORDER BY e DESC, pos) - 1 AS rank
       FROM {maps}),
pr AS (SELECT r.sample_id, w.cls, r.rank, sum(w.w * {start}) AS s, sum(w.w * ({delta})) AS d
       FROM rk r JOIN lx l {on} JOIN wt w ON w.pos = l.pos
       GROUP BY r.sample_id, w.cls, r.rank),
cu AS (SELECT sample_id, cls, rank,
              sum(s) OVER (PARTITION BY sample_id, cls)
              + sum(d) OVER (PARTITION BY sample_id, cls ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z
       FROM pr),
mx AS (SELECT CAST(floor((n // {channels}) * {float(max_pct)!r}) AS BIGINT) AS mn FROM nf),
st AS (SELECT CAST(k.range AS INTEGER) AS k, (k.range * (mx.mn - 1)) // {steps - 1} AS t FROM range({steps}) k, mx),
cz AS (SELECT c.sample_id, s.k, c.cls, c.z FROM cu c JOIN st s ON c.rank = s.t),
cm AS (SELECT sample_id, k, max(z) AS m FROM cz GROUP BY sample_id, k),
cv AS (SELECT c.sample_id, c.k,
              sum(CASE WHEN c.cls = t.target THEN exp(c.z - m.m) END) / sum(exp(c.z - m.m)) AS score
       FROM cz c JOIN cm m USING (sample_id, k) JOIN tg t USING (sample_id) GROUP BY c.sample_id, c.k),
auc AS (SELECT sample_id,
               (sum(score) - 0.5 * (sum(score) FILTER (WHERE k = 0) + sum(score) FILTER (WHERE k = {steps - 1})))
               / {float(steps - 1)!r} AS score
        FROM cv GROUP BY sample_id)"""


def r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def softmax_target_cte(name: str, src: str, keys: list[str], targets: str = "tg") -> str:
    """``name(sample_id, keys..., score)``: target probability from ``src(sample_id, keys..., cls, z)``."""
    ks = ", ".join(keys)
    sk = ", ".join(f"s.{k}" for k in keys)
    return f"""{name}_m AS (SELECT sample_id, {ks}, max(z) AS m FROM {src} GROUP BY sample_id, {ks}),
{name} AS (SELECT s.sample_id, {sk},
       sum(CASE WHEN s.cls = t.target THEN exp(s.z - m.m) END) / sum(exp(s.z - m.m)) AS score
       FROM {src} s JOIN {name}_m m USING (sample_id, {ks}) JOIN {targets} t USING (sample_id)
       GROUP BY s.sample_id, {sk})"""


def softmax_probs_cte(name: str, src: str, keys: list[str]) -> str:
    """``name(sample_id, keys..., cls, p)`` from ``src(sample_id, keys..., cls, z)``."""
    ks = ", ".join(keys)
    return f"""{name}_m AS (SELECT sample_id, {ks}, max(z) AS m FROM {src} GROUP BY sample_id, {ks}),
{name} AS (SELECT sample_id, {ks}, cls,
       exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY sample_id, {ks}) AS p
       FROM {src} JOIN {name}_m USING (sample_id, {ks}))"""


def draw_coef_cte(name: str, probs: str, keys: list[str], targets: str = "tg") -> str:
    """``name(sample_id, keys..., cls, a)`` with ``a_c = p_t ([c = t] - p_c)`` per draw."""
    on = " AND ".join([f"pt.{k} = p.{k}" for k in keys])
    pk = ", ".join(f"p.{k}" for k in keys)
    return f"""{name} AS (SELECT p.sample_id, {pk}, p.cls,
       pt.p * (CASE WHEN p.cls = t.target THEN 1.0 ELSE 0.0 END - p.p) AS a
       FROM {probs} p JOIN {targets} t USING (sample_id)
       JOIN {probs} pt ON pt.sample_id = p.sample_id AND {on} AND pt.cls = t.target)"""


def cell_sql(grid: int, h: int = 8, w: int = 8, pix: str = "pos") -> str:
    return (f"CAST(floor((floor({pix} / {w}) + 0.5) * {grid} / {h}) * {grid} "
            f"+ floor((({pix} % {w}) + 0.5) * {grid} / {w}) AS INTEGER)")
