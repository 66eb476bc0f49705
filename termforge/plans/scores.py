"""Probabilities, scores, calibration and deals."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from termforge.config import written
from termforge.functions.columns import logit, sigmoid, loadings
from termforge.operators import calibrate, curve, deal, gram, probability, regress, weekly
from termforge.plans.base import DECAY, FACT, MATURITIES, PANEL, WIDE, S, fact, panel, rewalk_sql, rounded, table, wide, with_sql
from termforge.plans.curves import _POOL, direct_models, direct_sql

Q, SQL = {}, {}
HORIZONS, CELLS, KS = S.horizons, S.maturities, S.thresholds
#: Forecasts from 1999 on, with residuals of the weeks from 1995 on; documents and labels give a score and a binary outcome.
_FIRST, _BURN_IN = "1999-01-01", "1995-01-01"


def add(name: str, query, sql: str | None = None) -> None:
    Q[name] = query
    if sql:
        SQL[name] = sql


def _weekly(spark, d):
    """The weekly prices and their factors, written: what follows reads them several times, and never the daily rows again."""
    p = written(panel(spark, d), "panel")
    return p, written(curve.factors(p, MATURITIES, DECAY), "factors")


def _setup(spark, d):
    p, base = _weekly(spark, d)
    every = regress.random_walk(base, HORIZONS, _BURN_IN)
    return every.where(F.col("week_end") >= F.lit(_FIRST).cast("date")), regress.residual_pool(every, base), p


def probabilities(spark, d, weight=None):
    forecasts, pool, p = _setup(spark, d)
    return probability.exceedance(forecasts, pool, p, CELLS, KS, DECAY, weight)


_RW4 = rewalk_sql(HORIZONS).replace(f"WHERE week_end >= DATE '{S.test_start}'", f"WHERE week_end >= DATE '{_BURN_IN}'")
_GRID = ["cells(maturity, s, c) AS (VALUES " + ", ".join(f"({m}, {loadings(m, DECAY)[1]!r}::DOUBLE, {loadings(m, DECAY)[2]!r}::DOUBLE)" for m in CELLS) + ")", "ks(threshold) AS (VALUES " + ", ".join(f"({k}::DOUBLE)" for k in KS) + ")"]


def phi_sql(z: str) -> str:
    """The normal distribution function by the textbook polynomial that the engine uses, of a column or expression in parentheses."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    poly = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))"
    erf = f"(1 - {poly} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


def probs_sql(forecasts: str, pool: str, weight: str, name: str = "probs") -> list[str]:
    """CTEs of exceedance: forecasts (week_end, horizon, model, beta0..2, t_plus_h), pool (horizon, model, realized_date, r0..2)."""
    return [
        f"""{name}_sim AS (SELECT f.week_end, f.horizon, f.model, f.t_plus_h, c.maturity, k.price AS cur, CASE WHEN p.r0 IS NOT NULL THEN {weight} END AS w, f.beta0 + c.s * f.beta1 + c.c * f.beta2 AS mu,
          sqrt(1e-4 * (1 + c.s * c.s + c.c * c.c)) AS sd, exp(f.beta0 + p.r0 + c.s * (f.beta1 + p.r1) + c.c * (f.beta2 + p.r2)) AS f
          FROM {forecasts} f CROSS JOIN cells c JOIN panel k ON k.week_end = f.week_end AND k.maturity = c.maturity
          LEFT JOIN {pool} p ON p.horizon = f.horizon AND p.model = f.model AND p.realized_date <= f.week_end)""",
        f"""{name} AS (SELECT s.week_end, s.horizon, s.model, s.maturity, ks.threshold,
          CASE WHEN count(w) >= 5 THEN sum(CASE WHEN f > cur * (1 + threshold) THEN w ELSE 0 END) / sum(w) ELSE 1 - {phi_sql('((ln(any_value(cur) * (1 + threshold)) - any_value(mu)) / any_value(sd))')} END AS p_up,
          CASE WHEN count(w) >= 5 THEN sum(CASE WHEN f < cur * (1 - threshold) THEN w ELSE 0 END) / sum(w) ELSE {phi_sql('((ln(any_value(cur) * (1 - threshold)) - any_value(mu)) / any_value(sd))')} END AS p_down,
          CASE WHEN a.price IS NOT NULL THEN (a.price > any_value(cur) * (1 + threshold))::INTEGER END AS actual_up,
          CASE WHEN a.price IS NOT NULL THEN (a.price < any_value(cur) * (1 - threshold))::INTEGER END AS actual_down, count(w) AS n_pool, any_value(s.t_plus_h) AS t_plus_h
          FROM {name}_sim s CROSS JOIN ks LEFT JOIN panel a ON a.week_end = s.t_plus_h AND a.maturity = s.maturity
          GROUP BY s.week_end, s.horizon, s.model, s.maturity, ks.threshold, a.price)""",
    ]


_FROM_RW = [f"now AS (SELECT *, 0 AS model FROM rw WHERE week_end >= DATE '{_FIRST}')", "known AS (SELECT *, 0 AS model FROM pool)"]


def _prob_sql(weight: str) -> list[str]:
    return [FACT, _RW4, _POOL, *_GRID, *_FROM_RW, *probs_sql("now", "known", weight)]


_P = _prob_sql("1.0::DOUBLE")
_SHOWN = "SELECT week_end, horizon, model, maturity, threshold, round(p_up, 6) AS p_up, round(p_down, 6) AS p_down, actual_up, actual_down, n_pool FROM probs"
add("bootstrap_exceedance_rw", lambda s, d: rounded(probabilities(s, d).drop("t_plus_h")), with_sql(*_P, _SHOWN))
_BY_AGE = "power(0.997, (f.week_end - p.realized_date) / 7.0::DOUBLE)"
add("weighted_bootstrap_exceedance", lambda s, d: rounded(probabilities(s, d, 0.997).drop("t_plus_h")), with_sql(*_prob_sql(_BY_AGE), _SHOWN))


def _small_pools(spark, d):
    """The first weeks after a burn-in that starts late: pools of no, few and enough residuals."""
    base = fact(spark, d)
    every = regress.random_walk(base, HORIZONS, _FIRST)
    early = every.where(F.col("week_end") <= F.lit("1999-09-30").cast("date"))
    return probability.exceedance(early, regress.residual_pool(every, base), panel(spark, d), CELLS, KS, DECAY)


add("exceedance_small_pools", lambda s, d: rounded(_small_pools(s, d).drop("t_plus_h"), 5), with_sql(FACT, _RW4.replace(_BURN_IN, _FIRST), _POOL, *_GRID, "now AS (SELECT *, 0 AS model FROM rw WHERE week_end <= DATE '1999-09-30')", _FROM_RW[1],
    *probs_sql("now", "known", "1.0::DOUBLE"), _SHOWN.replace(", 6)", ", 5)")))


def _gauss(spark, d):
    """Each week's normal probabilities by the covariance of the residuals realised by then."""
    forecasts, pool, p = _setup(spark, d)
    return probability.gaussian_exceedance(forecasts, regress.expanding_covariance(pool).drop("n"), p, CELLS, KS, DECAY)


_SIX = [(i, j) for i in range(3) for j in range(i, 3)]
_LOAD = ("1", "c.s", "c.c")
_GAUSS = [FACT, _RW4, _POOL, *_GRID, *_FROM_RW,
    "ecov AS (SELECT horizon, realized_date AS week_end, count(*) OVER w AS n, " + ", ".join(f"CASE WHEN count(*) OVER w >= 5 THEN covar_samp(r{i}, r{j}) OVER w ELSE {1e-4 if i == j else 0.0} END AS s{i}{j}" for i, j in _SIX)
    + " FROM pool WINDOW w AS (PARTITION BY horizon ORDER BY realized_date, origin ROWS UNBOUNDED PRECEDING))",
    "gs AS (SELECT now.*, " + ", ".join(f"coalesce(e.s{i}{j}, {1e-4 if i == j else 0.0}) AS s{i}{j}" for i, j in _SIX) + " FROM now ASOF LEFT JOIN ecov e ON e.horizon = now.horizon AND e.week_end <= now.week_end)",
    "gm AS (SELECT gs.week_end, gs.horizon, gs.model, c.maturity, k.price AS cur, beta0 + c.s * beta1 + c.c * beta2 AS mu, sqrt(" + " + ".join(f"{1 if i == j else 2} * {_LOAD[i]} * {_LOAD[j]} * s{i}{j}" for i, j in _SIX)
    + ") AS sd FROM gs CROSS JOIN cells c JOIN panel k ON k.week_end = gs.week_end AND k.maturity = c.maturity)",
    f"gauss AS (SELECT *, 1 - {phi_sql('zu')} AS p_up, {phi_sql('zd')} AS p_down FROM (SELECT gm.*, threshold, (ln(cur * (1 + threshold)) - mu) / sd AS zu, (ln(cur * (1 - threshold)) - mu) / sd AS zd FROM gm CROSS JOIN ks))"]
add("gaussian_exceedance", lambda s, d: rounded(_gauss(s, d), 5), with_sql(*_GAUSS, "SELECT week_end, horizon, model, maturity, threshold, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("p_up", "p_down", "mu", "sd")) + " FROM gauss"))
_Q = {"p05": -1.6448536269514722, "p50": 0.0, "p95": 1.6448536269514722}
add("price_bands", lambda s, d: rounded(probability.price_bands(_gauss(s, d), _Q), 3), with_sql(*_GAUSS, "SELECT DISTINCT week_end, horizon, model, maturity, " + ", ".join(f"round(exp(mu + {z!r} * sd), 3) AS {n}" for n, z in _Q.items()) + " FROM gauss"))


def _both(spark, d):
    """Brier skill of the pooled and of the Gaussian probabilities, each against the same outcomes."""
    pooled = probabilities(spark, d)
    keys = ["week_end", "horizon", "model", "maturity", "threshold"]
    normal = _gauss(spark, d).select(*keys, "p_up", "p_down").join(pooled.select(*keys, "actual_up", "actual_down"), keys)
    a = probability.brier(probability.by_direction(pooled), KEYS).select(*KEYS, F.col("brier_score").alias("brier_pool"), F.col("brier_skill").alias("skill_pool"))
    b = probability.brier(probability.by_direction(normal), KEYS).select(*KEYS, F.col("brier_score").alias("brier_normal"), F.col("brier_skill").alias("skill_normal"))
    return rounded(a.join(b, KEYS).withColumn("pool_better", F.col("brier_pool") < F.col("brier_normal")), 5)


KEYS = ["model", "horizon", "maturity", "threshold", "direction"]
_K = ", ".join(KEYS)


def _brier_sql(source: str, kind: str) -> str:
    return f"""b_{kind} AS (SELECT {_K}, avg((p - actual) * (p - actual)) AS brier_{kind}, 1 - avg((p - actual) * (p - actual)) / nullif(avg(actual) * (1 - avg(actual)), 0) AS skill_{kind}
      FROM (SELECT horizon, model, maturity, threshold, unnest(['up', 'down']) AS direction, unnest([p_up, p_down]) AS p, unnest([actual_up, actual_down]) AS actual FROM {source}) WHERE actual IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)"""


add("gaussian_vs_bootstrap", _both, with_sql(*_GAUSS, *probs_sql("now", "known", "1.0::DOUBLE"), "gp AS (SELECT g.* EXCLUDE cur, p.actual_up, p.actual_down FROM gauss g JOIN probs p USING (week_end, horizon, model, maturity, threshold))",
    _brier_sql("probs", "pool"), _brier_sql("gp", "normal"), f"SELECT {_K}, round(brier_pool, 5) AS brier_pool, round(skill_pool, 5) AS skill_pool, round(brier_normal, 5) AS brier_normal, round(skill_normal, 5) AS skill_normal, brier_pool < brier_normal AS pool_better FROM b_pool JOIN b_normal USING ({_K})"))

# models 1 to 3 -------------------------------------------------------------------------------
def walk_forward(spark, d):
    """Exceedance of all four models from residuals realised by each week; those of model 3 weigh less with age."""
    p, base = _weekly(spark, d)
    every = written(direct_models(spark, d, _BURN_IN), "forecasts")
    now, pool = every.where(F.col("week_end") >= F.lit(S.test_start)), regress.residual_pool(every, base)
    parts = [probability.exceedance(now.where(c), pool.where(c), p, CELLS, KS, DECAY, w) for c, w in (("model < 3", None), ("model = 3", S.ew_decay))]
    return parts[0].unionByName(parts[1])


_ALL = [*direct_sql(1, first=_BURN_IN)[:-1], *direct_sql(2, first=_BURN_IN)[1:], *direct_sql(3, S.ew_decay, first=_BURN_IN)[3:],
    "ev AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT week_end, horizon, {m} AS model, {', '.join(f'b{i} AS beta{i}' for i in range(3))}, t_plus_h FROM dir{m}" for m in (1, 2, 3)) + f" UNION ALL SELECT week_end, horizon, 0, beta0, beta1, beta2, t_plus_h FROM rw))",
    f"now AS (SELECT * FROM ev WHERE week_end >= DATE '{S.test_start}')", "known AS (SELECT ev.horizon, ev.model, ev.t_plus_h AS realized_date, " + ", ".join(f"f.beta{i} - ev.beta{i} AS r{i}" for i in range(3)) + " FROM ev JOIN fact f ON f.week_end = ev.t_plus_h)"]
_ALL.insert(1, _RW4)
_WALK = [*_ALL, *_GRID, *probs_sql("now", "known", f"CASE WHEN f.model = 3 THEN {_BY_AGE} ELSE 1.0::DOUBLE END")]
add("walkforward_exceedance", lambda s, d: walk_forward(s, d).groupBy("horizon", "model", "maturity", "threshold").agg(
    F.count(F.lit(1)).alias("n"), F.round(F.avg("p_up"), 4).alias("mean_p_up"), F.round(F.avg("p_down"), 4).alias("mean_p_down"), F.sum("actual_up").alias("ups"), F.sum("actual_down").alias("downs"), F.min("n_pool").alias("least_pool")),
    with_sql(*_WALK, "SELECT horizon, model, maturity, threshold, count(*) AS n, round(avg(p_up), 4) AS mean_p_up, round(avg(p_down), 4) AS mean_p_down, sum(actual_up)::BIGINT AS ups, sum(actual_down)::BIGINT AS downs, min(n_pool) AS least_pool FROM probs GROUP BY ALL"))
add("walkforward_brier", lambda s, d: rounded(probability.brier(probability.by_direction(walk_forward(s, d)), KEYS).select(*KEYS, F.col("brier_score").alias("brier_all"), F.col("brier_skill").alias("skill_all")), 4), with_sql(*_WALK,
    _brier_sql("probs", "all"), f"SELECT {_K}, round(brier_all, 4) AS brier_all, round(skill_all, 4) AS skill_all FROM b_all"))
_SCAN = ["model", "horizon", "direction"]


def _walk_auc(spark, d):
    rows = probability.by_direction(walk_forward(spark, d)).withColumn("p", F.round("p", 9))
    return probability.auc(rows, KEYS, 10)


_LONG = """dir AS (SELECT * FROM (SELECT week_end, horizon, model, maturity, threshold, 'up' AS direction, p_up AS p, actual_up AS actual FROM probs
  UNION ALL SELECT week_end, horizon, model, maturity, threshold, 'down', p_down, actual_down FROM probs) WHERE actual IS NOT NULL)"""
_VERDICT = """CASE WHEN auc IS NULL THEN 'UNDEFINED' WHEN least(n_pos, n_neg) < 5 THEN 'INSUFFICIENT' WHEN auc > 0.58 THEN 'GENUINE' WHEN auc >= 0.42 THEN 'WEAK' ELSE 'INVERTED' END AS verdict"""
#: AUC by the sum of the positive outcomes' ranks, ties sharing their mean rank.
_RANKED = [_LONG, f"""rk AS (SELECT {_K}, actual, rank() OVER (PARTITION BY {_K} ORDER BY p) + (count(*) OVER (PARTITION BY {_K}, p) - 1) / 2.0::DOUBLE AS r FROM (SELECT * EXCLUDE p, round(p, 9) AS p FROM dir))""",
    f"ns AS (SELECT {_K}, sum(r) FILTER (actual = 1) AS ranks, count(*) FILTER (actual = 1) AS n_pos, count(*) FILTER (actual = 0) AS n_neg FROM rk GROUP BY ALL HAVING count(*) >= 10)",
    f"cells_auc AS (SELECT *, {_VERDICT} FROM (SELECT {_K}, (ranks - n_pos * (n_pos + 1) / 2.0::DOUBLE) / nullif(n_pos * n_neg, 0) AS auc, n_pos, n_neg FROM ns))"]
add("walkforward_auc", lambda s, d: rounded(_walk_auc(s, d), 5), with_sql(*_WALK, *_RANKED, f"SELECT {_K}, round(auc, 5) AS auc, n_pos, n_neg, verdict FROM cells_auc"))
add("mean_auc_by_model", lambda s, d: rounded(probability.mean_auc(_walk_auc(s, d), _SCAN), 5), with_sql(*_WALK, *_RANKED,
    "SELECT model, horizon, direction, round(avg(auc), 5) AS mean_auc, count(*) AS n_cells FROM cells_auc WHERE verdict NOT IN ('UNDEFINED', 'INSUFFICIENT') GROUP BY ALL"))


def _preperiod(spark, d):
    """The autoregression's probabilities before the test period, from the residuals of each week's own fit; outcomes known."""
    p, base = _weekly(spark, d)
    rows = gram.in_sample_residuals(base.select("week_end", "beta0", "beta1", "beta2"), HORIZONS, "1998-01-01", S.test_start)
    return probability.pooled_exceedance(rows, p, CELLS, KS, DECAY).where("actual_up is not null")


_PRE = [*direct_sql(1, first="1998-01-01")[:-2],
    f"pr AS (SELECT d.week_end, d.horizon, 1 AS model, d.t_plus_h, d.b0 AS beta0, d.b1 AS beta1, d.b2 AS beta2, p.t_plus_h AS realized_date, " + ", ".join(f"p.z{4 + y} - f.c{y}_0 - f.c{y}_1 * p.z1 - f.c{y}_2 * p.z2 - f.c{y}_3 * p.z3 AS r{y}" for y in range(3))
    + f" FROM dir1 d JOIN fit1 f ON f.week_end = d.week_end AND f.horizon = d.horizon JOIN pairs1 p ON p.horizon = d.horizon AND p.t_plus_h <= d.week_end WHERE d.week_end < DATE '{S.test_start}' AND d.t_plus_h IS NOT NULL AND f.n_fit >= 6)",
    *_GRID,
    """sm AS (SELECT pr.week_end, pr.horizon, pr.model, pr.t_plus_h, c.maturity, k.price AS cur, exp(beta0 + r0 + c.s * (beta1 + r1) + c.c * (beta2 + r2)) AS f FROM pr CROSS JOIN cells c JOIN panel k ON k.week_end = pr.week_end AND k.maturity = c.maturity)""",
    """pp AS (SELECT s.week_end, s.horizon, s.maturity, threshold, avg((f > cur * (1 + threshold))::INTEGER) AS p_up, avg((f < cur * (1 - threshold))::INTEGER) AS p_down, count(*) AS n_pool, (a.price > any_value(cur) * (1 + threshold))::INTEGER AS actual_up, (a.price < any_value(cur) * (1 - threshold))::INTEGER AS actual_down
      FROM sm s CROSS JOIN ks JOIN panel a ON a.week_end = s.t_plus_h AND a.maturity = s.maturity GROUP BY s.week_end, s.horizon, s.maturity, threshold, a.price)"""]  # fmt: skip
add("preperiod_exceedance_ar", lambda s, d: _preperiod(s, d).groupBy("horizon", "maturity", "threshold").agg(
    F.count(F.lit(1)).alias("n"), F.round(F.avg("p_up"), 4).alias("mean_p_up"), F.round(F.avg("p_down"), 4).alias("mean_p_down"), F.sum("actual_up").alias("ups"), F.sum("actual_down").alias("downs"), F.max("n_pool").alias("largest_pool")),
    with_sql(*_PRE, "SELECT horizon, maturity, threshold, count(*) AS n, round(avg(p_up), 4) AS mean_p_up, round(avg(p_down), 4) AS mean_p_down, sum(actual_up)::BIGINT AS ups, sum(actual_down)::BIGINT AS downs, max(n_pool) AS largest_pool FROM pp GROUP BY ALL"))


def _rows(spark, d):
    return probability.by_direction(probabilities(spark, d))


add("brier_scores", lambda s, d: rounded(probability.brier(_rows(s, d), KEYS)), with_sql(*_P, _LONG,
    f"""SELECT {_K}, round(avg((p - actual) * (p - actual)), 6) AS brier_score, round(avg(actual), 6) AS base_rate, count(*) AS n,
    round(1 - avg((p - actual) * (p - actual)) / nullif(avg(actual) * (1 - avg(actual)), 0), 6) AS brier_skill FROM dir GROUP BY ALL HAVING count(*) >= 5"""))


def _auc_sql(keys: str, source: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""WITH_PAIRS AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, avg(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END::DOUBLE) AS auc
      FROM {source} a JOIN {source} b ON {on} AND a.actual = 1 AND b.actual = 0 GROUP BY ALL),
    sizes AS (SELECT {keys}, count(*) FILTER (actual = 1) AS n_pos, count(*) FILTER (actual = 0) AS n_neg FROM {source} GROUP BY ALL)"""


add("auc_verdicts", lambda s, d: rounded(probability.auc(_rows(s, d).withColumn("p", F.round("p", 12)), KEYS)), with_sql(*_P, "raw_" + _LONG.replace("dir AS", "dir AS", 1), "dir AS (SELECT * EXCLUDE p, round(p, 12) AS p FROM raw_dir)", _auc_sql(_K, "dir"),
    f"SELECT {_K}, round(auc, 6) AS auc, n_pos, n_neg, {_VERDICT} FROM sizes LEFT JOIN WITH_PAIRS USING ({_K})"))


def _documents(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select("lang", (F.col("n_chars") % 997 / 996.0).alias("p"), F.col("quality").alias("actual"))


_DOCS = "docs AS (SELECT lang, (n_chars % 997) / 996.0::DOUBLE AS p, quality AS actual FROM documents JOIN labels USING (doc_id))"
add("auc_by_group", lambda s, d: rounded(probability.auc(_documents(s, d), ["lang"])), with_sql(_DOCS, _auc_sql("lang", "docs"), f"SELECT lang, round(auc, 6) AS auc, n_pos, n_neg, {_VERDICT} FROM sizes LEFT JOIN WITH_PAIRS USING (lang)"))
add("auc_by_period", lambda s, d: rounded(probability.auc(_rows(s, d).withColumn("p", F.round("p", 12)).withColumn("period", F.when(F.col("week_end") >= F.lit(S.shock), "shock").otherwise("stable")), ["horizon", "direction", "period"], 15)),
    with_sql(*_P, "raw_" + _LONG, f"dir AS (SELECT * EXCLUDE p, round(p, 12) AS p, CASE WHEN week_end >= DATE '{S.shock}' THEN 'shock' ELSE 'stable' END AS period FROM raw_dir)", _auc_sql("horizon, direction, period", "dir"),
    f"SELECT horizon, direction, period, round(auc, 6) AS auc, n_pos, n_neg, {_VERDICT} FROM sizes LEFT JOIN WITH_PAIRS USING (horizon, direction, period) WHERE n_pos + n_neg >= 15"))
_BIN = " + ".join(f"(p >= {i / 10!r})::INTEGER" for i in range(1, 10))
add("reliability_bins", lambda s, d: rounded(probability.reliability(_documents(s, d), ["lang"])), with_sql(_DOCS,
    f"SELECT lang, ({_BIN})::INTEGER AS bin, round(avg(p), 6) AS mean_p, round(avg(actual), 6) AS observed, count(*) AS n FROM docs GROUP BY 1, 2 HAVING count(*) >= 3"))
add("sharpness_histogram", lambda s, d: probability.sharpness(_documents(s, d), ["lang"]), with_sql(_DOCS, f"SELECT lang, ({_BIN})::INTEGER AS bin, count(*) AS n FROM docs GROUP BY 1, 2"))
add("directional_accuracy", lambda s, d: rounded(probability.directional_accuracy(probabilities(s, d), ["horizon", "maturity", "threshold"])), with_sql(*_P,
    """SELECT horizon, maturity, threshold, round(avg(((actual_up = 1 AND p_up > p_down) OR (actual_down = 1 AND p_down > p_up))::INTEGER), 6) AS accuracy, count(*) AS n_breaches
    FROM probs WHERE actual_up = 1 OR actual_down = 1 GROUP BY 1, 2, 3"""))

_A, _B = 0.7, -0.2
add("platt_apply", lambda s, d: rounded(_documents(s, d).select("lang", "p", sigmoid(_A * logit(F.col("p")) + _B).alias("p_cal")).groupBy("lang").agg(F.avg("p").alias("p"), F.avg("p_cal").alias("p_cal"))), with_sql(_DOCS,
    "q AS (SELECT lang, p, greatest(least(p, 1 - 1e-4), 1e-4) AS q FROM docs)", f"SELECT lang, round(avg(p), 6) AS p, round(avg(1 / (1 + exp(-({_A} * ln(q / (1 - q)) + {_B})))), 6) AS p_cal FROM q GROUP BY 1"))
def newton_sql(keys: str, points: str, steps: int = 12) -> list[str]:
    """CTEs of calibrate.fit_pooled for rows (keys, p, actual) of `points`, up to `maps`: keys, a, b, n_fit."""
    out = [
        f"pts AS (SELECT {keys}, ln(q / (1 - q)) AS z, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM (SELECT {keys}, greatest(least(p, 1 - 1e-4), 1e-4) AS q, actual AS y FROM {points} WHERE actual IS NOT NULL AND p IS NOT NULL) GROUP BY ALL)",
        f"start AS (SELECT {keys}, n_fit, ln(r / (1 - r)) AS flat FROM (SELECT {keys}, sum(n)::BIGINT AS n_fit, greatest(least(sum(y) / sum(n), 1 - 1e-4), 1e-4) AS r FROM pts GROUP BY ALL) WHERE n_fit >= 20)",
        "nw0 AS (SELECT *, 0.0::DOUBLE AS a, flat AS b FROM start)",
    ]
    for i in range(steps):
        out.append(f"""nw{i + 1} AS (SELECT {keys}, n_fit, flat, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
          SELECT {keys}, n_fit, flat, a, b, sum((y - n * s) * z) AS ga, sum(y - n * s) AS gb, sum(n * s * (1 - s) * z * z) + 1e-9 AS haa, sum(n * s * (1 - s) * z) AS hab, sum(n * s * (1 - s)) + 1e-9 AS hbb
          FROM (SELECT *, 1 / (1 + exp(-greatest(least(a * z + b, 30), -30))) AS s FROM pts JOIN nw{i} USING ({keys})) GROUP BY {keys}, n_fit, flat, a, b))""")
    return [*out, f"maps AS (SELECT {keys}, CASE WHEN a > 0 THEN least(a, 50) ELSE 0 END AS a, CASE WHEN a > 0 THEN b ELSE flat END AS b, n_fit FROM nw{steps})"]


add("platt_fit", lambda s, d: rounded(calibrate.fit_pooled(_documents(s, d), ["lang"])), with_sql(_DOCS, *newton_sql("lang", "docs"), "SELECT lang, round(a, 6) AS a, round(b, 6) AS b, n_fit FROM maps"))
_CALIBRATED = f"""cal AS (SELECT * EXCLUDE (a, b), 1 / (1 + exp(-greatest(least(a * ln(q / (1 - q)) + b, 30), -30))) AS c FROM (SELECT *, greatest(least(p, 1 - 1e-4), 1e-4) AS q FROM dir) LEFT JOIN maps USING ({_K}))"""
add("platt_pooled", lambda s, d: rounded(calibrate.skill_table(calibrate.pooled(written(_rows(s, d), "probabilities"), KEYS, S.shock), KEYS)), with_sql(*_P, _LONG, f"before AS (SELECT * FROM dir WHERE week_end < DATE '{S.shock}')", *newton_sql(_K, "before"), _CALIBRATED,
    "sk AS (SELECT " + _K + """, avg((p - actual) * (p - actual)) AS raw, avg((c - actual) * (c - actual)) FILTER (c IS NOT NULL) AS fine, nullif(avg(actual) * (1 - avg(actual)), 0) AS climate, avg(actual) AS rate, count(*) AS n FROM cal GROUP BY ALL HAVING count(*) >= 5)""",
    f"SELECT {_K}, round(raw, 6) AS brier_raw, round(1 - raw / climate, 6) AS bss_raw, round(rate, 6) AS base_rate, n, round(fine, 6) AS brier_cal, round(1 - fine / climate, 6) AS bss_cal FROM sk"))


def _realised(spark, d):
    """All models' probabilities and the autoregression's before the test period, with the week in which each came true."""
    rows = walk_forward(spark, d).unionByName(_preperiod(spark, d))
    # Calibrations read these rows several times.
    return written(probability.by_direction(rows).withColumnRenamed("t_plus_h", "realized_date"), "probabilities")


_RKEYS = ["model", "horizon", "threshold", "direction"]
_PRE_REALISED = """pre AS (SELECT p.week_end, p.horizon, 1 AS model, maturity, threshold, p_up, p_down, actual_up, actual_down, d.t_plus_h FROM pp p JOIN dir1 d USING (week_end, horizon))"""
#: The rows of _realised: those of the test period come from other fits than those before it, so each has its own names.
_REALISED = [*_WALK, *[re.sub(r"\b(means1|pairs1|run1|fit1|dir1|err1|rows1)\b", r"pre_\1", part) for part in [*_PRE[1:], _PRE_REALISED] if not part.startswith(("cells(", "ks("))],
    """rdir AS (SELECT model, horizon, threshold, maturity, week_end, t_plus_h AS realized, unnest(['up', 'down']) AS direction, unnest([p_up, p_down]) AS p, unnest([actual_up, actual_down]) AS actual
      FROM (SELECT week_end, horizon, model, maturity, threshold, p_up, p_down, actual_up, actual_down, t_plus_h FROM probs UNION ALL SELECT * FROM pre))"""]  # fmt: skip


def rolling_sql(keys: str, source: str, weeks: int | None, shock, least_rows: int = 20, least_dates: int = 10, name: str = "rf") -> list[str]:
    """CTEs of calibrate.rolling up to `name` for rows (keys, week_end, realized, p, actual) of source: each date meets the cells that count."""
    c, young = calibrate, "" if weeks is None else f" AND c.week_end >= t.week_end - {7 * weeks}"
    join = f"{name}_t t JOIN {name}_c c ON " + " AND ".join(f"t.{k} = c.{k}" for k in keys.split(", ")) + f" AND c.realized <= t.week_end{young}"
    on = ", ".join(f"t.{k}" for k in keys.split(", ")) + ", t.week_end"
    out = [
        f"{name}_t AS (SELECT DISTINCT {keys}, week_end FROM {source} WHERE actual IS NOT NULL)",
        f"""{name}_c AS (SELECT {keys}, week_end, realized, least(floor((z + {c.EDGE}) / {2 * c.EDGE} * {c.BINS}), {c.BINS - 1}) AS bin, count(*)::DOUBLE AS n, sum(actual)::DOUBLE AS y, sum(z) AS z
          FROM (SELECT *, ln(q / (1 - q)) AS z FROM (SELECT *, greatest(least(p, 1 - 1e-4), 1e-4) AS q FROM {source} WHERE p IS NOT NULL AND actual IS NOT NULL AND realized IS NOT NULL AND week_end < DATE '{shock}')) GROUP BY ALL)""",
        f"{name}_b AS (SELECT {on}, bin, sum(n) AS n, sum(y) AS y, sum(z) / sum(n) AS z FROM {join} GROUP BY ALL)",
        f"{name}_d AS (SELECT {on}, sum(n)::INTEGER AS n_used, count(DISTINCT c.week_end)::INTEGER AS n_dates_used, sum(n) AS n, sum(y) AS y FROM {join} GROUP BY ALL)",
        f"{name}_0 AS (SELECT {keys}, week_end, n, y AS hits, ln(r / (1 - r)) AS flat, 0.0::DOUBLE AS a, ln(r / (1 - r)) AS b FROM (SELECT *, greatest(least(y / n, 1 - 1e-4), 1e-4) AS r FROM {name}_d WHERE week_end < DATE '{shock}' AND n_used >= {least_rows} AND n_dates_used >= {least_dates}))",
    ]
    for i in range(c.STEPS):
        out.append(f"""{name}_{i + 1} AS MATERIALIZED (SELECT {keys}, week_end, n, hits, flat, a + da / greatest(1.0, abs(da) / {c.LARGEST_STEP}, abs(db) / {c.LARGEST_STEP}) AS a, b + db / greatest(1.0, abs(da) / {c.LARGEST_STEP}, abs(db) / {c.LARGEST_STEP}) AS b FROM (
          SELECT *, (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS da, (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS db FROM (
          SELECT {keys}, week_end, n, hits, flat, a, b, sum((y - k * s) * z) - {c.RIDGE} * a AS ga, sum(y - k * s) AS gb, sum(k * s * (1 - s) * z * z) + {c.RIDGE} AS haa, sum(k * s * (1 - s) * z) AS hab, sum(k * s * (1 - s)) + 1e-9 AS hbb
          FROM (SELECT f.*, p.n AS k, p.y, p.z, 1 / (1 + exp(-greatest(least(a * z + b, 30), -30))) AS s FROM {name}_{i} f JOIN {name}_b p USING ({keys}, week_end)) GROUP BY {keys}, week_end, n, hits, flat, a, b)))""")
    plain = "hits = 0 OR hits = n OR a <= 0"
    return [*out,
        f"{name}_f AS (SELECT {keys}, week_end, CASE WHEN {plain} THEN 0.0 ELSE a END AS a, CASE WHEN {plain} THEN flat ELSE b END AS b FROM {name}_{c.STEPS})",
        f"""{name} AS (SELECT {keys}, week_end, CASE WHEN week_end < DATE '{shock}' THEN a ELSE last_value(a IGNORE NULLS) OVER w END AS a, CASE WHEN week_end < DATE '{shock}' THEN b ELSE last_value(b IGNORE NULLS) OVER w END AS b,
          coalesce(n_used, 0) AS n_used, coalesce(n_dates_used, 0) AS n_dates_used, week_end < DATE '{shock}' AND a IS NOT NULL AS in_domain
          FROM {name}_t LEFT JOIN {name}_d USING ({keys}, week_end) LEFT JOIN {name}_f USING ({keys}, week_end) WINDOW w AS (PARTITION BY {keys} ORDER BY week_end ROWS UNBOUNDED PRECEDING))"""]  # fmt: skip


def _calibrated_sql(keys: str, source: str, name: str) -> str:
    """CTE cal_{name}: rows of source with c, the calibrated probability."""
    return f"""cal_{name} AS (SELECT s.*, in_domain, n_used, CASE WHEN a IS NOT NULL THEN 1 / (1 + exp(-greatest(least(a * ln(q / (1 - q)) + b, 30), -30))) END AS c
      FROM (SELECT *, greatest(least(p, 1 - 1e-4), 1e-4) AS q FROM {source} WHERE actual IS NOT NULL) s LEFT JOIN {name} USING ({keys}, week_end))"""


def _skill(p: str, where: str = "TRUE") -> str:
    return f"1 - avg(({p} - actual) * ({p} - actual)) FILTER ({where}) / nullif(avg(actual) FILTER ({where}) * (1 - avg(actual) FILTER ({where})), 0)"


_R, _WINDOWS = ", ".join(_RKEYS), (52, 78, 104, 156, None)
add("platt_rolling", lambda s, d: rounded(calibrate.rolling(_realised(s, d), _RKEYS, 104, S.shock), 5), with_sql(*_REALISED, *rolling_sql(_R, "rdir", 104, S.shock),
    f"SELECT {_R}, week_end, round(a, 5) AS a, round(b, 5) AS b, n_used, n_dates_used, in_domain FROM rf"))


def _window_search(spark, d):
    """The autoregression at the threshold of 8 per cent, as a choice of window needs no more."""
    return rounded(calibrate.window_search(_realised(spark, d).where("model = 1 and threshold = 0.08"), _RKEYS, _WINDOWS, S.shock), 5)


add("platt_window_search", _window_search, with_sql(*_REALISED, "one AS (SELECT * FROM rdir WHERE model = 1 AND threshold = 0.08)", *[cte for i, w in enumerate(_WINDOWS) for cte in (*rolling_sql(_R, "one", w, S.shock, name=f"rf{i}"), _calibrated_sql(_R, "one", f"rf{i}"))],
    " UNION ALL ".join(f"SELECT {w or 'NULL'}::INTEGER AS window_weeks, round(avg(skill), 5) AS mean_bss, count(*) AS n_cells FROM (SELECT {_R}, {_skill('c')} AS skill FROM cal_rf{i} WHERE in_domain AND c IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)" for i, w in enumerate(_WINDOWS))))
_POOLED_MAPS = [f"before AS (SELECT * FROM rdir WHERE actual IS NOT NULL AND week_end < DATE '{S.shock}')", *newton_sql(_R, "before"),
    f"calp AS (SELECT s.*, CASE WHEN a IS NOT NULL THEN 1 / (1 + exp(-greatest(least(a * ln(q / (1 - q)) + b, 30), -30))) END AS c FROM (SELECT *, greatest(least(p, 1 - 1e-4), 1e-4) AS q FROM rdir WHERE actual IS NOT NULL) s LEFT JOIN maps USING ({_R}))"]


def _both_maps(spark, d):
    rows = _realised(spark, d)
    return rounded(calibrate.compare_rolling(calibrate.pooled(rows, _RKEYS, S.shock), calibrate.rolling_apply(rows, _RKEYS, 104, S.shock), _RKEYS), 5)


add("platt_pooled_vs_rolling", _both_maps,
    with_sql(*_REALISED, *_POOLED_MAPS, *rolling_sql(_R, "rdir", 104, S.shock), _calibrated_sql(_R, "rdir", "rf"),
        f"sp AS (SELECT {_R}, {_skill('p')} AS raw, {_skill('c', 'c IS NOT NULL')} AS pooled, count(c) AS m FROM calp GROUP BY ALL HAVING count(*) >= 5)",
        f"sr AS (SELECT {_R}, {_skill('c', 'c IS NOT NULL')} AS rolled, count(c) AS m FROM cal_rf GROUP BY ALL HAVING count(*) >= 5)",
        f"SELECT {_R}, round(raw, 5) AS bss_raw, round(CASE WHEN sp.m >= 5 THEN pooled END, 5) AS bss_pooled, round(CASE WHEN sr.m >= 5 THEN rolled END, 5) AS bss_rolling FROM sp JOIN sr USING ({_R})"))


def _embargo(spark, d):
    rows = _realised(spark, d)
    out = probability.embargo_counts(rows.where("realized_date is not null"), rows.select(F.col("week_end").alias("t")), 52)
    return out.select("t", "n_used", F.col("n_dates").cast("long").alias("n_dates"))


add("rolling_platt_embargo_counts", _embargo, with_sql(*_REALISED, "r AS (SELECT week_end, realized FROM rdir WHERE actual IS NOT NULL)", "t AS (SELECT DISTINCT week_end AS t FROM r)",
    "SELECT t, count(realized) AS n_used, count(DISTINCT realized) AS n_dates FROM t LEFT JOIN r ON realized <= t AND realized >= t - 364 GROUP BY t"))

# deals --------------------------------------------------------------------------------------
DH = 13


def _deal(spark, d, constant=False):
    base, p = fact(spark, d), panel(spark, d)
    w = weekly.to_wide(p, MATURITIES)
    forecasts = regress.random_walk(base, [DH], S.test_start)
    exits = w.where("m01 is not null").select(F.date_add("week_end", 2).alias("day"), F.col("m03" if constant else "m01").alias("exit_price"))
    return deal.roll_down(forecasts, deal.realised_differences(base, DH), w, exits, 3, DH, DECAY, constant)


def _deal_sql(constant: bool) -> list[str]:
    s, c = loadings(3.0 if constant else 0.0, DECAY)[1:]
    return [FACT, WIDE, rewalk_sql((DH,)),
        f"dpool AS (SELECT lead(week_end, {DH}) OVER w AS realized, " + ", ".join(f"lead(beta{i}, {DH}) OVER w - beta{i} AS r{i}" for i in range(3)) + " FROM fact WINDOW w AS (ORDER BY week_end))",
        "ret AS (SELECT week_end, m03, ln(m03) - lag(ln(m03)) OVER (ORDER BY week_end) AS x FROM wide WHERE m03 IS NOT NULL)",
        f"vol AS (SELECT week_end, m03 AS entry_price, CASE WHEN count(x) OVER w >= 52 THEN stddev_samp(x) OVER w END * sqrt(52.0) * sqrt({DH} / 52.0) AS sigma FROM ret WINDOW w AS (ORDER BY week_end ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))",
        f"sm AS (SELECT rw.week_end, entry_price, sigma, exp(beta0 + r0 + {s!r}::DOUBLE * (beta1 + r1) + {c!r}::DOUBLE * (beta2 + r2)) / entry_price - 1 AS q FROM rw JOIN vol USING (week_end) JOIN dpool ON realized <= rw.week_end WHERE sigma IS NOT NULL)",
        "dd AS (SELECT week_end, entry_price, sigma, avg((q > sigma)::INTEGER) AS p_up, avg((q < -sigma)::INTEGER) AS p_down, stddev_pop(q) AS expected_vol, count(*) AS n_pool FROM sm GROUP BY 1, 2, 3 HAVING count(*) >= 5)",
        f"ex AS (SELECT week_end + 2 AS day, {'m03' if constant else 'm01'} AS exit_price FROM wide WHERE m01 IS NOT NULL)",
        f"""deal AS (SELECT dd.*, exit_price, CASE WHEN exit_price IS NOT NULL THEN (exit_price > entry_price * (1 + sigma))::INTEGER END AS actual_up,
          CASE WHEN exit_price IS NOT NULL THEN (exit_price < entry_price * (1 - sigma))::INTEGER END AS actual_down
          FROM dd LEFT JOIN ex ON abs(week_end + {7 * DH} - day) <= 3 QUALIFY row_number() OVER (PARTITION BY week_end ORDER BY abs(week_end + {7 * DH} - day), day DESC) = 1)""",
    ]


_DEAL = "SELECT week_end, 0 AS model, round(entry_price, 6) AS entry_price, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("sigma", "p_up", "p_down", "expected_vol", "exit_price")) + ", n_pool, actual_up, actual_down FROM deal"
add("deal_rolldown", lambda s, d: rounded(_deal(s, d)), with_sql(*_deal_sql(False), _DEAL))
add("deal_constant_maturity", lambda s, d: rounded(_deal(s, d, True)), with_sql(*_deal_sql(True), _DEAL))
add("liquidity_buffer", lambda s, d: rounded(deal.liquidity_buffer(_deal(s, d), 1000.0).select("week_end", "naive_buffer", "dynamic_short", "dynamic_long", "saving_short", "saving_long"), 3), with_sql(*_deal_sql(False),
    """SELECT week_end, round(b, 3) AS naive_buffer, round(b * p_up, 3) AS dynamic_short, round(b * p_down, 3) AS dynamic_long, round(b - b * p_up, 3) AS saving_short, round(b - b * p_down, 3) AS saving_long
    FROM (SELECT *, 1000.0::DOUBLE * entry_price * sigma AS b FROM deal)"""))
add("deal_summary", lambda s, d: rounded(deal.deal_summary(_deal(s, d))), with_sql(*_deal_sql(False),
    """SELECT 0 AS model, count(*) AS n, round(avg(p_up), 6) AS mean_p_up, round(avg(p_down), 6) AS mean_p_down, round(100.0::DOUBLE * avg((p_up > 0.5)::INTEGER), 6) AS pct_up_over_half,
    round(100.0::DOUBLE * avg((p_down > 0.5)::INTEGER), 6) AS pct_down_over_half FROM deal HAVING count(*) > 0"""))
add("volatility_errors", lambda s, d: rounded(deal.volatility_errors(_deal(s, d))), with_sql(*_deal_sql(False),
    "e AS (SELECT abs(sigma - abs(exit_price / entry_price - 1)) AS a, abs(expected_vol - abs(exit_price / entry_price - 1)) AS b FROM deal WHERE exit_price IS NOT NULL)",
    "SELECT 0 AS model, round(avg(a), 6) AS mae_naive, round(avg(b), 6) AS mae_model, round(avg((b < a)::INTEGER), 6) AS win_rate, count(*) AS n FROM e HAVING count(*) > 0"))


def _all_deals(spark, d):
    """Deals of all four models from the burn-in's end on, each from the residuals its own forecasts had by then, with the week of the h-th later row."""
    p, base = _weekly(spark, d)
    w = weekly.to_wide(p, MATURITIES)
    every = written(direct_models(spark, d, _BURN_IN).where(F.col("horizon") == DH), "deal-forecasts")
    exits = w.where("m01 is not null").select(F.date_add("week_end", 2).alias("day"), F.col("m01").alias("exit_price"))
    deals = deal.roll_down(every, regress.residual_pool(every, base), w, exits, 3, DH, DECAY)
    return deals.join(every.select("week_end", "model", F.col("t_plus_h").alias("realized_date")), ["week_end", "model"])


def _deal_rolling(spark, d):
    """Every test week's deal probabilities by the map fitted on deals, before the test period too, that were closed by then; none after the shock."""
    rows = _all_deals(spark, d).select("week_end", "model", "p_up", "p_down", "actual_up", "actual_down", "realized_date")
    long = written(probability.by_direction(rows), "deals")
    out = calibrate.rolling_apply(long, ["model", "direction"], None, S.shock, least_rows=20, least_dates=1).where(F.col("week_end") >= F.lit(S.test_start))
    p_cal = F.when(F.col("week_end") < F.lit(S.shock), F.col("p_cal")).alias("p_cal")
    return rounded(out.select("week_end", "model", "direction", "p", p_cal, "n_used", "in_domain"))


_DS, _DC = loadings(deal.remaining_maturity(3, DH), DECAY)[1:]
#: Deals of all four models: the pools, their shares beyond the volatility, and the price at the close.
_DEALS = [*_ALL, WIDE, *_deal_sql(False)[4:6], _deal_sql(False)[8],
    f"sd AS (SELECT e.week_end, e.model, e.t_plus_h, entry_price, sigma, exp(beta0 + r0 + {_DS!r}::DOUBLE * (beta1 + r1) + {_DC!r}::DOUBLE * (beta2 + r2)) / entry_price - 1 AS q FROM ev e JOIN vol USING (week_end) JOIN known k ON k.horizon = e.horizon AND k.model = e.model AND k.realized_date <= e.week_end WHERE e.horizon = {DH} AND sigma IS NOT NULL)",
    "da AS (SELECT week_end, model, t_plus_h, entry_price, sigma, avg((q > sigma)::INTEGER) AS p_up, avg((q < -sigma)::INTEGER) AS p_down, stddev_pop(q) AS expected_vol, count(*) AS n_pool FROM sd GROUP BY ALL HAVING count(*) >= 5)",
    f"""dx AS (SELECT da.*, exit_price, (exit_price > entry_price * (1 + sigma))::INTEGER AS actual_up, (exit_price < entry_price * (1 - sigma))::INTEGER AS actual_down
      FROM da LEFT JOIN ex ON abs(week_end + {7 * DH} - day) <= 3 QUALIFY row_number() OVER (PARTITION BY week_end, model ORDER BY abs(week_end + {7 * DH} - day), day DESC) = 1)"""]  # fmt: skip


def _walk_deals(spark, d):
    """The test period's deals of all four models, each from the residuals its own forecasts had by then."""
    rows = _all_deals(spark, d).where(F.col("week_end") >= F.lit(S.test_start)).drop("realized_date")
    return rounded(rows.select("week_end", "model", "entry_price", "sigma", "p_up", "p_down", "expected_vol", "exit_price", "n_pool", "actual_up", "actual_down"))


add("deal_rolldown_walkforward", _walk_deals, with_sql(*_DEALS, "SELECT week_end, model, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("entry_price", "sigma", "p_up", "p_down", "expected_vol", "exit_price")) + f", n_pool, actual_up, actual_down FROM dx WHERE week_end >= DATE '{S.test_start}'"))


def _walk_deal_scores(spark, d):
    """By model: errors of its volatility and of the trailing one, and the side it leaned to where the price broke out."""
    deals = written(_all_deals(spark, d).where(F.col("week_end") >= F.lit(S.test_start)), "deals")
    return rounded(deal.volatility_errors(deals).join(probability.directional_accuracy(deals, ["model"]), "model", "left"))


add("deal_scores_walkforward", _walk_deal_scores, with_sql(*_DEALS, f"dt AS (SELECT * FROM dx WHERE week_end >= DATE '{S.test_start}')",
    "ve AS (SELECT model, avg(a) AS mae_naive, avg(b) AS mae_model, avg((b < a)::INTEGER) AS win_rate, count(*) AS n FROM (SELECT model, abs(sigma - abs(exit_price / entry_price - 1)) AS a, abs(expected_vol - abs(exit_price / entry_price - 1)) AS b FROM dt WHERE exit_price IS NOT NULL) GROUP BY 1)",
    "ac AS (SELECT model, avg(((actual_up = 1 AND p_up > p_down) OR (actual_down = 1 AND p_down > p_up))::INTEGER) AS accuracy, count(*) AS n_breaches FROM dt WHERE actual_up = 1 OR actual_down = 1 GROUP BY 1)",
    "SELECT model, round(mae_naive, 6) AS mae_naive, round(mae_model, 6) AS mae_model, round(win_rate, 6) AS win_rate, n, round(accuracy, 6) AS accuracy, n_breaches FROM ve LEFT JOIN ac USING (model)"))
add("deal_rolling_calibration", _deal_rolling, with_sql(*_DEALS,
    """dr AS (SELECT * FROM (SELECT week_end, model, t_plus_h AS realized, unnest(['up', 'down']) AS direction, unnest([p_up, p_down]) AS p, unnest([actual_up, actual_down]) AS actual FROM dx) WHERE actual IS NOT NULL)""",
    *rolling_sql("model, direction", "dr", None, S.shock, 20, 1), _calibrated_sql("model, direction", "dr", "rf"),
    f"SELECT week_end, model, direction, round(p, 6) AS p, round(CASE WHEN week_end < DATE '{S.shock}' THEN c END, 6) AS p_cal, n_used, in_domain FROM cal_rf WHERE week_end >= DATE '{S.test_start}'"))


def _breaches(spark, d):
    w = wide(spark, d)
    exits = w.where("m01 is not null").select(F.date_add("week_end", 2).alias("day"), F.col("m01").alias("exit_price"))
    return rounded(deal.breaches(w, exits, 3, DH))


add("threshold_breaches", _breaches, with_sql(*_deal_sql(False)[:2], *_deal_sql(False)[4:6], _deal_sql(False)[8],
    f"""b AS (SELECT week_end, entry_price, exit_price, sigma AS volatility, exit_price / entry_price - 1 AS move FROM vol LEFT JOIN ex ON abs(week_end + {7 * DH} - day) <= 3
    WHERE sigma IS NOT NULL QUALIFY row_number() OVER (PARTITION BY week_end ORDER BY abs(week_end + {7 * DH} - day), day DESC) = 1)""",
    "SELECT week_end, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("entry_price", "exit_price", "volatility", "move")) + " FROM b WHERE abs(move) > volatility"))


def _episodes(spark, d):
    import datetime as dt

    rows = deal.in_episodes(wide(spark, d).select("week_end", "m01"), [("early", dt.date(1996, 1, 1), dt.date(1996, 6, 30)), ("late", dt.date(2000, 3, 1), dt.date(2000, 9, 30))])
    return rounded(rows.groupBy("episode").agg(F.count(F.lit(1)).alias("weeks"), F.avg("m01").alias("mean")))


add("episode_windows", _episodes, with_sql(PANEL, WIDE, "ep(episode, a, b) AS (VALUES ('early', DATE '1996-01-01', DATE '1996-06-30'), ('late', DATE '2000-03-01', DATE '2000-09-30'))",
    "SELECT episode, count(*) AS weeks, round(avg(m01), 6) AS mean FROM wide JOIN ep ON week_end BETWEEN a AND b GROUP BY 1"))
