"""Curve fits, grids, regimes, backtests and their metrics."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from termforge.config import written
from termforge.functions.columns import effective_size, half_life, loadings
from termforge.operators import curve, gram, hypothesis, probability, regress, weekly
from termforge.plans.base import (
    DECAY, FACT, MACRO, MATURITIES, ORDERS, PANEL, WIDE, S, fact, fit_sql, load_sql, macro, macro_wide, orders_weekly, panel, rewalk_sql, rounded, table, wide, with_sql,
)
from termforge.plans.testsql import GRANGER_COLUMNS, eliminated, diagnostics_sql, granger_sql, iterated_sql, lag_robustness_sql, lag_selection_sql, projection_sql, screening_sql, stationarity_sql

Q, SQL = {}, {}
#: 200 decays; settings for finer grids are parameters of the operators.
GRID = tuple(round(0.6 + 0.05 * i, 2) for i in range(200))
PAIR = (1.5, 4.5)


def add(name: str, query, sql: str | None = None) -> None:
    Q[name] = query
    if sql:
        SQL[name] = sql


def _round_sql(cols, digits=6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


add("ns_fit_fixed_lambda", lambda s, d: rounded(fact(s, d).select("week_end", "beta0", "beta1", "beta2", "rmse")), with_sql(FACT, f"SELECT week_end, {_round_sql(['beta0', 'beta1', 'beta2', 'rmse'])} FROM fact"))


def _holes(spark, d):
    p = weekly.curve_panel(table(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_shipdate", "l_linenumber", "l_extendedprice", "l_quantity", MATURITIES)
    return rounded(curve.factors(p, MATURITIES, DECAY).select("week_end", "n_maturities", "beta0", "beta1", "beta2", "rmse"))


add("ns_fit_missing_maturities", _holes, with_sql(PANEL.replace("WHERE", "WHERE l_returnflag = 'R' AND"), load_sql([DECAY]), fit_sql(),
    f"SELECT week_end, n_maturities, {_round_sql(['beta0', 'beta1', 'beta2', 'rmse'])} FROM fits"))

add("lambda_grid_rmse", lambda s, d: rounded(curve.grid_rmse(panel(s, d), MATURITIES, GRID)), with_sql(PANEL, load_sql(GRID), fit_sql(),
    "SELECT decay, round(avg(rmse), 6) AS mean_rmse, count(*) AS n_weeks FROM fits WHERE beta0 IS NOT NULL GROUP BY 1"))
add("lambda_best", lambda s, d: rounded(curve.best_decay(curve.grid_rmse(panel(s, d), MATURITIES, GRID))), with_sql(PANEL, load_sql(GRID), fit_sql(),
    "g AS (SELECT decay, avg(rmse) AS m FROM fits WHERE beta0 IS NOT NULL GROUP BY 1)", "SELECT decay, round(m, 6) AS mean_rmse FROM g ORDER BY m, decay LIMIT 1"))
add("lambda_grid_agreement", lambda s, d: rounded(curve.grid_agreement(panel(s, d), MATURITIES, GRID)), with_sql(PANEL, WIDE, load_sql(GRID), fit_sql(),
    """SELECT decay, round(100.0::DOUBLE * avg((sign(beta1) = sign(m01 - m06))::INTEGER), 6) AS agreement_pct, count(*) AS n_weeks
    FROM fits JOIN wide USING (week_end) WHERE beta1 IS NOT NULL AND m01 <> m06 GROUP BY 1"""))


def _chained(spark, d):
    """Both measures of each decay side by side."""
    p = panel(spark, d)
    left = curve.grid_rmse(p, MATURITIES, GRID).withColumnRenamed("n_weeks", "n_fitted")
    return left.join(curve.grid_agreement(p, MATURITIES, GRID), "decay")


_CHAIN = [PANEL, WIDE, load_sql(GRID), fit_sql(), "r AS (SELECT decay, avg(rmse) AS mean_rmse, count(*) AS n_fitted FROM fits WHERE beta0 IS NOT NULL GROUP BY 1)",
    """ag AS (SELECT decay, 100.0::DOUBLE * avg((sign(beta1) = sign(m01 - m06))::INTEGER) AS agreement_pct, count(*) AS n_weeks
    FROM fits JOIN wide USING (week_end) WHERE beta1 IS NOT NULL AND m01 <> m06 GROUP BY 1)"""]  # fmt: skip
_BOTH = f"SELECT decay, {_round_sql(['mean_rmse', 'agreement_pct'])}, n_fitted, n_weeks FROM r JOIN ag USING (decay)"
add("lambda_grid_chained", lambda s, d: rounded(_chained(s, d)), with_sql(*_CHAIN, _BOTH))
add("decay_choice", lambda s, d: rounded(curve.chosen_decay(_chained(s, d))), with_sql(*_CHAIN, "both_grids AS (SELECT * FROM r JOIN ag USING (decay))",
    "ends AS (SELECT min(decay) AS lo, max(decay) AS hi, max(mean_rmse) - min(mean_rmse) AS spread, arg_min(decay, (mean_rmse, decay)) AS by_rmse, arg_min(decay, (-agreement_pct, decay)) AS by_agreement FROM both_grids)",
    """SELECT CASE WHEN least(abs(by_rmse - lo), abs(by_rmse - hi)) <= 1e-6 OR spread < 1e-4 THEN by_agreement ELSE by_rmse END AS decay,
      CASE WHEN least(abs(by_rmse - lo), abs(by_rmse - hi)) <= 1e-6 OR spread < 1e-4 THEN 'agreement' ELSE 'rmse' END AS chosen_by, by_rmse, by_agreement, round(spread, 6) AS spread FROM ends"""))
add("lambda_grid_first_five", lambda s, d: rounded(weekly.first_rows(_chained(s, d), [F.col("mean_rmse"), F.col("decay")], 5)), with_sql(*_CHAIN,
    "o AS (SELECT *, row_number() OVER (ORDER BY mean_rmse, decay)::INTEGER AS place FROM r JOIN ag USING (decay))", f"SELECT decay, {_round_sql(['mean_rmse', 'agreement_pct'])}, n_fitted, n_weeks, place FROM o WHERE place <= 5"))


def _wide_sql(decays, log: bool, name: str) -> str:
    """CTE of a constant-matrix fit: week_end, rmse, r2, aic in price units."""
    x = curve.fixed_design(MATURITIES, decays)
    hat = x @ np.linalg.pinv(x)
    y = [f"ln(m{m:02d})" if log else f"m{m:02d}" for m in MATURITIES]
    fit = ["(" + " + ".join(f"({float(h)!r})*{v}" for h, v in zip(row, y)) + ")" for row in hat]
    fit = [f"exp{f}" if log else f for f in fit]
    rss = " + ".join(f"power(m{m:02d} - {f}, 2)" for m, f in zip(MATURITIES, fit))
    mean = "(" + " + ".join(f"m{m:02d}" for m in MATURITIES) + ") / 6"
    tss = " + ".join(f"power(m{m:02d} - {mean}, 2)" for m in MATURITIES)
    k = x.shape[1] + len(decays)
    full = " AND ".join(f"m{m:02d} IS NOT NULL" for m in MATURITIES)
    return f"""{name} AS (SELECT week_end, sqrt(rss / 6) AS rmse, 1 - rss / nullif(tss, 0) AS r2, {2 * k} + 6 * ln(rss / 6) AS aic
      FROM (SELECT week_end, {rss} AS rss, {tss} AS tss FROM wide WHERE {full}))"""


_METRICS = """SELECT '{n}' AS model, count(*) AS n_weeks, avg(rmse) AS mean_rmse, median(rmse) AS median_rmse, max(rmse) AS max_rmse, avg(r2) AS mean_r2, avg(aic) AS mean_aic,
  100.0::DOUBLE * avg((rmse > (SELECT quantile_cont(rmse, 0.95) FROM {n}))::INTEGER) AS pct_flagged FROM {n}"""

add("svensson_fit_metrics", lambda s, d: rounded(curve.fit_metrics(curve.fit_wide(wide(s, d), MATURITIES, PAIR)).drop("worst_week"), 4), with_sql(PANEL, WIDE, _wide_sql(PAIR, True, "sv_log"),
    f"SELECT n_weeks, {_round_sql(['mean_rmse', 'median_rmse', 'max_rmse', 'mean_r2', 'mean_aic', 'pct_flagged'], 4)} FROM ({_METRICS.format(n='sv_log')})"))

_MODELS = {"ns_raw": ((DECAY,), False), "ns_log": ((DECAY,), True), "sv_raw": (PAIR, False), "sv_log": (PAIR, True)}


def _compare(spark, d):
    w = wide(spark, d)
    fits = {n: curve.fit_wide(w, MATURITIES, decays, log) for n, (decays, log) in _MODELS.items()}
    return rounded(curve.compare_fits(fits, "ns_raw"), 4)


add("fit_model_comparison", _compare, with_sql(PANEL, WIDE, *[_wide_sql(dc, lg, n) for n, (dc, lg) in _MODELS.items()],
    "m AS (" + " UNION ALL ".join(_METRICS.format(n=n) for n in _MODELS) + ")",
    f"""SELECT model, n_weeks, {_round_sql(['mean_rmse', 'median_rmse', 'max_rmse', 'mean_r2', 'mean_aic', 'pct_flagged'], 4)},
    round(100.0::DOUBLE * ((SELECT mean_rmse FROM m WHERE model = 'ns_raw') - mean_rmse) / (SELECT mean_rmse FROM m WHERE model = 'ns_raw'), 4) AS improvement_pct FROM m"""))

_PAIRS = curve.two_decay_grid(tuple(1.0 + 0.5 * i for i in range(10)), tuple(1.5 + 0.75 * i for i in range(10)))


def _pairs_sql() -> str:
    y = [f"ln(m{m:02d})" for m in MATURITIES]
    full = " AND ".join(f"m{m:02d} IS NOT NULL" for m in MATURITIES)
    parts = []
    for a, b in _PAIRS:
        x = curve.fixed_design(MATURITIES, (a, b))
        m = np.eye(6) - x @ np.linalg.pinv(x)
        rss = " + ".join("power(" + " + ".join(f"({float(v)!r})*{c}" for v, c in zip(row, y)) + ", 2)" for row in m)
        parts.append(f"SELECT {a}::DOUBLE AS decay1, {b}::DOUBLE AS decay2, round(avg(sqrt(({rss}) / 6)), 6) AS mean_rmse FROM wide WHERE {full}")
    return with_sql(PANEL, WIDE, " UNION ALL ".join(parts))


add("svensson_grid_rmse", lambda s, d: rounded(curve.search_two_decays(wide(s, d), MATURITIES, _PAIRS)), _pairs_sql())

_Z = f"""base AS (SELECT weekofyear(week_end) AS wk, avg(beta1) AS mu, stddev_samp(beta1) AS sd FROM fact WHERE week_end <= DATE '{S.train_end}' GROUP BY 1),
reg AS (SELECT week_end, weekofyear(week_end)::INTEGER AS week_number, beta1, CASE WHEN mu IS NULL THEN NULL WHEN sd > 0 THEN (beta1 - mu) / sd ELSE 0 END AS beta1_zscore,
  CASE WHEN beta1 > 0 THEN 'backwardation' WHEN beta1 < 0 THEN 'contango' ELSE 'neutral' END AS regime FROM fact LEFT JOIN base ON weekofyear(week_end) = wk)"""
add("seasonal_zscore_regime", lambda s, d: rounded(curve.regimes(fact(s, d), S.train_end)), with_sql(FACT, _Z, f"SELECT week_end, week_number, {_round_sql(['beta1', 'beta1_zscore'])}, regime FROM reg"))


def regime_counts(spark, d):
    out = curve.regimes(fact(spark, d), S.train_end).groupBy("regime").agg(F.count(F.lit(1)).alias("weeks"), F.avg("beta1_zscore").alias("mean_z"))
    return rounded(out)


add("regime_counts", regime_counts, with_sql(FACT, _Z, "SELECT regime, count(*) AS weeks, round(avg(beta1_zscore), 6) AS mean_z FROM reg GROUP BY 1"))

add("fit_gate", lambda s, d: rounded(curve.fit_gate(curve.fit_wide(wide(s, d), MATURITIES, (DECAY,)), panel(s, d))), with_sql(PANEL, WIDE, _wide_sql((DECAY,), True, "f"),
    "lv AS (SELECT week_end, avg(price) AS p FROM panel GROUP BY 1)", "r AS (SELECT rmse / p AS r FROM f JOIN lv USING (week_end))",
    """SELECT round(avg(r), 6) AS mean_relative_rmse, round(avg((r > 0.05)::INTEGER), 6) AS share_over, avg(r) < 0.02 AND avg((r > 0.05)::INTEGER) <= 0.05 AS passed FROM r"""))
add("representative_weeks", lambda s, d: curve.representative_weeks(fact(s, d)), with_sql(FACT, """SELECT 'steepest' AS kind, arg_max(week_end, (beta1, week_end)) AS week_end FROM fact
UNION ALL SELECT 'most_inverted', arg_min(week_end, (beta1, week_end)) FROM fact UNION ALL SELECT 'flattest', arg_min(week_end, (abs(beta1), week_end)) FROM fact"""))
add("rebuilt_curve", lambda s, d: rounded(curve.rebuild(fact(s, d), MATURITIES, DECAY)), with_sql(FACT, "SELECT week_end, maturity, round(exp(beta0 + s*beta1 + c*beta2), 6) AS fitted FROM fact CROSS JOIN loads"))
add("spread_regime_series", lambda s, d: rounded(wide(s, d).select("week_end", (F.col("m01") - F.col("m06")).alias("spread"), F.signum(F.col("m01") - F.col("m06")).alias("side"))),
    with_sql(PANEL, WIDE, "SELECT week_end, round(m01 - m06, 6) AS spread, sign(m01 - m06)::DOUBLE AS side FROM wide"))

# backtests ----------------------------------------------------------------------------------
HORIZONS = S.horizons
_RW = [FACT, rewalk_sql(HORIZONS)]
_ERR = """err AS (SELECT rw.week_end, rw.horizon, l.maturity, exp(beta0 + l.s*beta1 + l.c*beta2) AS forecast, a.price AS actual, k.price AS current_price,
  exp(beta0 + l.s*beta1 + l.c*beta2) - a.price AS error FROM rw CROSS JOIN loads l JOIN panel a ON a.week_end = rw.t_plus_h AND a.maturity = l.maturity
  LEFT JOIN panel k ON k.week_end = rw.week_end AND k.maturity = l.maturity)"""


def _rw(spark, d):
    return regress.random_walk(fact(spark, d), HORIZONS, S.test_start)


def rw_errors(spark, d):
    return regress.forecast_errors(_rw(spark, d), panel(spark, d), MATURITIES, DECAY)


add("rw_backtest_metrics", lambda s, d: rounded(regress.metrics(rw_errors(s, d), ["horizon", "maturity"]).drop("hit_rate")), with_sql(*_RW, _ERR,
    "SELECT horizon, maturity, round(sqrt(avg(error*error)), 6) AS rmse, round(avg(abs(error)), 6) AS mae, count(*) AS n FROM err GROUP BY 1, 2"))


add("attach_target_week", lambda s, d: weekly.attach(rw_errors(s, d).select("week_end", "horizon", "maturity"), _rw(s, d), ["week_end", "horizon"], ["t_plus_h"]), with_sql(*_RW, _ERR,
    "SELECT err.week_end, err.horizon, err.maturity, k.t_plus_h FROM err LEFT JOIN (SELECT DISTINCT week_end, horizon, t_plus_h FROM rw) k USING (week_end, horizon)"))


def _drift(spark, d):
    w = Window.orderBy("week_end")
    base = fact(spark, d)
    drifted = base.select("week_end", *[(F.col(f"beta{i}") + (F.col(f"beta{i}") - F.lag(f"beta{i}").over(w)) * 0.5).alias(f"beta{i}") for i in range(3)])
    f = regress.random_walk(drifted, HORIZONS, S.test_start).withColumn("model", F.lit(1))
    return rounded(regress.metrics(regress.forecast_errors(f, panel(spark, d), MATURITIES, DECAY), ["horizon"]))


_DRIFT = ["fact0 AS (SELECT * FROM fact)", "drift AS (SELECT week_end, " + ", ".join(f"beta{i} + (beta{i} - lag(beta{i}) OVER (ORDER BY week_end)) * 0.5 AS beta{i}" for i in range(3)) + " FROM fact0)"]
add("hit_rate_by_horizon", _drift, with_sql(FACT, *_DRIFT, rewalk_sql(HORIZONS).replace("FROM fact", "FROM drift WHERE beta0 IS NOT NULL"), _ERR,
    """SELECT horizon, round(sqrt(avg(error*error)), 6) AS rmse, round(avg(abs(error)), 6) AS mae,
    round(avg((sign(actual - current_price) = sign(forecast - current_price))::INTEGER) FILTER (actual <> current_price), 6) AS hit_rate, count(*) AS n FROM err GROUP BY 1"""))
add("subperiod_metrics_grouping_sets", lambda s, d: rounded(regress.subperiod_metrics(rw_errors(s, d), S.shock)), with_sql(*_RW, _ERR,
    f"""e2 AS (SELECT 0 AS model, *, CASE WHEN week_end >= DATE '{S.shock}' THEN 'shock' ELSE 'stable' END AS period FROM err)""",
    """SELECT model, horizon, coalesce(period, 'full') AS period, round(sqrt(avg(error*error)), 6) AS rmse, round(avg(abs(error)), 6) AS mae, count(*) AS n
    FROM e2 GROUP BY GROUPING SETS ((model, horizon, period), (model, horizon))"""))

_POOL = "pool AS (SELECT rw.horizon, rw.week_end AS origin, rw.t_plus_h AS realized_date, " + ", ".join(f"f.beta{i} - rw.beta{i} AS r{i}" for i in range(3)) + " FROM rw JOIN fact f ON f.week_end = rw.t_plus_h)"
_BASIC = rewalk_sql(S.horizons).replace(f"WHERE week_end >= DATE '{S.test_start}'", "WHERE week_end >= DATE '1996-01-01'")


def _pool(spark, d, horizons=S.horizons, first="1996-01-01"):
    base = fact(spark, d)
    return regress.residual_pool(regress.random_walk(base, horizons, first), base)


add("rw_residual_pool", lambda s, d: rounded(_pool(s, d)), with_sql(FACT, _BASIC, _POOL, "SELECT horizon, 0 AS model, origin, realized_date, round(r0, 6) AS r0, round(r1, 6) AS r1, round(r2, 6) AS r2 FROM pool"))
add("residual_covariance", lambda s, d: rounded(regress.residual_covariance(_pool(s, d))), with_sql(FACT, _BASIC, _POOL, "SELECT horizon, 0 AS model, count(*) AS n, " + ", ".join(
    f"round(covar_samp(r{i}, r{j}), 6) AS s{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM pool GROUP BY 1"))
add("ew_effective_size", lambda s, d: rounded(probability.kish(_pool(s, d).withColumn("w", F.pow(F.lit(0.997), F.datediff(F.lit("2001-08-03").cast("date"), "realized_date") / 7.0)), ["horizon"], "w"), 4),
    with_sql(FACT, _BASIC, _POOL, "SELECT horizon, round(sum(w) * sum(w) / sum(w*w), 4) AS n_eff FROM (SELECT horizon, power(0.997, (DATE '2001-08-03' - realized_date) / 7.0::DOUBLE) AS w FROM pool) GROUP BY 1"))


def joined(spark, d):
    return fact(spark, d).select("week_end", "beta0", "beta1", "beta2").join(macro_wide(spark, d), "week_end", "left")


MACROS = ("x1", "x2", "x3")
_MACROS = """macros AS (SELECT week_end, """ + ", ".join(f"max(value) FILTER (series LIKE '{i}%') AS x{i}" for i in (1, 2, 3)) + """ FROM macro GROUP BY 1)"""
_METRIC_SQL = """SELECT {keys}, round(sqrt(avg(error*error)), 5) AS rmse, round(avg(abs(error)), 5) AS mae,
  round(avg((sign(actual - current_price) = sign(forecast - current_price))::INTEGER) FILTER (actual <> current_price), 5) AS hit_rate, count(*) AS n FROM err GROUP BY ALL"""


def direct_sql(model: int, decay: float | None = None, first=S.test_start) -> list[str]:
    """CTEs of a direct regression by the normal equations: ..., pairs, fit{model}, dir{model}, err{model}, err."""
    n, xs = model, [0, 1, 2] + ([3, 4, 5] if model > 1 else [])
    source = "SELECT week_end, beta0 AS v0, beta1 AS v1, beta2 AS v2" + (", x1 AS v3, x2 AS v4, x3 AS v5 FROM fact JOIN macros USING (week_end)" if model > 1 else " FROM fact")
    complete = " AND ".join(f"v{i} IS NOT NULL" for i in xs)
    means = f"means{n} AS (SELECT " + ", ".join(f"avg(v{i}) AS mean{i}" for i in xs) + f" FROM rows{n})"
    pairs = " UNION ALL ".join(
        f"SELECT week_end, {h} AS horizon, place, lead(week_end, {h}) OVER w AS t_plus_h, " + ", ".join([f"v{i} - mean{i} AS z{i + 1}" for i in xs] + [f"lead(v{i}, {h}) OVER w - mean{i} AS z{len(xs) + 1 + i}" for i in range(3)])
        + f" FROM (SELECT *, row_number() OVER (ORDER BY week_end) AS place FROM rows{n}), means{n} WINDOW w AS (ORDER BY week_end)" for h in HORIZONS)
    z = ["1.0::DOUBLE", *[f"z{i}" for i in range(1, len(xs) + 4)]]
    k, size = len(xs) + 1, len(xs) + 4
    weight = f"power({1.0 / decay!r}::DOUBLE, place) * " if decay else ""
    at = "(PARTITION BY horizon ORDER BY week_end ROWS UNBOUNDED PRECEDING)"
    step = f"SELECT horizon, t_plus_h, count(*) OVER w AS n_fit, " + ", ".join(f"sum({weight}{z[i]} * {z[j]}) OVER w AS g{i}_{j}" for i in range(size) for j in range(i, size)) + f" FROM pairs{n} WHERE t_plus_h IS NOT NULL WINDOW w AS {at}"
    for p in range(k):
        kept = [f"g{i}_{j}" for i in range(p + 1) for j in range(i, size)]
        step = "SELECT horizon, t_plus_h, n_fit, " + ", ".join(kept + [f"g{i}_{j} - g{p}_{i} * g{p}_{j} / nullif(g{p}_{p}, 0) AS g{i}_{j}" for i in range(p + 1, size) for j in range(i, size)]) + f" FROM ({step})"
    for y in range(3):
        for p in reversed(range(k)):
            step = f"SELECT *, (g{p}_{k + y}" + "".join(f" - g{p}_{q} * c{y}_{q}" for q in range(p + 1, k)) + f") / nullif(g{p}_{p}, 0) AS c{y}_{p} FROM ({step})"
    fit = f"fit{n} AS (SELECT t_plus_h AS week_end, horizon, n_fit, " + ", ".join([f"c{y}_{p}" for y in range(3) for p in range(k)] + [f"g{k + y}_{k + y} AS rss{y}" for y in range(3)]) + f" FROM ({step}))"
    hats = ", ".join(f"CASE WHEN n_fit >= {len(xs) + 3} THEN mean{y} + c{y}_0" + "".join(f" + c{y}_{p + 1} * (v{x} - mean{x})" for p, x in enumerate(xs)) + f" ELSE v{y} END AS b{y}" for y in range(3))
    made = f"""dir{n} AS (SELECT week_end, horizon, {n} AS model, t_plus_h, n_fit, {hats} FROM (SELECT p.week_end, p.horizon, p.t_plus_h, r.* EXCLUDE week_end, f.* EXCLUDE (week_end, horizon) FROM pairs{n} p JOIN rows{n} r ON r.week_end = p.week_end
      LEFT JOIN fit{n} f ON f.week_end = p.week_end AND f.horizon = p.horizon), means{n} WHERE week_end >= DATE '{first}')"""
    err = f"""err{n} AS (SELECT {n} AS model, d.week_end, d.horizon, l.maturity, exp(b0 + l.s*b1 + l.c*b2) AS forecast, a.price AS actual, k.price AS current_price, exp(b0 + l.s*b1 + l.c*b2) - a.price AS error
      FROM dir{n} d CROSS JOIN loads l JOIN panel a ON a.week_end = d.t_plus_h AND a.maturity = l.maturity LEFT JOIN panel k ON k.week_end = d.week_end AND k.maturity = l.maturity)"""
    base = [FACT, MACRO, _MACROS] if model > 1 else [FACT]
    return [*base, f"rows{n} AS (SELECT * FROM ({source}) WHERE {complete})", means, f"pairs{n} AS ({pairs})", fit, made, err] + ([f"err AS (SELECT * FROM err{n})"] if model == 1 else [])


def _direct(spark, d, model, first=S.test_start, decay=None):
    return gram.direct_forecasts(joined(spark, d), HORIZONS, first, model, MACROS if model > 1 else (), decay)


def direct_models(spark, d, first=S.test_start):
    """The forecasts of all four models."""
    names = ["week_end", "horizon", "model", "beta0_hat", "beta1_hat", "beta2_hat", "t_plus_h"]
    return reduce(DataFrame.unionByName, [regress.random_walk(fact(spark, d), HORIZONS, first).select(names), *[_direct(spark, d, m, first, S.ew_decay if m == 3 else None).select(names) for m in (1, 2, 3)]])


def _errors(spark, d, *models):
    f = reduce(DataFrame.unionByName, [_direct(spark, d, m, decay=S.ew_decay if m == 3 else None).drop("coef", "rss", "n_fit") for m in models])
    return regress.forecast_errors(f, panel(spark, d), MATURITIES, DECAY)


add("ar_direct_expanding", lambda s, d: rounded(regress.metrics(_errors(s, d, 1), ["model", "horizon", "maturity"]), 5), with_sql(*direct_sql(1), _METRIC_SQL.format(keys="model, horizon, maturity")))
add("lp_macro_ew", lambda s, d: rounded(regress.metrics(_errors(s, d, 2, 3), ["model", "horizon"]), 5), with_sql(*direct_sql(2), *direct_sql(3, S.ew_decay)[3:],
    "err AS (SELECT * FROM err2 UNION ALL SELECT * FROM err3)", _METRIC_SQL.format(keys="model, horizon")))


def _last_coefficients(spark, d):
    f = _direct(spark, d, 1).where("coef is not null")
    last = f.groupBy("horizon").agg(F.max_by(F.struct("week_end", "n_fit", "coef", "rss"), "week_end").alias("x"))
    rows = last.select("horizon", "x.*").select("horizon", "week_end", F.col("n_fit").cast("long").alias("n_fit"), "rss", F.posexplode("coef").alias("factor", "c"))
    return rounded(rows.select("horizon", "week_end", "n_fit", "factor", *[F.col("c")[i].alias(n) for i, n in enumerate(("intercept", "slope0", "slope1", "slope2"))], F.sqrt(F.get("rss", F.col("factor")) / F.col("n_fit")).alias("residual_rmse")), 5)


add("ar_direct_coefficients", _last_coefficients, with_sql(*direct_sql(1)[:-2], " UNION ALL ".join(
    f"SELECT horizon, week_end, n_fit, {y} AS factor, round(mean{y} + c{y}_0 - c{y}_1 * mean0 - c{y}_2 * mean1 - c{y}_3 * mean2, 5) AS intercept, round(c{y}_1, 5) AS slope0, round(c{y}_2, 5) AS slope1, round(c{y}_3, 5) AS slope2, "
    f"round(sqrt(rss{y} / n_fit), 5) AS residual_rmse FROM fit1, means1 WHERE n_fit >= 6 QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY week_end DESC) = 1" for y in range(3))))


def _decay_search(spark, d):
    # Fifteen fits read these weekly tables, and the daily rows once.
    rows, p = written(joined(spark, d), "factors"), written(panel(spark, d), "panel")
    parts = []
    for decay in S.ew_grid:
        f = gram.direct_forecasts(rows, [4], S.test_start, 3, MACROS, decay)
        m = regress.metrics(regress.forecast_errors(f, p, [3], DECAY), ["model", "horizon"])
        parts.append(m.select(F.lit(float(decay)).alias("decay"), "rmse", "mae", "n", F.lit(effective_size(decay)).alias("ess"), F.lit(half_life(decay)).alias("half_life_weeks")))
    return rounded(reduce(DataFrame.unionByName, parts))


def _decay_sql() -> str:
    """The weighted fits of every decay, over the same pairs."""
    first, *rest = direct_sql(3, S.ew_grid[0])[3:], *[direct_sql(3, decay)[-3:] for decay in S.ew_grid[1:]]
    shared, fits = first[:-3], [first[-3:], *rest]
    steps = [re.sub(r"\b(fit|dir|err)3\b", rf"\g<1>3_{i}", cte) for i, three in enumerate(fits) for cte in three]
    shown = " UNION ALL ".join(
        f"SELECT {decay}::DOUBLE AS decay, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(abs(error)), 6) AS mae, count(*) AS n, round('{effective_size(decay)!r}'::DOUBLE, 6) AS ess, round('{half_life(decay)!r}'::DOUBLE, 6) AS half_life_weeks FROM err3_{i} WHERE horizon = 4 AND maturity = 3"
        for i, decay in enumerate(S.ew_grid))
    return with_sql(*direct_sql(2)[:3], *shared, *steps, shown)


add("ew_decay_search", _decay_search, _decay_sql())


def _stability(spark, d):
    f = reduce(DataFrame.unionByName, [_direct(spark, d, m, "1990-01-01", S.ew_decay if m == 3 else None) for m in (1, 2, 3)])
    return gram.stability(f)


def stability_sql(model: int) -> list[str]:
    """CTEs after direct_sql: changes of all coefficients, up to st{model}: horizon, model, n_changes, terminal, stable_from."""
    n, xs = model, range(3 if model == 1 else 6)
    k = len(xs) + 1
    values = [f"c{y}_{p} AS k{k * y + p}" for y in range(3) for p in range(1, k)] + [f"mean{y} + c{y}_0" + "".join(f" - c{y}_{x + 1} * mean{x}" for x in xs) + f" AS k{k * y}" for y in range(3)]
    change = " + ".join(f"power(k{i} - lag(k{i}) OVER w, 2)" for i in range(3 * k))
    return [
        f"f{n} AS (SELECT horizon, week_end, n_fit, {', '.join(values)} FROM fit{n}, means{n} WHERE n_fit >= {len(xs) + 3})",
        f"ch{n} AS (SELECT *, sqrt({change}) AS change FROM f{n} WINDOW w AS (PARTITION BY horizon ORDER BY week_end))",
        f"""sm{n} AS (SELECT *, CASE WHEN count(change) OVER r = 26 THEN avg(change) OVER r END AS smooth, count(change) OVER (PARTITION BY horizon) AS n_changes, row_number() OVER (PARTITION BY horizon ORDER BY week_end DESC) AS age
          FROM ch{n} WINDOW r AS (PARTITION BY horizon ORDER BY week_end ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))""",
        f"ah{n} AS (SELECT *, max(smooth) OVER (PARTITION BY horizon ORDER BY week_end ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM sm{n} WHERE change IS NOT NULL)",
        f"tm{n} AS (SELECT horizon, median(change) AS terminal FROM ah{n} WHERE age <= floor(n_changes * 0.2) GROUP BY 1)",
        f"""st{n} AS (SELECT ah{n}.horizon, {n} AS model, max(n_changes) AS n_changes, round(max(terminal), 5) AS terminal, min(week_end) FILTER (smooth IS NOT NULL AND ahead <= 1.5 * terminal AND n_changes >= 52) AS stable_from
          FROM ah{n} LEFT JOIN tm{n} USING (horizon) GROUP BY 1)""",
    ]


_FITS = {1: direct_sql(1)[:-3], 2: direct_sql(2)[:-2], 3: direct_sql(3, S.ew_decay)[3:-2]}
add("coefficient_stability", lambda s, d: rounded(gram.stabilisation_date(_stability(s, d)), 5), with_sql(
    *_FITS[1], *_FITS[2][1:], *_FITS[3], *[cte for m in (1, 2, 3) for cte in stability_sql(m)], " UNION ALL ".join(f"SELECT * FROM st{m}" for m in (1, 2, 3))))
add("ar_direct_stability", lambda s, d: rounded(gram.stabilisation_date(gram.stability(_direct(s, d, 1, "1990-01-01"))), 5), with_sql(*_FITS[1], *stability_sql(1), "SELECT * FROM st1"))


_EXP = ", ".join(f"CASE WHEN count(*) OVER w >= 5 THEN covar_samp(r{i}, r{j}) OVER w ELSE {1e-4 if i == j else 0.0} END AS s{i}{j}" for i in range(3) for j in range(i, 3))
_EXPANDING = f"ecov AS (SELECT horizon, 0 AS model, realized_date AS week_end, count(*) OVER w AS n, {_EXP} FROM pool WINDOW w AS (PARTITION BY horizon ORDER BY realized_date, origin ROWS UNBOUNDED PRECEDING))"
_SIX = [f"s{i}{j}" for i in range(3) for j in range(i, 3)]
add("expanding_covariance", lambda s, d: rounded(regress.expanding_covariance(_pool(s, d))), with_sql(FACT, _BASIC, _POOL, _EXPANDING, f"SELECT horizon, model, week_end, n, {_round_sql(_SIX)} FROM ecov"))


def _default(spark, d):
    weeks = fact(spark, d).select("week_end", F.explode(F.array(*[F.lit(h) for h in S.horizons])).alias("horizon"), F.lit(0).alias("model"))
    return rounded(regress.with_default(weeks, regress.expanding_covariance(_pool(spark, d)).drop("n"), ["horizon", "model", "week_end"], {c: 1e-4 if c[1] == c[2] else 0.0 for c in _SIX}))


add("covariance_with_default", _default, with_sql(FACT, _BASIC, _POOL, _EXPANDING, "SELECT f.week_end, h.horizon, 0 AS model, " + ", ".join(
    f"round(coalesce({c}, {1e-4 if c[1] == c[2] else 0.0}), 6) AS {c}" for c in _SIX) + f" FROM fact f CROSS JOIN (VALUES {', '.join(f'({h})' for h in S.horizons)}) h(horizon) LEFT JOIN ecov e ON e.week_end = f.week_end AND e.horizon = h.horizon"))
add("lag_robustness", lambda s, d: rounded(hypothesis.lag_robustness(written(fact(s, d), "factors"), ["beta0", "beta1", "beta2"], difference_first=True), 5), with_sql(FACT,
    "moved AS (SELECT * FROM (SELECT week_end, beta0 - lag(beta0) OVER (ORDER BY week_end) AS beta0, beta1, beta2 FROM fact) WHERE beta0 IS NOT NULL)", *lag_robustness_sql("moved", ["beta0", "beta1", "beta2"], 8),
    f"SELECT p::INTEGER AS p, {_round_sql(['aic', 'bic', 'min_p'], 5)}, n_failures, worst_series FROM robust"))


def _log_tails(spark, d):
    """Ljung-Box statistics, over ten lags, of every model's residuals, with the decimal logarithm of their tail, which no double underflows."""
    base = written(fact(spark, d), "factors")
    pool = regress.residual_pool(written(direct_models(spark, d, "1996-01-01"), "forecasts"), base)
    long = pool.unpivot(["model", "horizon", "origin"], ["r0", "r1", "r2"], "factor", "value")
    return rounded(hypothesis.ljung_box_tails(long, ["model", "horizon", "factor"], "origin", "value", 10), 4)


_EVERY = [*direct_sql(1, first="1996-01-01")[:-1], *direct_sql(2, first="1996-01-01")[1:], *direct_sql(3, S.ew_decay, first="1996-01-01")[3:]]
_EVERY.insert(1, _BASIC)
_LB_SUMS = ", ".join(f"sum(e * lag{k}) AS a{k}" for k in range(1, 11))
_LB_LAGS = ", ".join(f"lag(e, {k}) OVER w AS lag{k}" for k in range(1, 11))
add("ljung_box_log_tails", _log_tails, with_sql(*_EVERY,
    "ev AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT week_end, horizon, {m} AS model, {', '.join(f'b{i} AS beta{i}' for i in range(3))}, t_plus_h FROM dir{m}" for m in (1, 2, 3)) + " UNION ALL SELECT week_end, horizon, 0, beta0, beta1, beta2, t_plus_h FROM rw))",
    "res AS (SELECT model, horizon, ev.week_end AS origin, unnest(['r0', 'r1', 'r2']) AS factor, unnest([f.beta0 - ev.beta0, f.beta1 - ev.beta1, f.beta2 - ev.beta2]) AS value FROM ev JOIN fact f ON f.week_end = ev.t_plus_h)",
    "ec AS (SELECT *, value - avg(value) OVER (PARTITION BY model, horizon, factor) AS e FROM res)",
    f"el AS (SELECT model, horizon, factor, sum(e * e) AS v, count(*)::DOUBLE AS n, {_LB_SUMS} FROM (SELECT *, {_LB_LAGS} FROM ec WINDOW w AS (PARTITION BY model, horizon, factor ORDER BY origin)) GROUP BY ALL)",
    "eq AS (SELECT *, n * (n + 2) * (" + " + ".join(f"power(a{k} / v, 2) / (n - {k})" for k in range(1, 11)) + ") AS q FROM el)",
    # ten degrees of freedom: the tail is exp(-q/2) times the first five terms of the exponential series
    "SELECT model, horizon, factor, n::BIGINT AS n, round(q, 4) AS q, round((-q / 2 + ln(list_sum(list_transform(range(0, 5), lambda k: power(q / 2, k) / gamma(k + 1))))) / ln(10), 4) AS log10_p FROM eq"))

# iterated forecasts --------------------------------------------------------------------------
_BETAS = ["beta0", "beta1", "beta2"]
_SIGMAS = [f"s_{i}{j}" for i in range(3) for j in range(i, 3)]


def _weighted_var(spark, d):
    """The weighted vector autoregression of the factors at every week: forecasts and the covariance of their errors."""
    rows = fact(spark, d).select(F.lit("all").alias("grp"), "week_end", *_BETAS)
    return rounded(gram.iterated_forecasts(rows, ["grp"], _BETAS, HORIZONS, 1, S.ew_decay).where(F.col("n_fit") >= 26).drop("grp"), 5)


add("weighted_var_forecasts", _weighted_var, with_sql(FACT, "fg AS (SELECT 'all' AS grp, week_end, beta0, beta1, beta2 FROM fact)", *iterated_sql("fg", "grp", _BETAS, HORIZONS, 1, S.ew_decay),
    f"SELECT week_end, horizon, n_fit, {_round_sql([*[f'forecast_{b}' for b in _BETAS], *_SIGMAS], 5)} FROM it WHERE n_fit >= 26"))


def _iterated_ar(spark, d):
    """Each factor's own autoregression of order two, its forecasts fed back, at every week."""
    rows = fact(spark, d).unpivot(["week_end"], _BETAS, "factor", "value")
    return rounded(gram.iterated_forecasts(rows, ["factor"], ["value"], HORIZONS, 2).where(F.col("n_fit") >= 26), 5)


add("iterated_autoregression", _iterated_ar, with_sql(FACT, "fl AS (" + " UNION ALL ".join(f"SELECT week_end, '{b}' AS factor, {b} AS value FROM fact" for b in _BETAS) + ")",
    *iterated_sql("fl", "factor", ["value"], HORIZONS, 2), f"SELECT factor, week_end, horizon, n_fit, {_round_sql(['forecast_value', 's_00'], 5)} FROM it WHERE n_fit >= 26"))

# tests on series ----------------------------------------------------------------------------
def _series(spark, d):
    f = fact(spark, d).select("week_end", *[F.col(f"beta{i}").alias(f"beta{i}") for i in range(3)])
    return f.unpivot(["week_end"], ["beta0", "beta1", "beta2"], "series", "value").unionByName(macro(spark, d).select("week_end", "series", "value"))


def _gpairs(spark, d):
    m = macro(spark, d).select("week_end", F.col("series").alias("cause"), F.col("value").alias("x"))
    f = fact(spark, d).unpivot(["week_end"], ["beta0", "beta1", "beta2"], "effect", "y")
    return m.join(f, "week_end")


_LONG = "factor AS (" + " UNION ALL ".join(f"SELECT week_end, 'beta{i}' AS series, beta{i} AS value FROM fact" for i in range(3)) + ")"
_SERIES = [FACT, MACRO, _LONG, "se AS (SELECT week_end, series, value FROM factor UNION ALL SELECT week_end, series, value FROM macro)"]
_TESTED = ["adf_stat", "adf_p", "kpss_stat", "kpss_p"]
add("stationarity_tests", lambda s, d: rounded(hypothesis.stationarity(_series(s, d)), 5), with_sql(*_SERIES, *stationarity_sql("se"),
    f"SELECT series, {_round_sql(_TESTED, 5)}, adf_lags, kpss_lags, verdict FROM st"))
_GPAIRS = [FACT, MACRO, _LONG, "gp AS (SELECT week_end, m.series AS cause, f.series AS effect, m.value AS x, f.value AS y FROM macro m JOIN factor f USING (week_end))"]
_HALVES = ["mid AS (SELECT quantile_disc(week_end, 0.5) AS m FROM (SELECT DISTINCT week_end FROM gp))",
    "gp1 AS (SELECT gp.* FROM gp, mid WHERE week_end <= m)", "gp2 AS (SELECT gp.* FROM gp, mid WHERE week_end >= m)"]
_SCREENED = "SELECT cause, effect, round(p, 5) AS p, best_lag, sig, verdict FROM screen"
add("granger_ssr_f", lambda s, d: rounded(hypothesis.granger_tests(_gpairs(s, d)), 5), with_sql(*_GPAIRS, *granger_sql("gp", 4), f"SELECT {GRANGER_COLUMNS} FROM granger"))
add("granger_halves", lambda s, d: rounded(hypothesis.granger_halves(_gpairs(s, d), 2), 5), with_sql(*_GPAIRS, *_HALVES, *granger_sql("gp1", 2, "g1"), *granger_sql("gp2", 2, "g2"),
    f"SELECT {GRANGER_COLUMNS}, 'first' AS half FROM g1 UNION ALL SELECT {GRANGER_COLUMNS}, 'second' FROM g2"))
add("macro_screening", lambda s, d: rounded(hypothesis.screening(hypothesis.granger_tests(_gpairs(s, d))), 5), with_sql(*_GPAIRS, *granger_sql("gp", 4), screening_sql(), _SCREENED))


def _transform_pairs(spark, d):
    """Every transform of every macro series against every factor; a cause is series:transform."""
    t = weekly.macro_transforms(macro(spark, d), "value", "series")
    causes = t.select("week_end", F.concat_ws(":", "series", "transform").alias("cause"), F.col("value").alias("x"))
    return causes.join(fact(spark, d).unpivot(["week_end"], ["beta0", "beta1", "beta2"], "effect", "y"), "week_end")


_TRANSFORMS = "tr AS (SELECT week_end, series || ':level' AS cause, value AS x FROM macro UNION ALL " + " UNION ALL ".join(
    f"SELECT week_end, series || ':d{k}W', value - lag(value, {k}) OVER (PARTITION BY series ORDER BY week_end) FROM macro" for k in (1, 4, 13, 26)) + """ UNION ALL
  SELECT week_end, series || ':z52W', CASE WHEN count(value) OVER w >= 26 THEN (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END FROM macro
  WINDOW w AS (PARTITION BY series ORDER BY week_end ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))"""


def _spec(spark, d):
    """Every macro series, and an index that grows without end (running sums of the order values by week), by the tree of transforms."""
    m = macro(spark, d)
    w = Window.partitionBy("series").orderBy("week_end").rowsBetween(Window.unboundedPreceding, 0)
    drift = m.select("week_end", F.concat_ws(" ", "series", F.lit("summed")).alias("series"), F.sum("value").over(w).alias("value"))
    summed = drift.select("week_end", F.concat_ws(" ", "series", F.lit("twice")).alias("series"), F.sum("value").over(w).alias("value"))
    t = weekly.macro_transforms(m.unionByName(drift).unionByName(summed), "value", "series")
    return rounded(hypothesis.specification(t.select("week_end", "series", "transform", "value")), 4)


_RUNNING = "sum(value) OVER (PARTITION BY series ORDER BY week_end)"
add("transform_choice", _spec, with_sql(MACRO.replace("macro AS", "macro0 AS"), f"macro1 AS (SELECT week_end, series || ' summed' AS series, {_RUNNING} AS value FROM macro0)", f"macro2 AS (SELECT week_end, series || ' twice' AS series, {_RUNNING} AS value FROM macro1)",
    "macro AS (SELECT * FROM macro0 UNION ALL SELECT * FROM macro1 UNION ALL SELECT * FROM macro2)", _TRANSFORMS, "se AS (SELECT week_end, cause AS series, x AS value FROM tr)", *stationarity_sql("se"),
    "steps(step, transform) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(hypothesis.TREE)) + ")",
    "tree AS (SELECT split_part(series, ':', 1) AS series, step, transform, adf_p, kpss_p, verdict, coalesce(adf_p < 0.05, false) AS chosen FROM st JOIN steps ON transform = split_part(series, ':', 2))",
    """SELECT series, step, transform, round(adf_p, 4) AS adf_p, round(CASE WHEN adf_p IS NOT NULL THEN kpss_p END, 4) AS kpss_p, verdict, chosen FROM tree
    QUALIFY step <= coalesce(min(CASE WHEN chosen THEN step END) OVER (PARTITION BY series), 99)"""))
_TPAIRS = [FACT, MACRO, _LONG, _TRANSFORMS, "tp AS (SELECT week_end, cause, f.series AS effect, x, f.value AS y FROM tr JOIN factor f USING (week_end))", *granger_sql("tp", 4), screening_sql()]
add("transform_screening", lambda s, d: rounded(hypothesis.screening(hypothesis.granger_tests(_transform_pairs(s, d))), 5), with_sql(*_TPAIRS, _SCREENED))
add("best_transforms", lambda s, d: rounded(hypothesis.best_transform(hypothesis.screening(hypothesis.granger_tests(_transform_pairs(s, d)))), 5), with_sql(*_TPAIRS,
    "split AS (SELECT split_part(cause, ':', 1) AS variable, split_part(cause, ':', 2) AS transform, effect, p FROM screen)",
    "SELECT variable, effect, arg_min(transform, (p, transform)) AS best_transform, round(min(p), 5) AS p FROM split GROUP BY 1, 2"))
_MARKS = "CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.1 THEN '*' ELSE '' END AS sig"
add("multi_horizon_projection", lambda s, d: rounded(hypothesis.projection_tests(_gpairs(s, d), HORIZONS), 5), with_sql(*_GPAIRS, *projection_sql("gp", HORIZONS),
    f"SELECT cause, effect, horizon, round(wald_f, 5) AS wald_f, round(p_value, 5) AS p_value, n, {_MARKS} FROM proj"))
add("signal_pattern", lambda s, d: hypothesis.signal_pattern(hypothesis.projection_tests(_gpairs(s, d), HORIZONS)), with_sql(*_GPAIRS, *projection_sql("gp", HORIZONS),
    """sp AS (SELECT cause, effect, count(*) FILTER (p_value < 0.05 AND horizon <= 4) AS short_hits, count(*) FILTER (p_value < 0.05 AND horizon > 4) AS long_hits, arg_min(horizon, (p_value, horizon)) AS best_horizon FROM proj GROUP BY 1, 2)""",
    "SELECT *, CASE WHEN short_hits > 0 AND long_hits > 0 THEN 'persistent' WHEN short_hits > 0 THEN 'short' WHEN long_hits > 0 THEN 'long' ELSE 'none' END AS pattern FROM sp"))
add("residual_diagnostics", lambda s, d: rounded(hypothesis.diagnostics(_series(s, d)), 5), with_sql(FACT, MACRO, _LONG, "se AS (SELECT week_end, series, value FROM factor UNION ALL SELECT week_end, series, value FROM macro)",
    *diagnostics_sql("se"), f"SELECT series, {_round_sql(['lb_min_p', 'arch_stat', 'arch_p', 'jb_stat', 'jb_p', 'skew', 'kurtosis'], 5)} FROM diag"))
add("lag_selection", lambda s, d: rounded(hypothesis.select_lag(written(fact(s, d), "factors"), ["beta0", "beta1", "beta2"], 8), 5), with_sql(FACT, *lag_selection_sql("fact", ["beta0", "beta1", "beta2"], 8),
    f"SELECT p, {_round_sql(['aic', 'bic', 'hq'], 5)}, row_number() OVER (ORDER BY bic, p) = 1 AS chosen FROM orders"))
add("acf_40", lambda s, d: rounded(hypothesis.autocorrelations(orders_weekly(s, d), "value")), with_sql(ORDERS, "c AS (SELECT week_end, value - avg(value) OVER () AS e, row_number() OVER (ORDER BY week_end) AS i FROM orders_weekly)",
    "v AS (SELECT sum(e*e) AS v, count(*) AS n FROM c)",
    "SELECT k::INTEGER AS lag, round(sum(a.e * b.e) / any_value(v), 6) AS acf, round(1.96 / sqrt(any_value(n)), 6) AS band FROM range(1, 41) r(k), c a JOIN c b ON b.i = a.i - k, v GROUP BY k"))
add("jarque_bera_stat", lambda s, d: rounded(hypothesis.jarque_bera_table(macro(s, d), ["series"], "value"), 5), with_sql(MACRO, """
z AS (SELECT series, value - avg(value) OVER (PARTITION BY series) AS e FROM macro),
m AS (SELECT series, count(*) AS n, avg(e*e*e) / power(avg(e*e), 1.5) AS skew, avg(e*e*e*e) / power(avg(e*e), 2) - 3 AS kurtosis FROM z GROUP BY 1)""",
    "SELECT series, n, round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis, round(n / 6.0::DOUBLE * (power(skew, 2) + power(kurtosis, 2) / 4), 5) AS jb_stat FROM m"))


def _ljung(spark, d):
    base = hypothesis.autocorrelations(orders_weekly(spark, d), "value", 10)
    n = orders_weekly(spark, d).agg(F.count(F.lit(1)).alias("n"))
    q = F.col("n") * (F.col("n") + 2) * F.sum(F.col("acf") ** 2 / (F.col("n") - F.col("lag"))).over(Window.orderBy("lag"))
    return rounded(base.join(F.broadcast(n)).select("lag", q.alias("q")), 5)


add("ljung_box", _ljung, with_sql(ORDERS, "c AS (SELECT value - avg(value) OVER () AS e, row_number() OVER (ORDER BY week_end) AS i FROM orders_weekly)", "v AS (SELECT sum(e*e) AS v, count(*)::DOUBLE AS n FROM c)",
    "a AS (SELECT k AS lag, sum(a.e * b.e) / any_value(v) AS r, any_value(n) AS n FROM range(1, 11) t(k), c a JOIN c b ON b.i = a.i - k, v GROUP BY k)",
    "SELECT lag::INTEGER AS lag, round(n * (n + 2) * sum(r*r / (n - lag)) OVER (ORDER BY lag), 5) AS q FROM a"))
_XS = [f"x{i}" for i in range(1, 6)]
_INFLATED = [(_XS[j], eliminated("wx", "one", [*[x for x in _XS if x != _XS[j]], _XS[j]], {0: "whole"}, f"vif{j}_")) for j in range(5)]
add("vif", lambda s, d: rounded(hypothesis.inflation(macro_wide(s, d), _XS), 4), with_sql(MACRO,
    "wx AS (SELECT * FROM (SELECT 1 AS one, " + ", ".join(f"max(value) FILTER (series LIKE '{i}%') AS x{i}" for i in range(1, 6)) + " FROM macro GROUP BY week_end) WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in _XS) + ")",
    *[cte for _, ctes in _INFLATED for cte in ctes], " UNION ALL ".join(f"SELECT '{x}' AS variable, round(whole / g4_4, 4) AS vif FROM vif{j}_4" for j, (x, _) in enumerate(_INFLATED))))


def _emb(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return rounded(rows.groupBy("label", "dim").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")), 5)


add("embedding_moments", _emb, "SELECT label, (i - 1)::INTEGER AS dim, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")
