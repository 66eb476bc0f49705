"""Direct multi-horizon forecasts of the factors, evaluated on expanding windows.

A (horizon, model) is one group: the weekly table of at most a few thousand rows is dealt to
one task per group, so the work grows with horizons x models and each task's memory with the
number of weeks. Everything before (weekly aggregation) and after (errors, metrics) is
plain DataFrame work.

Models: 0 random walk; 1 regression of beta at t+h on p lags of the factors; 2 with macro
columns at t as well; 3 as 2 with weights decaying by age. A model without enough rows falls
back to the random walk.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from termforge.functions.columns import log_price
from termforge.functions.linear import least_squares, var_fit

BETAS = ["beta0", "beta1", "beta2"]
_FORECAST = (
    "week_end date, horizon int, model int, beta0_hat double, beta1_hat double, beta2_hat double, t_plus_h date, asof_row date, n_rows int, coef_norm double"
)


def design(beta: np.ndarray, macro: np.ndarray | None, lags: int, macro_lags: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(rows, X): X[i] = 1, factors at rows[i] .. rows[i]-lags+1, macro at rows[i] .. rows[i]-macro_lags+1."""
    depth = max(lags, macro_lags if macro is not None else 1)
    rows = np.arange(depth - 1, len(beta))
    parts = [np.ones((len(rows), 1)), *[beta[rows - k] for k in range(lags)]]
    if macro is not None:
        parts += [macro[rows - k] for k in range(macro_lags)]
    return rows, np.hstack(parts)


def decay_weights(n: int, decay: float) -> np.ndarray:
    """decay^(n-1-i), scaled to sum to n."""
    w = decay ** np.arange(n - 1, -1, -1.0)
    return w * n / w.sum()


def backtest_group(table: pd.DataFrame, horizon: int, model: int, first: pd.Timestamp, macro_cols: list[str], lags: int, decay: float) -> pd.DataFrame:
    """Forecasts of one (horizon, model) at every week from `first` on, each from the rows known by then."""
    table = table.sort_values("week_end").reset_index(drop=True)
    factor_rows = table.dropna(subset=BETAS)
    use_macro = model >= 2
    known = factor_rows.dropna(subset=macro_cols) if use_macro else factor_rows
    beta, when = known[BETAS].to_numpy(float), known["week_end"].to_numpy()
    macro = known[macro_cols].to_numpy(float) if use_macro else None
    weeks = factor_rows["week_end"].to_numpy()
    current = factor_rows[BETAS].to_numpy(float)
    rows, x = design(beta, macro, lags) if model else (np.arange(0), np.empty((0, 1)))
    out = []
    for i, week in enumerate(weeks):
        if pd.Timestamp(week) < first:
            continue
        hat, asof, n_used, norm = current[i], week, 0, 0.0
        if model:
            last = np.searchsorted(when, week, side="right") - 1  # the last complete row known at the week
            fit = rows[rows + horizon <= last]
            if len(rows) and last >= rows[0] and len(fit) >= x.shape[1] + 2:
                xf, yf = x[: len(fit)], beta[fit + horizon]
                coef = least_squares(xf, yf, decay_weights(len(fit), decay) if model == 3 else None)
                hat, asof, n_used, norm = x[last - rows[0]] @ coef, when[last], len(fit), float(np.linalg.norm(coef))
        target = weeks[i + horizon] if i + horizon < len(weeks) else None
        out.append((week, horizon, model, *map(float, hat), target, asof, n_used, norm))
    names = ["week_end", "horizon", "model", "beta0_hat", "beta1_hat", "beta2_hat", "t_plus_h", "asof_row", "n_rows", "coef_norm"]
    frame = pd.DataFrame(out, columns=names)
    for c in ("week_end", "t_plus_h", "asof_row"):
        frame[c] = pd.to_datetime(frame[c]).dt.date
    return frame


def backtest(table: DataFrame, horizons, models, first, macro_cols=(), lags: int = 1, decay: float = 0.997) -> DataFrame:
    """Expanding-window forecasts for a weekly table (week_end, beta0..2, macro columns)."""
    spark = table.sparkSession
    grid = spark.createDataFrame([(int(h), int(m)) for h in horizons for m in models], "horizon int, model int")
    macro_cols, first = list(macro_cols), pd.Timestamp(first)
    rows = table.select(F.col("week_end"), *BETAS, *macro_cols).crossJoin(F.broadcast(grid))

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group["week_end"] = pd.to_datetime(group["week_end"])
        return backtest_group(group, int(key[0]), int(key[1]), first, macro_cols, lags, decay)

    return rows.groupBy("horizon", "model").applyInPandas(run, _FORECAST)


def random_walk(fact: DataFrame, horizons, first) -> DataFrame:
    """The random-walk forecasts as plain columns: week_end, horizon, model 0, beta*_hat, t_plus_h (h rows later)."""
    w = Window.orderBy("week_end")
    led = fact.where("beta0 is not null").select("week_end", *BETAS, *[F.lead("week_end", int(h)).over(w).alias(f"__t{h}") for h in horizons])
    targets = F.array(*[F.struct(F.lit(int(h)).alias("horizon"), F.col(f"__t{h}").alias("t_plus_h")) for h in horizons])
    rows = led.where(F.col("week_end") >= F.lit(first)).withColumn("x", F.explode(targets))
    return rows.select("week_end", "x.horizon", F.lit(0).alias("model"), *[F.col(b).alias(f"{b}_hat") for b in BETAS], "x.t_plus_h")


def forecast_errors(forecasts: DataFrame, panel: DataFrame, maturities, decay: float) -> DataFrame:
    """week_end, horizon, model, maturity, forecast, actual, current_price, error for realised forecasts."""
    cells = F.array(*[F.struct(F.lit(int(m)).alias("maturity"), F.exp(log_price_hat(m, decay)).alias("forecast")) for m in maturities])
    priced = forecasts.where("t_plus_h is not null").withColumn("x", F.explode(cells)).select("week_end", "horizon", "model", "t_plus_h", "x.*")
    actual = panel.select(F.col("week_end").alias("t_plus_h"), "maturity", F.col("price").alias("actual"))
    current = panel.select("week_end", "maturity", F.col("price").alias("current_price"))
    out = priced.join(actual, ["t_plus_h", "maturity"]).join(current, ["week_end", "maturity"], "left")
    return out.withColumn("error", F.col("forecast") - F.col("actual"))


def log_price_hat(tau: float, decay: float):
    names = {f"beta{i}": F.col(f"beta{i}_hat") for i in range(3)}
    from termforge.functions.columns import loadings

    _, s, c = loadings(tau, decay)
    return names["beta0"] + F.lit(s) * names["beta1"] + F.lit(c) * names["beta2"]


def metrics(errors: DataFrame, keys: list[str], exclude_zero: bool = True) -> DataFrame:
    """rmse, mae, hit_rate (null for the random walk), n for each key."""
    move = F.signum(F.col("actual") - F.col("current_price"))
    lean = F.signum(F.col("forecast") - F.col("current_price"))
    counted = (move != 0) if exclude_zero else move.isNotNull()
    hit = F.avg(F.when((F.col("model") != 0) & counted, (move == lean).cast("int")))
    return errors.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg(F.abs("error")).alias("mae"), hit.alias("hit_rate"), F.count(F.lit(1)).alias("n")
    )


def subperiod_metrics(errors: DataFrame, shock) -> DataFrame:
    """Metrics by (model, horizon) over all weeks, before the shock and from it on, in one aggregation."""
    period = F.when(F.col("week_end") >= F.lit(shock), "shock").otherwise("stable")
    rows = errors.withColumn("period", period)
    sq, ab = F.col("error") * F.col("error"), F.abs("error")
    out = rows.groupingSets([["model", "horizon", "period"], ["model", "horizon"]], "model", "horizon", "period").agg(
        F.sqrt(F.avg(sq)).alias("rmse"), F.avg(ab).alias("mae"), F.count(F.lit(1)).alias("n")
    )
    return out.withColumn("period", F.coalesce("period", F.lit("full")))


def decay_search(table: DataFrame, panel: DataFrame, maturities, curve_decay: float, decays, horizon: int, maturity: int, first, macro_cols, lags: int = 1) -> DataFrame:
    """rmse of model 3 at one horizon and maturity for each weight decay, with effective size and half-life."""
    from termforge.functions.columns import effective_size, half_life

    parts = []
    for d in decays:
        errors = forecast_errors(backtest(table, [horizon], [3], first, macro_cols, lags, d), panel, [maturity], curve_decay)
        parts.append(metrics(errors, ["model", "horizon"]).select(F.lit(float(d)).alias("decay"), "rmse", "mae", "n", F.lit(effective_size(d)).alias("ess"), F.lit(half_life(d)).alias("half_life_weeks")))
    return reduce(DataFrame.unionByName, parts)


def residual_pool(forecasts: DataFrame, fact: DataFrame) -> DataFrame:
    """Realised factor residuals: horizon, model, origin, realized_date, r0, r1, r2 (actual minus forecast)."""
    actual = fact.select(F.col("week_end").alias("t_plus_h"), *BETAS)
    rows = forecasts.where("t_plus_h is not null").join(actual, "t_plus_h")
    return rows.select(
        "horizon", "model", F.col("week_end").alias("origin"), F.col("t_plus_h").alias("realized_date"), *[(F.col(b) - F.col(f"{b}_hat")).alias(f"r{i}") for i, b in enumerate(BETAS)]
    )


def residual_covariance(pool: DataFrame) -> DataFrame:
    """The six distinct entries of each (horizon, model)'s residual covariance."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    return pool.groupBy("horizon", "model").agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(f"r{i}", f"r{j}").alias(f"s{i}{j}") for i, j in pairs])


def weighted_var(beta: np.ndarray, lags: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, residual covariance) of a vector autoregression with weights decaying by age."""
    n = len(beta) - lags
    w = decay_weights(n, decay)
    t = np.arange(lags, len(beta))
    x = np.column_stack([np.ones(n), *[beta[t - k] for k in range(1, lags + 1)]])
    coef = least_squares(x, beta[t], w)
    e = beta[t] - x @ coef
    return coef, (e * w[:, None]).T @ e / w.sum()


def autoregression(y: np.ndarray, lags: int) -> np.ndarray:
    """Coefficients of one factor's autoregression, the constant first."""
    return var_fit(y[:, None], lags)[0][:, 0]


def expanding_covariance(pool: DataFrame, least: int = 5, default: float = 1e-4) -> DataFrame:
    """Covariance of the residuals realised by each date: horizon, model, week_end, n, s00..s22.

    Below `least` residuals it is `default` times the identity. One running window per
    (horizon, model) over its weekly residuals.
    """
    w = Window.partitionBy("horizon", "model").orderBy("realized_date", "origin").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(w)
    cells = []
    for i in range(3):
        for j in range(i, 3):
            cells.append(F.when(n >= least, F.covar_samp(f"r{i}", f"r{j}").over(w)).otherwise(F.lit(default if i == j else 0.0)).alias(f"s{i}{j}"))
    return pool.select("horizon", "model", F.col("realized_date").alias("week_end"), n.alias("n"), *cells)


def with_default(rows: DataFrame, table: DataFrame, keys: list[str], defaults: dict[str, float]) -> DataFrame:
    """rows with the columns of a keyed table, and stated defaults where the key is missing."""
    out = rows.join(table, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
