"""Least squares from running sums: all dates of an expanding window in one pass of a window function.

A fit needs only the sums of products of its regressors and targets. These are running sums over
the rows in order of week, for every group at once; each row's small symmetric system is then solved
on its own, in Arrow batches. So no row is refitted from scratch.

Columns are centred on their means over the whole table first. With a constant among the regressors this is a
change of coordinates only, and keeps the sums well conditioned; intercepts are given back in the
original coordinates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

BETAS = ["beta0", "beta1", "beta2"]


def solver(k: int, m: int):
    """A column function: the upper triangle of a Gram matrix of k regressors and m targets, row by row, to coef and rss.

    Collinear regressors get the coefficients of least norm.
    """
    upper = np.triu_indices(k + m)

    @F.pandas_udf("coef array<array<double>>, rss array<double>")
    def solve(sums: pd.Series) -> pd.DataFrame:
        gram = np.zeros((len(sums), k + m, k + m))
        if len(sums):
            gram[:, upper[0], upper[1]] = np.stack(sums.to_numpy())
            gram[:, upper[1], upper[0]] = gram[:, upper[0], upper[1]]
        xx, xy, yy = gram[:, :k, :k], gram[:, :k, k:], gram[:, k:, k:]
        # unit diagonals, so that the cut-off for collinear columns doesn't depend on their units
        scale = np.sqrt(np.maximum(np.einsum("nii->ni", xx), 1e-300))
        coef = np.linalg.pinv(xx / scale[:, :, None] / scale[:, None, :], rcond=1e-12, hermitian=True) @ (xy / scale[:, :, None]) / scale[:, :, None]
        rss = np.einsum("nii->ni", yy) - np.einsum("nij,nij->nj", coef, xy)
        return pd.DataFrame({"coef": [c.T.tolist() for c in coef], "rss": [np.maximum(r, 0.0).tolist() for r in rss]})

    return solve


def expanding_fits(rows: DataFrame, keys: list[str], order: str, xs: list[str], ys: list[str], weight: Column | None = None) -> DataFrame:
    """rows with n_fit, coef (array over ys of arrays: intercept, then xs) and rss (array over ys), from all rows of the key up to each.

    rows: columns xs and ys without nulls, centred; weight: of a row, up to a factor per key.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    z = [F.lit(1.0), *[F.col(c) for c in (*xs, *ys)]]
    weight = F.lit(1.0) if weight is None else weight
    sums = F.array(*[F.sum(weight * z[i] * z[j]).over(w) for i in range(len(z)) for j in range(i, len(z))])
    out = rows.select("*", F.count(F.lit(1)).over(w).alias("n_fit"), sums.alias("__sums"))
    return out.withColumn("__fit", solver(1 + len(xs), len(ys))("__sums")).select(*rows.columns, "n_fit", "__fit.coef", "__fit.rss")


def direct_pairs(table: DataFrame, horizons, columns: list[str]) -> DataFrame:
    """horizon, week_end, place, t_plus_h (h rows later, among complete rows), centred columns, later_* (the factors h rows later)."""
    known = table.where(" and ".join(f"{c} is not null" for c in columns))
    means = known.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    known = known.join(F.broadcast(means)).select("week_end", *[(F.col(c) - F.col(f"mean_{c}")).alias(c) for c in columns], *[f"mean_{c}" for c in columns])
    w = Window.orderBy("week_end")
    ahead = [F.struct(F.lit(int(h)).alias("horizon"), F.lead("week_end", int(h)).over(w).alias("t_plus_h"), *[F.lead(b, int(h)).over(w).alias(f"later_{b}") for b in BETAS]).alias(f"__h{h}") for h in horizons]
    led = known.withColumn("place", F.row_number().over(w)).select("*", *ahead)
    return led.withColumn("x", F.explode(F.array(*[F.col(f"__h{h}") for h in horizons]))).drop(*[f"__h{h}" for h in horizons]).select("*", "x.*").drop("x")


def direct_fits(table: DataFrame, horizons, macro_cols=(), decay: float | None = None) -> DataFrame:
    """week_end, horizon, n_fit, coef, rss: the direct regression of the factors h rows ahead on those of a week (and macro columns), from pairs realised by the week.

    decay: weights falling by this factor a row. Coefficients are in original coordinates.
    """
    xs = [*BETAS, *macro_cols]
    pairs = direct_pairs(table, horizons, xs)
    realised = pairs.where("t_plus_h is not null")
    # Running weights decay^-place differ from decay^(age) by a factor that drops out.
    weight = None if decay in (None, 1.0) else F.pow(F.lit(1.0 / decay), F.col("place"))
    fits = expanding_fits(realised, ["horizon"], "week_end", xs, [f"later_{b}" for b in BETAS], weight)
    shift = [F.col(f"mean_{b}") for b in BETAS]
    original = []
    for y in range(3):
        slopes = [F.col("coef")[y][p] for p in range(1, 1 + len(xs))]
        start = F.col("coef")[y][0] + shift[y]
        for s, x in zip(slopes, xs):
            start = start - s * F.col(f"mean_{x}")
        original.append(F.array(start, *slopes))
    # What is fitted on pairs up to a row is known when the row's target is.
    return fits.select(F.col("t_plus_h").alias("week_end"), "horizon", "n_fit", F.array(*original).alias("coef"), "rss")


def direct_forecasts(table: DataFrame, horizons, first, model: int, macro_cols=(), decay: float | None = None) -> DataFrame:
    """week_end, horizon, model, beta*_hat, t_plus_h, n_fit, coef from `first` on; the random walk where a fit has fewer than its coefficients + 2 rows.

    Rows of table are complete, or are left out.
    """
    xs = [*BETAS, *macro_cols]
    known = table.where(" and ".join(f"{c} is not null" for c in xs))
    w = Window.orderBy("week_end")
    ahead = F.array(*[F.struct(F.lit(int(h)).alias("horizon"), F.lead("week_end", int(h)).over(w).alias("t_plus_h")) for h in horizons])
    rows = known.select("week_end", *xs, ahead.alias("x")).withColumn("x", F.explode("x")).select("week_end", *xs, "x.*")
    joined = rows.join(direct_fits(table, horizons, macro_cols, decay), ["week_end", "horizon"], "left").where(F.col("week_end") >= F.lit(first))
    enough = F.col("n_fit") >= len(xs) + 3
    hats = []
    for y, b in enumerate(BETAS):
        hat = F.col("coef")[y][0]
        for p, x in enumerate(xs, 1):
            hat = hat + F.col("coef")[y][p] * F.col(x)
        hats.append(F.coalesce(F.when(enough, hat), F.col(b)).alias(f"{b}_hat"))
    return joined.select("week_end", "horizon", F.lit(model).alias("model"), *hats, "t_plus_h", F.when(enough, F.col("n_fit")).otherwise(0).alias("n_fit"), F.when(enough, F.col("coef")).alias("coef"), "rss")


def stability(forecasts: DataFrame, size: int = 26) -> DataFrame:
    """week_end, horizon, model, n_fit, coef_norm, change, smooth, ahead of forecasts with coef.

    change: Frobenius norm of the difference from the week before; smooth: its mean over `size` weeks, where there are
    so many; ahead: the greatest smooth from the week on.
    """
    w = Window.partitionBy("horizon", "model").orderBy("week_end")
    flat = forecasts.where("n_fit > 0 and coef is not null").withColumn("flat", F.flatten("coef"))
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    rows = flat.withColumn("before", F.lag("flat").over(w))
    rows = rows.select("week_end", "horizon", "model", "n_fit", norm(F.col("flat")).alias("coef_norm"), norm(F.zip_with("flat", "before", lambda a, b: a - b)).alias("change"))
    recent = w.rowsBetween(1 - size, 0)
    rows = rows.withColumn("smooth", F.when(F.count("change").over(recent) == size, F.avg("change").over(recent)))
    return rows.withColumn("ahead", F.max("smooth").over(w.rowsBetween(0, Window.unboundedFollowing)))


def stabilisation_date(rows: DataFrame, size: int = 26, tolerance: float = 1.5) -> DataFrame:
    """horizon, model, n_changes, terminal, stable_from: the first week from which smooth never again exceeds `tolerance` times terminal.

    terminal: the median change of the last fifth of weeks. With fewer than 2 * size changes stable_from is null.
    """
    changed = rows.where("change is not null")
    keys = ["horizon", "model"]
    counted = changed.withColumn("n_changes", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    age = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("week_end").desc()))
    late = counted.withColumn("age", age).where(F.col("age") <= F.floor(F.col("n_changes") * 0.2))
    terminal = late.groupBy(*keys).agg(F.percentile("change", F.lit(0.5)).alias("terminal"))
    settled = counted.join(F.broadcast(terminal), keys, "left")
    quiet = F.col("smooth").isNotNull() & (F.col("ahead") <= tolerance * F.col("terminal")) & (F.col("n_changes") >= 2 * size)
    return settled.groupBy(*keys).agg(F.max("n_changes").alias("n_changes"), F.max("terminal").alias("terminal"), F.min(F.when(quiet, F.col("week_end"))).alias("stable_from"))


def in_sample_residuals(table: DataFrame, horizons, first, last) -> DataFrame:
    """week_end, horizon, model 1, beta*_hat, t_plus_h and r0, r1, r2: every residual, of pairs realised by the week, of the fit made at the week."""
    forecasts = direct_forecasts(table, horizons, first, 1).where((F.col("week_end") < F.lit(last)) & F.col("t_plus_h").isNotNull())
    known = table.where(" and ".join(f"{b} is not null" for b in BETAS))
    w = Window.orderBy("week_end")
    ahead = [F.struct(F.lit(int(h)).alias("horizon"), F.lead("week_end", int(h)).over(w).alias("realized_date"), *[F.lead(b, int(h)).over(w).alias(f"y{i}") for i, b in enumerate(BETAS)]) for h in horizons]
    pairs = known.select(F.col("week_end").alias("origin"), *[F.col(b).alias(f"x{i}") for i, b in enumerate(BETAS)], F.array(*ahead).alias("p"))
    pairs = pairs.withColumn("p", F.explode("p")).select("origin", "x0", "x1", "x2", "p.*")
    joined = forecasts.join(pairs, "horizon").where("realized_date <= week_end and coef is not null")
    residuals = [(F.col(f"y{i}") - F.col("coef")[i][0] - sum((F.col("coef")[i][p + 1] * F.col(f"x{p}") for p in range(3)), F.lit(0.0))).alias(f"r{i}") for i in range(3)]
    return joined.select("week_end", "horizon", "model", *[f"{b}_hat" for b in BETAS], "t_plus_h", "origin", "realized_date", *residuals)


def _paths(k: int, lags: int, horizons: tuple[int, ...]):
    """A column function: running Gram sums, their weight and the last observations to forecasts and error covariances at the horizons.

    Forecasts feed forecasts; the covariance adds Phi_i Sigma Phi_i' over the steps, with Phi_i from powers of the companion matrix. All
    rows of an Arrow batch go step by step together.
    """
    size = 1 + k * lags
    upper, corner = np.triu_indices(size + k), np.triu_indices(k)

    @F.pandas_udf("forecast array<array<double>>, covariance array<array<double>>")
    def walk(sums: pd.Series, weight: pd.Series, last: pd.Series) -> pd.DataFrame:
        n = len(sums)
        if not n:
            return pd.DataFrame({"forecast": [], "covariance": []})
        gram = np.zeros((n, size + k, size + k))
        gram[:, upper[0], upper[1]] = np.stack(sums.to_numpy())
        gram[:, upper[1], upper[0]] = gram[:, upper[0], upper[1]]
        unit = np.sqrt(np.maximum(np.einsum("nii->ni", gram[:, :size, :size]), 1e-300))
        xx = gram[:, :size, :size] / unit[:, :, None] / unit[:, None, :]
        coef = np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ (gram[:, :size, size:] / unit[:, :, None]) / unit[:, :, None]
        sigma = (gram[:, size:, size:] - np.swapaxes(coef, 1, 2) @ gram[:, :size, size:]) / weight.to_numpy()[:, None, None]
        companion = np.zeros((n, k * lags, k * lags))
        companion[:, :k] = np.swapaxes(coef[:, 1:], 1, 2)
        companion[:, k:, : k * (lags - 1)] = np.eye(k * (lags - 1))
        state = np.stack(last.to_numpy())
        power, total = np.broadcast_to(np.eye(k * lags), companion.shape).copy(), np.zeros((n, k, k))
        forecasts, covariances = [], []
        for step in range(1, max(horizons) + 1):
            ahead = np.einsum("nij,nj->ni", companion, state)
            ahead[:, :k] += coef[:, 0]
            state = ahead
            phi = power[:, :k, :k]
            total = total + phi @ sigma @ np.swapaxes(phi, 1, 2)
            power = power @ companion
            if step in horizons:
                forecasts.append(state[:, :k])
                covariances.append(total[:, corner[0], corner[1]])
        return pd.DataFrame({"forecast": [[f[i].tolist() for f in forecasts] for i in range(n)], "covariance": [[c[i].tolist() for c in covariances] for i in range(n)]})

    return walk


def iterated_forecasts(rows: DataFrame, keys: list[str], columns: list[str], horizons, lags: int = 1, decay: float | None = None) -> DataFrame:
    """keys, week_end, horizon, n_fit, forecast_<column>, s_<i><j>: iterated forecasts, and the covariance of their errors, of an
    autoregression of the columns with a constant, fitted on all rows up to each week.

    decay: weights falling by this factor a row. One column: a scalar autoregression; several: a vector one. All weeks come
    from one pass of running sums; weeks with fewer rows than coefficients + 2 have none. Rows are complete, or left out.
    """
    horizons = tuple(sorted(int(h) for h in horizons))
    known = rows.where(" and ".join(f"{c} is not null" for c in columns))
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("week_end")
    centred = known.select(*keys, "week_end", F.row_number().over(order).alias("place"), *[F.avg(c).over(whole).alias(f"mean_{c}") for c in columns], *[(F.col(c) - F.avg(c).over(whole)).alias(c) for c in columns])
    past = centred.select("*", *[F.lag(c, k).over(order).alias(f"{c}__{k}") for k in range(1, lags + 1) for c in columns]).where(F.col("place") > lags)
    z = [F.lit(1.0), *[F.col(f"{c}__{k}") for k in range(1, lags + 1) for c in columns], *[F.col(c) for c in columns]]
    weight = F.lit(1.0) if decay in (None, 1.0) else F.pow(F.lit(1.0 / decay), F.col("place"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = F.array(*[F.sum(weight * z[i] * z[j]).over(upto) for i in range(len(z)) for j in range(i, len(z))])
    last = F.array(*[F.col(c if k == 0 else f"{c}__{k}") for k in range(lags) for c in columns])
    fitted = past.select(*keys, "week_end", F.count(F.lit(1)).over(upto).alias("n_fit"), sums.alias("sums"), F.sum(weight).over(upto).alias("weight"), last.alias("last"), *[f"mean_{c}" for c in columns])
    fitted = fitted.where(F.col("n_fit") >= 3 + len(columns) * lags)
    walked = fitted.withColumn("x", _paths(len(columns), lags, horizons)("sums", "weight", "last"))
    cells = F.arrays_zip(F.array(*[F.lit(h) for h in horizons]).alias("horizon"), F.col("x.forecast").alias("forecast"), F.col("x.covariance").alias("covariance"))
    told = walked.withColumn("c", F.explode(cells))
    m = len(columns)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    return told.select(
        *keys, "week_end", "c.horizon", "n_fit", *[(F.col("c.forecast")[i] + F.col(f"mean_{c}")).alias(f"forecast_{c}") for i, c in enumerate(columns)], *[F.col("c.covariance")[q].alias(f"s_{i}{j}") for q, (i, j) in enumerate(pairs)]
    )
