"""Curve factors: least-squares fits of log prices on loadings, grids over the decay, regimes.

Fits in long form are sums: each (week, decay) needs nine sums over its maturities, solved by
cofactors in a column expression, so missing maturities need no special care and a grid of
decays is one aggregation over panel x broadcast loadings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from termforge.functions.columns import loadings, log_price, regime


def loading_table(spark: SparkSession, maturities, decays) -> DataFrame:
    """(decay, maturity, s, c): a few numbers per grid point; its size is that of the grid."""
    rows = [(float(d), int(m), *loadings(m, d)[1:]) for d in decays for m in maturities]
    return spark.createDataFrame(rows, "decay double, maturity int, s double, c double")


def _solve() -> list[Column]:
    """beta0..2 from the sums n, s, c, ss, sc, cc, y, sy, cy (columns), by cofactors."""
    n, s, c, ss, sc, cc, y, sy, cy = map(F.col, ("n", "s", "c", "ss", "sc", "cc", "y", "sy", "cy"))
    a, b, d = ss * cc - sc * sc, s * cc - sc * c, s * sc - ss * c
    det = n * a - s * b + c * d
    b0 = (y * a - s * (sy * cc - sc * cy) + c * (sy * sc - ss * cy)) / det
    b1 = (n * (sy * cc - sc * cy) - y * b + c * (s * cy - sy * c)) / det
    b2 = (n * (ss * cy - sy * sc) - s * (s * cy - sy * c) + y * d) / det
    return [b0.alias("beta0"), b1.alias("beta1"), b2.alias("beta2")]


def fit_factors(panel: DataFrame, grid: DataFrame, least: int = 3) -> DataFrame:
    """(decay, week_end, n_maturities, beta0..2, rmse) for each decay of a grid; null below `least` maturities.

    rmse is in logs and divides by the number of maturities present.
    """
    rows = panel.where("price > 0").join(F.broadcast(grid), "maturity").withColumn("y", F.log("price"))
    key = ["decay", "week_end"]
    sums = rows.groupBy(*key).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(F.expr(e)).alias(a) for a, e in (("s", "s"), ("c", "c"), ("ss", "s*s"), ("sc", "s*c"), ("cc", "c*c"), ("y", "y"), ("sy", "s*y"), ("cy", "c*y"))],
    )
    solved = sums.select(*key, F.col("n").cast("int").alias("n_maturities"), *[F.when(F.col("n") >= least, b).alias(f"beta{i}") for i, b in enumerate(_solve())])
    error = F.col("y") - (F.col("beta0") + F.col("s") * F.col("beta1") + F.col("c") * F.col("beta2"))
    rmse = rows.join(solved, key).groupBy(*key).agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    return solved.join(rmse, key)


def factors(panel: DataFrame, maturities, decay: float) -> DataFrame:
    """Factors at one decay: (week_end, beta0, beta1, beta2, rmse, decay)."""
    grid = loading_table(panel.sparkSession, maturities, [decay])
    return fit_factors(panel, grid).select("week_end", "beta0", "beta1", "beta2", "rmse", "decay", "n_maturities")


def grid_rmse(panel: DataFrame, maturities, decays) -> DataFrame:
    """Mean rmse over weeks for each decay."""
    fits = fit_factors(panel, loading_table(panel.sparkSession, maturities, decays))
    return fits.where("beta0 is not null").groupBy("decay").agg(F.avg("rmse").alias("mean_rmse"), F.count(F.lit(1)).alias("n_weeks"))


def best_decay(grid: DataFrame) -> DataFrame:
    """The row of least mean rmse; of equals, the least decay."""
    return grid.agg(F.min_by("decay", F.struct("mean_rmse", "decay")).alias("decay"), F.min("mean_rmse").alias("mean_rmse"))


def grid_agreement(panel: DataFrame, maturities, decays) -> DataFrame:
    """Share of weeks in which the slope factor has the sign of front minus far price; ties are left out."""
    fits = fit_factors(panel, loading_table(panel.sparkSession, maturities, decays))
    near, far = min(maturities), max(maturities)
    ends = panel.groupBy("week_end").agg(
        F.max(F.when(F.col("maturity") == near, F.col("price"))).alias("front"), F.max(F.when(F.col("maturity") == far, F.col("price"))).alias("back")
    )
    truth = ends.where("front is not null and back is not null and front <> back").select("week_end", F.signum(F.col("front") - F.col("back")).alias("truth"))
    agree = (F.signum("beta1") == F.col("truth")).cast("int")
    return fits.where("beta1 is not null").join(truth, "week_end").groupBy("decay").agg(
        (100.0 * F.avg(agree)).alias("agreement_pct"), F.count(F.lit(1)).alias("n_weeks")
    )


def chosen_decay(grid: DataFrame, edge: float = 1e-6, flat: float = 1e-4) -> DataFrame:
    """decay, chosen_by, by_rmse, by_agreement, spread: choose_decay within the plan, of grid (decay, mean_rmse, agreement_pct); one row, none for an empty grid."""
    best = grid.agg(
        F.min("decay").alias("lo"), F.max("decay").alias("hi"), (F.max("mean_rmse") - F.min("mean_rmse")).alias("spread"),
        F.min_by("decay", F.struct("mean_rmse", "decay")).alias("by_rmse"), F.min_by("decay", F.struct(-F.col("agreement_pct"), F.col("decay"))).alias("by_agreement"),
    ).where("lo is not null")
    unsure = (F.least(F.abs(F.col("by_rmse") - F.col("lo")), F.abs(F.col("by_rmse") - F.col("hi"))) <= edge) | (F.col("spread") < flat)
    return best.select(F.when(unsure, F.col("by_agreement")).otherwise(F.col("by_rmse")).alias("decay"), F.when(unsure, "agreement").otherwise("rmse").alias("chosen_by"), "by_rmse", "by_agreement", "spread")


def choose_decay(rmse_rows: list, agreement_rows: list, edge: float = 1e-6, flat: float = 1e-4) -> tuple[float, str]:
    """Least-rmse decay, or that of best agreement where the former is at the grid's edge or the curve is flat.

    Takes the collected rows of a decay grid, whose number is the grid's.
    """
    by_rmse = sorted((r["mean_rmse"], r["decay"]) for r in rmse_rows)
    decays = [r["decay"] for r in rmse_rows]
    best = by_rmse[0][1]
    at_edge = min(abs(best - min(decays)), abs(best - max(decays))) <= edge
    if at_edge or by_rmse[-1][0] - by_rmse[0][0] < flat:
        return max(agreement_rows, key=lambda r: (r["agreement_pct"], -r["decay"]))["decay"], "agreement"
    return best, "rmse"


def fixed_design(maturities, decays) -> np.ndarray:
    """Design matrix of three (one decay) or four (two decays) factors."""
    return np.array([[*loadings(m, decays[0]), *[loadings(m, d)[2] for d in decays[1:]]] for m in maturities])


def fit_wide(wide: DataFrame, maturities, decays, log: bool = True, prefix: str = "m") -> DataFrame:
    """Fit complete weeks by the constant projection matrix: (week_end, beta0.., rmse, r2, aic), in price units.

    With every maturity present the fit is one fixed linear map of the prices, so it is a
    plain projection of columns. Raises where the design has not full rank.
    """
    design = fixed_design(maturities, decays)
    if np.linalg.matrix_rank(design) < design.shape[1]:
        raise ValueError("the loadings are linearly dependent")
    solve = np.linalg.pinv(design)
    price = [F.col(f"{prefix}{m:02d}") for m in maturities]
    y = [F.log(p) if log else p for p in price]

    def dot(weights, columns):
        return sum((F.lit(float(w)) * c for w, c in zip(weights, columns)), F.lit(0.0))

    out = wide.na.drop(subset=[f"{prefix}{m:02d}" for m in maturities])
    out = out.select("*", *[dot(row, y).alias(f"beta{i}") for i, row in enumerate(solve)])
    betas = [F.col(f"beta{i}") for i in range(len(solve))]
    fitted = [dot(row, betas) for row in design]
    fitted = [F.exp(f) for f in fitted] if log else fitted
    rss = sum(((p - f) ** 2 for p, f in zip(price, fitted)), F.lit(0.0))
    mean = sum(price, F.lit(0.0)) / len(price)
    tss = sum(((p - mean) ** 2 for p in price), F.lit(0.0))
    n, k = len(price), design.shape[1] + len(decays)
    return out.select(
        "week_end", *betas, F.sqrt(rss / n).alias("rmse"), (1 - rss / F.nullif(tss, F.lit(0.0))).alias("r2"), (2 * k + n * F.log(rss / n)).alias("aic")
    )


def fit_metrics(fits: DataFrame) -> DataFrame:
    """Mean, median and greatest rmse, its week, mean r2 and aic, share of weeks above the 95th percentile."""
    limit = fits.agg(F.percentile("rmse", F.lit(0.95)).alias("p95"))
    return fits.join(F.broadcast(limit)).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.avg("rmse").alias("mean_rmse"),
        F.percentile("rmse", F.lit(0.5)).alias("median_rmse"),
        F.max("rmse").alias("max_rmse"),
        F.max_by("week_end", F.struct("rmse", "week_end")).alias("worst_week"),
        F.avg("r2").alias("mean_r2"),
        F.avg("aic").alias("mean_aic"),
        (100.0 * F.avg((F.col("rmse") > F.col("p95")).cast("int"))).alias("pct_flagged"),
    )


def compare_fits(named: dict[str, DataFrame], base: str) -> DataFrame:
    """Metrics of several fits with the improvement of mean rmse over a base, best first."""
    parts = [fit_metrics(f).withColumn("model", F.lit(name)) for name, f in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    reference = out.where(F.col("model") == base).select(F.col("mean_rmse").alias("base_rmse"))
    better = 100.0 * (F.col("base_rmse") - F.col("mean_rmse")) / F.col("base_rmse")
    return out.join(F.broadcast(reference)).select("model", "n_weeks", "mean_rmse", "median_rmse", "max_rmse", "mean_r2", "mean_aic", "pct_flagged", better.alias("improvement_pct"))


def two_decay_grid(first, second, least_gap: float = 1.5) -> list[tuple[float, float]]:
    """Decay pairs far enough apart for four independent loadings."""
    return [(float(a), float(b)) for a in first for b in second if abs(a - b) >= least_gap]


def search_two_decays(wide: DataFrame, maturities, pairs, log: bool = True) -> DataFrame:
    """Mean rmse (log or price) for each decay pair, over complete weeks; one pass, all pairs as columns."""
    cells = [F.col(f"m{m:02d}") for m in maturities]
    y = [F.log(c) if log else c for c in cells]
    rows = wide.na.drop(subset=[f"m{m:02d}" for m in maturities]).select(F.array(*y).alias("y"))
    usable, residual = [], []
    for pair in pairs:
        x = fixed_design(maturities, pair)
        if np.linalg.matrix_rank(x) == 4:
            usable.append(pair)
            residual.append(np.eye(len(maturities)) - x @ np.linalg.pinv(x))
    grid = rows.sparkSession.createDataFrame(
        [(a, b, [[float(v) for v in r] for r in m]) for (a, b), m in zip(usable, residual)], "decay1 double, decay2 double, m array<array<double>>"
    )
    def dot(row):
        return F.aggregate(F.zip_with(row, F.col("y"), lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)

    rss = F.aggregate(F.transform("m", lambda r: dot(r) * dot(r)), F.lit(0.0), lambda t, v: t + v)
    per_week = rows.join(F.broadcast(grid)).select("decay1", "decay2", F.sqrt(rss / len(maturities)).alias("rmse"))
    return per_week.groupBy("decay1", "decay2").agg(F.avg("rmse").alias("mean_rmse"))


def fit_gate(fits: DataFrame, panel: DataFrame, mean_limit: float = 0.02, share_limit: float = 0.05, week_limit: float = 0.05) -> DataFrame:
    """Whether fits pass in price space: mean relative rmse, and share of weeks above week_limit."""
    level = panel.groupBy("week_end").agg(F.avg("price").alias("mean_price"))
    relative = fits.join(level, "week_end").select((F.col("rmse") / F.col("mean_price")).alias("r"))
    gate = relative.agg(F.avg("r").alias("mean_relative_rmse"), F.avg((F.col("r") > week_limit).cast("int")).alias("share_over"))
    return gate.withColumn("passed", (F.col("mean_relative_rmse") < mean_limit) & (F.col("share_over") <= share_limit))


def seasonal_z(fact: DataFrame, train_end, column: str = "beta1") -> DataFrame:
    """z-score against the training mean and spread of the same ISO week; spread null or zero gives 0, no such week null."""
    rows = fact.withColumn("week_number", F.weekofyear("week_end"))
    base = rows.where(F.col("week_end") <= F.lit(train_end)).groupBy("week_number").agg(F.avg(column).alias("mu"), F.stddev_samp(column).alias("sd"))
    z = F.when(F.col("mu").isNull(), None).otherwise(F.when(F.col("sd") > 0, (F.col(column) - F.col("mu")) / F.col("sd")).otherwise(0.0))
    return rows.join(F.broadcast(base), "week_number", "left").select("week_end", "week_number", column, z.alias(f"{column}_zscore"))


def regimes(fact: DataFrame, train_end, threshold: float = 0.0) -> DataFrame:
    """week_end, week_number, beta1, beta1_zscore, regime (of the raw slope)."""
    return seasonal_z(fact, train_end).withColumn("regime", regime(F.col("beta1"), threshold))


def rebuild(fact: DataFrame, maturities, decay: float) -> DataFrame:
    """(week_end, maturity, fitted): the price curve of each week's factors."""
    cells = [F.struct(F.lit(int(m)).alias("maturity"), F.exp(log_price(m, decay)).alias("fitted")) for m in maturities]
    return fact.select("week_end", F.explode(F.array(*cells)).alias("x")).select("week_end", "x.*")


def representative_weeks(fact: DataFrame) -> DataFrame:
    """The weeks of greatest, least and nearest-to-zero slope."""
    pick = fact.agg(
        F.max_by("week_end", F.struct("beta1", "week_end")).alias("steepest"),
        F.min_by("week_end", F.struct("beta1", "week_end")).alias("most_inverted"),
        F.min_by("week_end", F.struct(F.abs("beta1"), "week_end")).alias("flattest"),
    )
    return pick.unpivot([], ["steepest", "most_inverted", "flattest"], "kind", "week_end")
