"""Statistical tests over many series: each (series, ...) key is one group, tests run in NumPy per group.

Series are weekly, so a group is a few thousand numbers however large the tables behind.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from termforge.functions import linear
from termforge.functions.columns import chi2_log_tail, stars, stationarity_verdict
from termforge.functions.special import chi2_sf, f_sf


def _values(g: pd.DataFrame, column: str = "value") -> np.ndarray:
    return g.sort_values("week_end")[column].dropna().to_numpy(float)


def stationarity(series: DataFrame, key: str = "series", least: int = 30) -> DataFrame:
    """series, adf_stat, adf_p, adf_lags, kpss_stat, kpss_p, kpss_lags, verdict of (week_end, series, value)."""

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        y = _values(g)
        if len(y) < least or np.ptp(y) == 0:
            return pd.DataFrame([[k[0], None, None, None, None, None, None]], columns=cols)
        return pd.DataFrame([[k[0], *linear.adf(y), *linear.kpss(y)]], columns=cols)

    cols = [key, "adf_stat", "adf_p", "adf_lags", "kpss_stat", "kpss_p", "kpss_lags"]
    out = series.select("week_end", key, "value").groupBy(key).applyInPandas(
        run, f"{key} string, adf_stat double, adf_p double, adf_lags int, kpss_stat double, kpss_p double, kpss_lags int"
    )
    return out.withColumn("verdict", F.when(F.col("adf_p").isNull(), "UNDEFINED").otherwise(stationarity_verdict(F.col("adf_p"), F.col("kpss_p"))))


def granger_tests(pairs: DataFrame, max_lag: int = 4) -> DataFrame:
    """cause, effect, lag, f_stat, f_p, chi2_stat, chi2_p, n of (week_end, cause, effect, x, y), complete rows only."""

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=["x", "y"]).sort_values("week_end")
        x, y = g["x"].to_numpy(float), g["y"].to_numpy(float)
        return pd.DataFrame([[*k, lag, *linear.granger(y, x, lag), len(y)] for lag in range(1, max_lag + 1)], columns=cols)

    cols = ["cause", "effect", "lag", "f_stat", "f_p", "chi2_stat", "chi2_p", "n"]
    return pairs.groupBy("cause", "effect").applyInPandas(
        run, "cause string, effect string, lag int, f_stat double, f_p double, chi2_stat double, chi2_p double, n long"
    )


def granger_halves(pairs: DataFrame, max_lag: int = 4) -> DataFrame:
    """granger_tests on both halves of the sample; the middle row belongs to both."""
    weeks = pairs.select("week_end").distinct()
    middle = weeks.agg(F.percentile_disc("week_end").alias("m")) if hasattr(F, "percentile_disc") else weeks.agg(F.expr("percentile_disc(0.5) within group (order by unix_date(week_end))").alias("m"))
    rows = pairs.join(F.broadcast(middle))
    first = granger_tests(rows.where("unix_date(week_end) <= m").drop("m"), max_lag).withColumn("half", F.lit("first"))
    second = granger_tests(rows.where("unix_date(week_end) >= m").drop("m"), max_lag).withColumn("half", F.lit("second"))
    return first.unionByName(second)


def screening(tests: DataFrame) -> DataFrame:
    """For each cause and effect the lag of least chi-square p, its marks, and whether to include the cause."""
    best = tests.groupBy("cause", "effect").agg(F.min("chi2_p").alias("p"), F.min_by("lag", F.struct("chi2_p", "lag")).alias("best_lag"))
    return best.withColumn("sig", stars(F.col("p"))).withColumn("verdict", F.when(F.col("p") < 0.05, "include").otherwise("exclude"))


def best_transform(screen: DataFrame) -> DataFrame:
    """For each variable and effect the transform of least p; `cause` is variable:transform."""
    rows = screen.withColumn("variable", F.split("cause", ":")[0]).withColumn("transform", F.split("cause", ":")[1])
    return rows.groupBy("variable", "effect").agg(F.min_by("transform", F.struct("p", "transform")).alias("best_transform"), F.min("p").alias("p"))


def _partial(lags: int):
    """A column function: the upper triangle of the Gram matrix of (1, lags of y, lags of x, target) to what the projection test needs.

    coef: of each lag of x and of the target on a constant and the lags of y; beta: of the target on what is
    left of the lags of x; cross: what is left of the products of the lags of x with the target.
    """
    k = 1 + lags
    upper = np.triu_indices(k + lags + 1)

    @F.pandas_udf("coef array<array<double>>, beta array<double>, cross array<double>")
    def solve(sums: pd.Series) -> pd.DataFrame:
        out = []
        for row in sums:
            gram = np.zeros((k + lags + 1,) * 2)
            gram[upper] = row
            gram.T[upper] = row
            unit = np.sqrt(np.maximum(np.diag(gram), 1e-300))
            gram = gram / unit[:, None] / unit[None, :]
            coef = np.linalg.pinv(gram[:k, :k], rcond=1e-12, hermitian=True) @ gram[:k, k:]
            left = gram[k:, k:] - gram[k:, :k] @ coef
            beta = np.linalg.pinv(left[:-1, :-1], rcond=1e-10, hermitian=True) @ left[:-1, -1]
            out.append([(coef / unit[:k, None] * unit[k:]).T.tolist(), (beta / unit[k:-1] * unit[-1]).tolist(), (left[:-1, -1] * unit[k:-1] * unit[-1]).tolist()])
        return pd.DataFrame(out, columns=["coef", "beta", "cross"])

    return solve


@F.pandas_udf(DoubleType())
def _quadratic(cross: pd.Series, meat: pd.Series) -> pd.Series:
    """g' M^-1 g, with M as the rows of a square matrix."""
    out = []
    for g, m in zip(cross, meat):
        m = np.reshape(m, (len(g), len(g)))
        unit = np.sqrt(np.maximum(np.diag(m), 1e-300))
        out.append(float((g / unit) @ np.linalg.pinv(m / unit[:, None] / unit[None, :], rcond=1e-10, hermitian=True) @ (g / unit)))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def _f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([f_sf(*map(float, v)) if v[0] == v[0] else None for v in zip(f, df1, df2)], dtype="float64")


def projection_tests(pairs: DataFrame, horizons, lags: int = 2) -> DataFrame:
    """cause, effect, horizon, wald_f, p_value, n, sig: do lags of x help predict y `horizon` rows ahead, with Newey-West errors.

    All causes, effects and horizons in one plan. Series are centred and scaled, so that level and unit change
    nothing. One aggregation gives each key's Gram matrix; it takes the constant and the lags of y out of the lags of x
    and of the target. The weighted products of the scores up to max(horizon, lags) rows apart come from two running sums over
    such a frame, of the scores and of the scores times their place: sum (W + 1 - l) s[t - l] = (W + 1 - t) sum s + sum t s.
    Fewer than 2 * (2 * lags + 1) rows, or constant columns: wald_f and p_value are null.
    """
    keys = ["cause", "effect", "horizon"]
    whole = Window.partitionBy("cause", "effect")
    known = pairs.where("x is not null and y is not null").select("cause", "effect", "week_end", "x", "y")
    unit = lambda c: (F.col(c) - F.avg(c).over(whole)) / F.nullif(F.stddev_pop(c).over(whole), F.lit(0.0))
    known = known.select("cause", "effect", "week_end", unit("x").alias("x"), unit("y").alias("y"))
    along = whole.orderBy("week_end")
    past = [F.lag(c, k).over(along).alias(f"{c}{k}") for c in ("y", "x") for k in range(lags)]
    ahead = F.array(*[F.struct(F.lit(int(h)).alias("horizon"), F.lead("y", int(h)).over(along).alias("t")) for h in horizons])
    rows = known.select("cause", "effect", F.row_number().over(along).alias("place"), *past, ahead.alias("h")).where(F.col("place") >= lags)
    rows = rows.withColumn("h", F.explode("h")).select(*rows.columns[:-1], "h.*").where("t is not null")
    ys, xs = [f"y{k}" for k in range(lags)], [f"x{k}" for k in range(lags)]
    z = [F.lit(1.0), *[F.col(c) for c in (*ys, *xs, "t")]]
    grams = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]).alias("g"))
    fits = grams.where(~F.exists("g", F.isnull)).withColumn("f", _partial(lags)("g")).select(*keys, "n", "f.*")
    joined = rows.join(fits, keys)
    left = lambda c, i: F.col(c) - F.col("coef")[i][0] - sum((F.col("coef")[i][1 + k] * F.col(y) for k, y in enumerate(ys)), F.lit(0.0))
    joined = joined.select(*keys, "place", "n", "beta", "cross", *[left(x, i).alias(x) for i, x in enumerate(xs)], left("t", lags).alias("t"))
    error = F.col("t") - sum((F.col("beta")[i] * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    scored = joined.select(*keys, "place", "n", "cross", *[(F.col(x) * error).alias(f"s{i}") for i, x in enumerate(xs)])
    order = Window.partitionBy(*keys).orderBy("place")
    recent = {h: max(int(h), lags) for h in horizons}

    def before(i: int) -> Column:
        """Bartlett-weighted sum of the earlier scores i."""
        out = F.lit(0.0)
        for width in sorted(set(recent.values())):
            frame = order.rowsBetween(-width, -1)
            part = ((width + 1 - F.col("place")) * F.coalesce(F.sum(f"s{i}").over(frame), F.lit(0.0)) + F.coalesce(F.sum(F.col("place") * F.col(f"s{i}")).over(frame), F.lit(0.0))) / (width + 1)
            out = F.when(F.col("horizon").isin([int(h) for h in horizons if recent[h] == width]), part).otherwise(out)
        return out

    weighted = scored.select("*", *[before(i).alias(f"b{i}") for i in range(lags)])
    cell = lambda i, j: F.sum(F.col(f"s{i}") * F.col(f"s{j}") + F.col(f"s{i}") * F.col(f"b{j}") + F.col(f"b{i}") * F.col(f"s{j}"))
    meat = weighted.groupBy(*keys).agg(F.first("n").alias("n"), F.first("cross").alias("cross"), F.array(*[cell(i, j) for i in range(lags) for j in range(lags)]).alias("meat"))
    free = F.col("n") - (2 * lags + 1)
    tested = meat.where(F.col("n") >= 2 * (2 * lags + 1)).select(*keys, (_quadratic("cross", "meat") * free / F.col("n") / lags).alias("wald_f"))
    out = grams.select(*keys, "n").join(tested, keys, "left")
    return out.select(*keys, "wald_f", _f_tail("wald_f", F.lit(float(lags)), free.cast("double")).alias("p_value"), F.col("n").cast("long").alias("n")).withColumn("sig", stars(F.col("p_value")))


def signal_pattern(tests: DataFrame, short: int = 4) -> DataFrame:
    """For each cause and effect: at which horizons it is significant at 5 per cent, short, long, both or none."""
    hit = F.col("p_value") < 0.05
    rows = tests.groupBy("cause", "effect").agg(
        F.sum((hit & (F.col("horizon") <= short)).cast("int")).alias("short_hits"), F.sum((hit & (F.col("horizon") > short)).cast("int")).alias("long_hits"),
        F.min_by("horizon", F.struct("p_value", "horizon")).alias("best_horizon"),
    )
    s, l = F.col("short_hits") > 0, F.col("long_hits") > 0
    return rows.withColumn("pattern", F.when(s & l, "persistent").when(s, "short").when(l, "long").otherwise("none"))


def diagnostics(residuals: DataFrame, key: str = "series", lags: int = 10) -> DataFrame:
    """series, lb_min_p, arch_stat, arch_p, jb_stat, jb_p, skew, kurtosis of (week_end, series, value)."""

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        e = _values(g)
        lb = min(p for _, _, p in linear.ljung_box(e, lags))
        return pd.DataFrame([[k[0], lb, *linear.arch_test(e), *linear.jarque_bera(e)]], columns=cols)

    cols = [key, "lb_min_p", "arch_stat", "arch_p", "jb_stat", "jb_p", "skew", "kurtosis"]
    return residuals.select("week_end", key, "value").groupBy(key).applyInPandas(run, f"{key} string, " + ", ".join(f"{c} double" for c in cols[1:]))


def autocorrelations(series: DataFrame, value: str, lags: int = 40) -> DataFrame:
    """lag, acf, band (1.96 / sqrt(n)) of one weekly series, as lagged products of columns."""
    centred = series.where(F.col(value).isNotNull()).select("week_end", (F.col(value) - F.avg(value).over(Window.partitionBy())).alias("e"))
    w = Window.orderBy("week_end")
    sums = centred.select("e", *[(F.col("e") * F.lag("e", k).over(w)).alias(f"p{k}") for k in range(1, lags + 1)])
    one = sums.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("v"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, lags + 1)])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"p{k}") / F.col("v")).alias("acf")) for k in range(1, lags + 1)])
    return one.select((1.96 / F.sqrt("n")).alias("band"), F.explode(cells).alias("x")).select("x.lag", "x.acf", "band")


def jarque_bera_table(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Jarque-Bera statistic, skewness and excess kurtosis from built-in aggregates; any number of rows."""
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"))
    return out.withColumn("jb_stat", F.col("n") / 6.0 * (F.col("skew") ** 2 + F.col("kurtosis") ** 2 / 4.0))


def inflation(table: DataFrame, columns: list[str], centred: bool = False) -> DataFrame:
    """variable, vif of the columns: the diagonal of the matrix of their cross products times that of its inverse.

    One aggregation of any number of rows, and a k x k inverse in an Arrow batch; nothing passes through the driver. Without
    `centred` the fits have no constant.
    """
    k = len(columns)
    upper = np.triu_indices(k)

    @F.pandas_udf("array<double>")
    def diagonal(products: pd.Series, sums: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for p, s, count in zip(products, sums, n):
            gram = np.zeros((k, k))
            gram[upper] = p
            gram.T[upper] = p
            if centred:
                gram = gram - np.outer(s, s) / count
            unit = np.sqrt(np.maximum(np.diag(gram), 1e-300))
            gram = gram / unit[:, None] / unit[None, :]
            out.append((np.diag(np.linalg.pinv(gram, hermitian=True)) * np.diag(gram)).tolist())
        return pd.Series(out)

    products = F.array(*[F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(k) for j in range(i, k)])
    one = table.na.drop(subset=columns).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c).cast("double") for c in columns]).alias("s"), products.alias("p")).where("n > 0")
    told = one.select(F.posexplode(diagonal("p", "s", "n")).alias("i", "vif"))
    return told.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1).alias("variable"), "vif")


def ljung_box_tails(rows: DataFrame, keys: list[str], order: str, value: str, lags: int = 10) -> DataFrame:
    """keys, n, q, log10_p of each key's series: the Ljung-Box statistic and the decimal logarithm of its tail, finite however large it is."""
    whole = Window.partitionBy(*keys)
    centred = rows.where(F.col(value).isNotNull()).select(*keys, order, (F.col(value) - F.avg(value).over(whole)).alias("e"))
    w = whole.orderBy(order)
    lagged = centred.select(*keys, "e", *[(F.col("e") * F.lag("e", k).over(w)).alias(f"c{k}") for k in range(1, lags + 1)])
    sums = lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("v"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(1, lags + 1)])
    q = F.col("n") * (F.col("n") + 2) * sum((F.pow(F.col(f"c{k}") / F.col("v"), 2) / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    told = sums.where((F.col("v") > 0) & (F.col("n") > lags)).select(*keys, "n", q.alias("q"))
    return told.withColumn("log10_p", chi2_log_tail(F.col("q"), F.lit(lags)) / math.log(10.0))


def _autoregression(size: int, m: int):
    """A column function: the upper triangle of the Gram matrix of `size` regressors and m targets to coef (a row a target) and log_det of the residuals' covariance."""
    upper = np.triu_indices(size + m)

    @F.pandas_udf("coef array<array<double>>, log_det double")
    def solve(sums: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for row, count in zip(sums, n):
            gram = np.zeros((size + m,) * 2)
            gram[upper] = row
            gram.T[upper] = row
            unit = np.sqrt(np.maximum(np.diag(gram), 1e-300))
            unit[np.diag(gram) == 0] = 1.0  # lags beyond the order are columns of zeros
            gram = gram / unit[:, None] / unit[None, :]
            coef = np.linalg.pinv(gram[:size, :size], rcond=1e-12, hermitian=True) @ gram[:size, size:]
            left = gram[size:, size:] - gram[size:, :size] @ coef
            out.append([(coef / unit[:size, None] * unit[size:]).T.tolist(), float(np.linalg.slogdet(left / count)[1] + 2 * np.log(unit[size:]).sum())])
        return pd.DataFrame(out, columns=["coef", "log_det"])

    return solve


def _lagged_rows(table: DataFrame, columns: list[str], max_lag: int, common: bool) -> DataFrame:
    """p, place, z (1, lags 1 to max_lag of the columns, zeros beyond p), y (the columns), for orders p of 1 to max_lag.

    common: all orders on the rows that the longest has. Columns are centred and scaled by one aggregation.
    """
    known = table.where(" and ".join(f"{c} is not null" for c in columns))
    units = known.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    scaled = known.join(F.broadcast(units)).select("week_end", *[((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)).alias(c) for c in columns])
    w = Window.orderBy("week_end")
    past = [F.lag(c, k).over(w).alias(f"{c}__{k}") for k in range(1, max_lag + 1) for c in columns]
    rows = scaled.select(F.row_number().over(w).alias("place"), F.array(*columns).alias("y"), *past)
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).where(F.col("place") > (F.lit(max_lag) if common else F.col("p")))
    lags = [F.when(F.col("p") >= k, F.col(f"{c}__{k}")).otherwise(0.0) for k in range(1, max_lag + 1) for c in columns]
    return rows.select("p", "place", F.array(F.lit(1.0), *lags).alias("z"), "y")


def _autoregressions(rows: DataFrame, size: int, m: int) -> DataFrame:
    """p, n, coef, log_det, aic, bic, hq of every order, from one aggregation of the products of its rows."""
    x = [*[F.col("z")[i] for i in range(size)], *[F.col("y")[i] for i in range(m)]]
    grams = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x[i] * x[j]) for i in range(size + m) for j in range(i, size + m)]).alias("g"))
    fits = grams.withColumn("f", _autoregression(size, m)("g", "n")).select("p", "n", "f.*")
    k, n = F.lit(m) * (1 + F.lit(m) * F.col("p")), F.col("n")
    return fits.withColumns({"aic": F.col("log_det") + 2 * k / n, "bic": F.col("log_det") + F.log(n) * k / n, "hq": F.col("log_det") + 2 * F.log(F.log(n)) * k / n})


def select_lag(table: DataFrame, columns: list[str], max_lag: int = 4) -> DataFrame:
    """p, aic, bic, hq of vector autoregressions on a common sample; chosen marks the order (least BIC).

    All orders come from one aggregation of products; their number doesn't grow with the rows. Values are those of the
    centred columns divided by their deviations, plus the logarithms of these, as if fitted on the columns.
    """
    m = len(columns)
    fits = _autoregressions(_lagged_rows(table, columns, max_lag, True), 1 + m * max_lag, m)
    spread = table.where(" and ".join(f"{c} is not null" for c in columns)).agg(sum((2 * F.log(F.stddev_pop(c)) for c in columns), F.lit(0.0)).alias("spread"))
    fits = fits.join(F.broadcast(spread))
    told = fits.select("p", *[(F.col(c) + F.col("spread")).alias(c) for c in ("aic", "bic", "hq")])
    best = told.agg(F.min_by("p", F.struct("bic", "p")).alias("best"))
    return told.join(F.broadcast(best)).select("p", "aic", "bic", "hq", (F.col("p") == F.col("best")).alias("chosen"))


@F.pandas_udf(DoubleType())
def _chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(a), int(b)) if a == a else None for a, b in zip(x, df)], dtype="float64")


def lag_robustness(table: DataFrame, columns: list[str], max_lag: int = 8, difference_first: bool = False) -> DataFrame:
    """p, aic, bic, n_failures, worst_series, min_p: for each order of vector autoregression, on its own rows, how many residual
    series fail a Ljung-Box test at 5 per cent at any of 1 to 2p lags, and which has the least p.

    difference_first: take first differences of the first column. Residuals are columns, their autocorrelations
    sums of lagged products by (order, series).
    """
    if difference_first:
        known = table.where(" and ".join(f"{c} is not null" for c in columns))
        table = known.withColumn(columns[0], F.col(columns[0]) - F.lag(columns[0]).over(Window.orderBy("week_end")))
    m = len(columns)
    size = 1 + m * max_lag
    rows = _lagged_rows(table, columns, max_lag, False)
    fits = _autoregressions(rows, size, m)
    product = lambda i: F.aggregate(F.zip_with("z", F.col("coef")[i], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    errors = F.array(*[F.struct(F.lit(c).alias("series"), (F.col("y")[i] - product(i)).alias("e")) for i, c in enumerate(columns)])
    # One row an order: `fits` has max_lag rows.
    residuals = rows.join(F.broadcast(fits.select("p", "coef")), "p").select("p", "place", F.explode(errors).alias("x")).select("p", "place", "x.*")
    w = Window.partitionBy("p", "series").orderBy("place")
    lagged = residuals.select("p", "series", "e", *[(F.col("e") * F.lag("e", k).over(w)).alias(f"c{k}") for k in range(1, 2 * max_lag + 1)])
    sums = lagged.groupBy("p", "series").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("v"), F.array(*[F.sum(f"c{k}") for k in range(1, 2 * max_lag + 1)]).alias("c"))
    cells = sums.select("p", "series", "n", "v", F.posexplode(F.slice("c", F.lit(1), 2 * F.col("p"))).alias("i", "c")).withColumn("lag", F.col("i") + 1)
    share = F.pow(F.col("c") / F.col("v"), 2) / (F.col("n") - F.col("lag"))
    q = F.col("n") * (F.col("n") + 2) * F.sum(share).over(Window.partitionBy("p", "series").orderBy("lag"))
    tested = cells.withColumn("q", q).withColumn("tail", _chi2_tail("q", "lag")).groupBy("p", "series").agg(F.min("tail").alias("tail"))
    worst = tested.groupBy("p").agg(F.sum((F.col("tail") < 0.05).cast("int")).cast("int").alias("n_failures"), F.min(F.struct("tail", "series")).alias("w"))
    # Criteria of the columns themselves, not of the scaled ones.
    known = table.where(" and ".join(f"{c} is not null" for c in columns))
    spread = known.agg(sum((2 * F.log(F.stddev_pop(c)) for c in columns), F.lit(0.0)).alias("spread"))
    out = fits.join(worst, "p").join(F.broadcast(spread))
    return out.select("p", (F.col("aic") + F.col("spread")).alias("aic"), (F.col("bic") + F.col("spread")).alias("bic"), "n_failures", F.col("w.series").alias("worst_series"), F.col("w.tail").alias("min_p"))


#: Transforms in the order in which a specification tries them: levels, deviation from the past year, differences over growing windows.
TREE = ("level", "z52W", "d1W", "d4W", "d13W", "d26W")


def specification(transforms: DataFrame, order: tuple[str, ...] = TREE, alpha: float = 0.05, least: int = 30) -> DataFrame:
    """series, step, transform, adf_p, kpss_p, verdict, chosen: the tests made for each series, in order, up to the first transform accepted.

    transforms: week_end, series, transform, value. A transform is accepted where the unit root is rejected, whatever the
    stationarity test says (stationary, or stationary about a trend). The next one is tested only where one failed;
    a transform with fewer than `least` values or a constant one is undefined and fails. A series that fails them all
    has no row with chosen. One group is one weekly series with its transforms.
    """
    place = F.create_map(*[F.lit(x) for i, t in enumerate(order) for x in (t, i)])

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for step, transform in enumerate(order):
            y = _values(g[g["step"] == step])
            p = (None, None) if len(y) < least or np.ptp(y) == 0 else (linear.adf(y)[1], linear.kpss(y)[1])
            accepted = p[0] is not None and p[0] < alpha
            out.append([key[0], step, transform, *p, accepted])
            if accepted:
                break
        return pd.DataFrame(out, columns=["series", "step", "transform", "adf_p", "kpss_p", "chosen"])

    rows = transforms.withColumn("step", place[F.col("transform")]).where("step is not null").select("series", "step", "week_end", "value")
    tested = rows.groupBy("series").applyInPandas(run, "series string, step int, transform string, adf_p double, kpss_p double, chosen boolean")
    verdict = F.when(F.col("adf_p").isNull(), "UNDEFINED").otherwise(stationarity_verdict(F.col("adf_p"), F.col("kpss_p"), alpha))
    return tested.select("series", "step", "transform", "adf_p", "kpss_p", verdict.alias("verdict"), "chosen")
