"""Threshold probabilities from forecasts and residual pools, and their scores.

Probabilities are exact expectations over the pool rather than simulations:

    p_up = sum w * 1[price(mu + r) > barrier] / sum w.

Point-in-time rule: a residual counts at week t only if it was realised by t. Residuals that are
known at t are counted by blocks of residuals in order of date, without joining weeks and residuals. Only
pools that are refitted every week (pooled_exceedance) come as rows of weeks and residuals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from termforge.functions.columns import auc_verdict, barrier_hit, loadings, norm_cdf, reliability_bin


def _cells(maturities, decay: float, default: float) -> Column:
    """Array of (maturity, s, c, sd): loadings, and the deviation of the log price with `default` times the identity as covariance."""
    cells = []
    for m in maturities:
        _, s, c = loadings(m, decay)
        cells.append(F.struct(F.lit(int(m)).alias("maturity"), F.lit(s).alias("s"), F.lit(c).alias("c"), F.lit((default * (1 + s * s + c * c)) ** 0.5).alias("sd")))
    return F.array(*cells)


def exceedance(forecasts: DataFrame, pool: DataFrame, panel: DataFrame, maturities, thresholds, decay: float, weight_decay: float | None = None, least: int = 5, default: float = 1e-4) -> DataFrame:
    """week_end, horizon, model, maturity, threshold, p_up, p_down, actual_up, actual_down, n_pool, t_plus_h.

    weight_decay: weights weight_decay^(weeks since the residual was realised); None: equal.
    A pool of fewer than `least` residuals gives the normal probability with covariance `default` times the identity.

    The log price is the forecast's mean plus the residual's value at the loadings, so p_up at t is the weight of residuals
    realised by t with a value over log(barrier) - mean: a dominance count in (date, value). Residuals are numbered by date; those known at t are
    the first n, and these are at most log2(n) blocks of 1, 2, 4, ... residuals, one for each binary digit of n. In each block a
    running sum in order of value answers all its weeks at once. So rows grow as weeks * log(weeks), and no week meets
    each residual. Weights factor into one of the residual's date and one of t, and the latter drops out.
    """
    keys = ["horizon", "model"]
    known = pool.where("r0 is not null").select(*keys, "realized_date", "r0", "r1", "r2")
    whole = Window.partitionBy(*keys)
    age = F.datediff("realized_date", F.min("realized_date").over(whole)) / 7.0
    weight = F.lit(1.0) if weight_decay is None else F.pow(F.lit(1.0 / weight_decay), age)
    place = F.row_number().over(whole.orderBy("realized_date", "r0", "r1", "r2")) - 1
    points = known.select("*", weight.alias("w"), place.alias("i"), F.count(F.lit(1)).over(whole).alias("n"))
    marks = points.select(*keys, F.col("realized_date").alias("week_end"), F.lit(1).alias("one"), "w")
    marks = marks.unionByName(forecasts.select(*keys, "week_end", F.lit(0).alias("one"), F.lit(0.0).alias("w")).distinct())
    upto = whole.orderBy(F.unix_date("week_end")).rangeBetween(Window.unboundedPreceding, 0)
    pools = marks.select(*keys, "week_end", "one", F.sum("one").over(upto).alias("n_pool"), F.sum("w").over(upto).alias("w_pool")).where("one = 0").drop("one").distinct()
    current = panel.select("week_end", "maturity", F.col("price").alias("current_price"))
    rows = forecasts.join(pools, [*keys, "week_end"]).withColumn("x", F.explode(_cells(maturities, decay, default)))
    mean = F.col("beta0_hat") + F.col("x.s") * F.col("beta1_hat") + F.col("x.c") * F.col("beta2_hat")
    rows = rows.select("week_end", *keys, "t_plus_h", "n_pool", "w_pool", "x.maturity", "x.sd", mean.alias("mean")).join(current, ["week_end", "maturity"])

    digits = lambda n: F.sequence(F.lit(0), F.length(F.bin(n)) - 1)
    # Even blocks only: a set digit's block starts where the digits above it end.
    known = points.withColumn("level", F.explode(digits(F.col("n")))).withColumn("block", F.expr("cast(shiftright(i, level) as long)")).where("block % 2 = 0")
    known = known.withColumn("x", F.explode(_cells(maturities, decay, default)))
    value = F.col("r0") + F.col("x.s") * F.col("r1") + F.col("x.c") * F.col("r2")
    known = known.select(*keys, "x.maturity", "level", "block", value.alias("value"), F.lit(1).alias("kind"), "w", F.lit(None).cast("date").alias("week_end"), F.lit(None).cast("int").alias("k"))
    bars = []
    for i, k in enumerate(thresholds):
        for kind, side in ((0, 1 - k), (2, 1 + k)):
            bars.append(F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("k"), (F.log(F.col("current_price") * side) - F.col("mean")).alias("value")))
    asked = rows.withColumn("level", F.explode(digits(F.col("n_pool")))).where("shiftright(n_pool, level) % 2 = 1")
    asked = asked.withColumn("b", F.explode(F.array(*bars)))
    asked = asked.select(*keys, "maturity", "level", F.expr("cast(shiftright(n_pool, level) - 1 as long)").alias("block"), "b.value", "b.kind", F.lit(0.0).alias("w"), "week_end", "b.k")
    cell = Window.partitionBy(*keys, "maturity", "level", "block")
    # At equal values prices below a barrier come before the residual and those above it after: both hits are strict.
    running = F.sum("w").over(cell.orderBy("value", "kind").rowsBetween(Window.unboundedPreceding, 0))
    part = known.unionByName(asked).withColumn("part", F.when(F.col("kind") == 0, running).otherwise(F.sum("w").over(cell) - running)).where("kind <> 1")
    hits = part.groupBy("week_end", *keys, "maturity").agg(
        *[F.sum(F.when((F.col("k") == i) & (F.col("kind") == kind), F.col("part")).otherwise(0.0)).alias(f"{name}{i}") for i in range(len(thresholds)) for kind, name in ((2, "u"), (0, "d"))]
    )
    wide = rows.join(hits, ["week_end", *keys, "maturity"], "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.nullif(F.col("w_pool"), F.lit(0.0))
    shares = [share(f"{name}{i}").alias(f"{name}{i}") for i in range(len(thresholds)) for name in "ud"]
    return _thresholds(wide.select("week_end", *keys, "maturity", "t_plus_h", "current_price", "mean", "sd", "n_pool", *shares), panel, thresholds, least)


def pooled_exceedance(f: DataFrame, panel: DataFrame, maturities, thresholds, decay: float, weight_decay: float | None = None, least: int = 5, default: float = 1e-4) -> DataFrame:
    """exceedance from forecasts that are already joined with their residuals (realized_date, r0, r1, r2; nulls where there are none)."""
    weight = F.lit(1.0) if weight_decay is None else F.pow(F.lit(weight_decay), F.datediff("week_end", "realized_date") / 7.0)
    f = f.withColumn("w", F.when(F.col("r0").isNotNull(), weight))
    f = f.withColumn("x", F.explode(_cells(maturities, decay, default)))
    mean = F.col("beta0_hat") + F.col("x.s") * F.col("beta1_hat") + F.col("x.c") * F.col("beta2_hat")
    price = F.exp(F.col("beta0_hat") + F.col("r0") + F.col("x.s") * (F.col("beta1_hat") + F.col("r1")) + F.col("x.c") * (F.col("beta2_hat") + F.col("r2")))
    f = f.select("week_end", "horizon", "model", "t_plus_h", "w", "x.maturity", "x.sd", price.alias("simulated"), mean.alias("mean"))
    current = panel.select("week_end", "maturity", F.col("price").alias("current_price"))
    f = f.join(current, ["week_end", "maturity"])
    shares = []
    for i, k in enumerate(thresholds):
        up, down = F.col("current_price") * (1 + k), F.col("current_price") * (1 - k)
        shares += [
            (F.sum(F.when(F.col("simulated") > up, F.col("w")).otherwise(0.0)) / F.sum("w")).alias(f"u{i}"),
            (F.sum(F.when(F.col("simulated") < down, F.col("w")).otherwise(0.0)) / F.sum("w")).alias(f"d{i}"),
        ]
    wide = f.groupBy("week_end", "horizon", "model", "maturity", "t_plus_h", "current_price", "mean", "sd").agg(F.count("w").alias("n_pool"), *shares)
    return _thresholds(wide, panel, thresholds, least)


def _thresholds(wide: DataFrame, panel: DataFrame, thresholds, least: int) -> DataFrame:
    """One row a threshold of wide (shares u0, d0, u1, ...), with what came true."""
    few = F.col("n_pool") < least

    def z(k: float) -> Column:
        return (F.log(F.col("current_price") * (1 + k)) - F.col("mean")) / F.col("sd")

    rows = F.array(
        *[
            F.struct(
                F.lit(float(k)).alias("threshold"),
                F.when(few, 1 - norm_cdf(z(k))).otherwise(F.col(f"u{i}")).alias("p_up"),
                F.when(few, norm_cdf(z(-k))).otherwise(F.col(f"d{i}")).alias("p_down"),
            )
            for i, k in enumerate(thresholds)
        ]
    )
    long = wide.withColumn("t", F.explode(rows)).select("week_end", "horizon", "model", "maturity", "t_plus_h", "current_price", "n_pool", "t.*")
    realised = panel.select(F.col("week_end").alias("t_plus_h"), "maturity", F.col("price").alias("realised"))
    out = long.join(realised, ["t_plus_h", "maturity"], "left")
    up, down = F.col("current_price") * (1 + F.col("threshold")), F.col("current_price") * (1 - F.col("threshold"))
    return out.select(
        "week_end", "horizon", "model", "maturity", "threshold", "p_up", "p_down",
        barrier_hit(F.col("realised"), up, True).alias("actual_up"), barrier_hit(F.col("realised"), down, False).alias("actual_down"), "n_pool", "t_plus_h",
    )


def as_of(rows: DataFrame, table: DataFrame, columns: list[str], defaults: dict[str, float]) -> DataFrame:
    """rows (horizon, model, week_end) with the columns that table (the same keys) last gave by the week, or defaults before its first."""
    keys = ["horizon", "model", "week_end"]
    weeks = rows.select(*keys).distinct().join(table.select(*keys, *columns), keys, "full")
    w = Window.partitionBy("horizon", "model").orderBy("week_end").rowsBetween(Window.unboundedPreceding, 0)
    filled = weeks.select(*keys, *[F.coalesce(F.last(c, True).over(w), F.lit(defaults[c])).alias(c) for c in columns])
    return rows.join(filled, keys)


def gaussian_exceedance(forecasts: DataFrame, covariance: DataFrame, panel: DataFrame, maturities, thresholds, decay: float, default: float = 1e-4) -> DataFrame:
    """Closed form for normal residuals: the log price is normal with mean and variance linear in the loadings.

    covariance: horizon, model, week_end, s00..s22, one row for each date from which it is known; a forecast takes the last
    known by its week (`default` times the identity before any).
    """
    six = [f"s{i}{j}" for i in range(3) for j in range(i, 3)]
    rows = as_of(forecasts, covariance, six, {c: default if c[1] == c[2] else 0.0 for c in six})
    cells = []
    for m in maturities:
        _, s, c = loadings(m, decay)
        w = (1.0, s, c)
        mean = sum((F.lit(w[i]) * F.col(f"beta{i}_hat") for i in range(3)), F.lit(0.0))
        var = sum((F.lit(w[i] * w[j] * (1.0 if i == j else 2.0)) * F.col(f"s{i}{j}") for i in range(3) for j in range(i, 3)), F.lit(0.0))
        cells.append(F.struct(F.lit(int(m)).alias("maturity"), mean.alias("mu"), F.sqrt(var).alias("sd")))
    rows = rows.withColumn("x", F.explode(F.array(*cells))).select("week_end", "horizon", "model", "x.*")
    rows = rows.join(panel.select("week_end", "maturity", F.col("price").alias("current_price")), ["week_end", "maturity"])
    rows = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(k)) for k in thresholds])))

    def z(sign: int) -> Column:
        return (F.log(F.col("current_price") * (1 + sign * F.col("threshold"))) - F.col("mu")) / F.col("sd")

    return rows.select("week_end", "horizon", "model", "maturity", "threshold", (1 - norm_cdf(z(1))).alias("p_up"), norm_cdf(z(-1)).alias("p_down"), "mu", "sd")


def price_bands(gaussian: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Percentile bands of the price: exp(mu + z * sd) for standard normal quantiles z."""
    return gaussian.select("week_end", "horizon", "model", "maturity", *[F.exp(F.col("mu") + F.lit(z) * F.col("sd")).alias(n) for n, z in quantiles.items()]).distinct()


def by_direction(probs: DataFrame) -> DataFrame:
    """One row per direction: p and actual."""
    pair = F.array(
        F.struct(F.lit("up").alias("direction"), F.col("p_up").alias("p"), F.col("actual_up").alias("actual")),
        F.struct(F.lit("down").alias("direction"), F.col("p_down").alias("p"), F.col("actual_down").alias("actual")),
    )
    return probs.withColumn("x", F.explode(pair)).drop("p_up", "p_down", "actual_up", "actual_down").select("*", "x.*").drop("x").where("actual is not null")


def brier(rows: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """brier_score, brier_skill (against the base rate; null where that is 0 or 1), base_rate, n of p and actual."""
    rate = F.avg("actual")
    score = F.avg((F.col("p") - F.col("actual")) * (F.col("p") - F.col("actual")))
    out = rows.groupBy(*keys).agg(score.alias("brier_score"), rate.alias("base_rate"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    climate = F.col("base_rate") * (1 - F.col("base_rate"))
    return out.withColumn("brier_skill", 1 - F.col("brier_score") / F.nullif(climate, F.lit(0.0)))


def auc(rows: DataFrame, keys: list[str], least: int = 0, buckets: int = 4_096) -> DataFrame:
    """auc (ties count half; null where a class is empty), n_pos, n_neg, verdict of p and actual for each key.

    Rows are folded to counts by p first. Running sums go over buckets of p, and within a bucket over its
    values, so no task sorts all rows of a key.
    """
    bucket = F.least(F.greatest(F.floor(F.col("p") * buckets), F.lit(0)), F.lit(buckets)).cast("int")
    points = rows.groupBy(*keys, "p").agg(F.sum((F.col("actual") == 1).cast("long")).alias("n1"), F.sum((F.col("actual") == 0).cast("long")).alias("n0")).withColumn("bucket", bucket)
    sums = points.groupBy(*keys, "bucket").agg(F.sum("n0").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("n")).withColumnsRenamed({k: f"__{k}" for k in [*keys, "bucket"]}).drop("n")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in [*keys, "bucket"]]
    w = Window.partitionBy(*keys, "bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = points.join(before, on).withColumn("below", F.col("before") + F.sum("n0").over(w) - F.col("n0") / 2.0)
    out = ranked.groupBy(*keys).agg(F.sum(F.col("n1") * F.col("below")).alias("wins"), F.sum("n1").alias("n_pos"), F.sum("n0").alias("n_neg"))
    out = out.where(F.col("n_pos") + F.col("n_neg") >= least)
    value = F.col("wins") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))
    return out.select(*keys, value.alias("auc"), "n_pos", "n_neg").withColumn("verdict", auc_verdict(F.col("auc"), F.col("n_pos"), F.col("n_neg")))


def mean_auc(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean AUC over well-posed cells."""
    return cells.where(~F.col("verdict").isin("UNDEFINED", "INSUFFICIENT")).groupBy(*keys).agg(F.avg("auc").alias("mean_auc"), F.count(F.lit(1)).alias("n_cells"))


def reliability(rows: DataFrame, keys: list[str], n_bins: int = 10, least: int = 3) -> DataFrame:
    """Mean forecast and observed rate in bins of equal width; bins of fewer than `least` are left out."""
    out = rows.withColumn("bin", reliability_bin(F.col("p"), n_bins)).groupBy(*keys, "bin")
    return out.agg(F.avg("p").alias("mean_p"), F.avg("actual").alias("observed"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def sharpness(rows: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """How many forecasts fall in each bin."""
    return rows.withColumn("bin", reliability_bin(F.col("p"), n_bins)).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def directional_accuracy(probs: DataFrame, keys: list[str]) -> DataFrame:
    """On weeks with a breach: how often the larger probability was on the side that was breached."""
    right = ((F.col("actual_up") == 1) & (F.col("p_up") > F.col("p_down"))) | ((F.col("actual_down") == 1) & (F.col("p_down") > F.col("p_up")))
    rows = probs.where("actual_up = 1 or actual_down = 1")
    return rows.groupBy(*keys).agg(F.avg(right.cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n_breaches"))


def kish(pool: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Effective size (sum w)^2 / sum w^2."""
    return pool.groupBy(*keys).agg((F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))).alias("n_eff"))


def embargo_counts(facts: DataFrame, at: DataFrame, window_weeks: int | None = None) -> DataFrame:
    """For each date t: rows and distinct dates realised by t (and at most window_weeks old).

    Counts are running sums over one row per date, so no pairs are formed.
    """
    at = at.select("t").distinct()
    days = facts.groupBy("realized_date").agg(F.count(F.lit(1)).alias("n"))
    marks = days.select(F.col("realized_date").alias("t"), "n", F.lit(1).alias("d")).union(at.select("t", F.lit(0), F.lit(0)))
    start = Window.unboundedPreceding if window_weeks is None else -7 * window_weeks
    w = Window.orderBy(F.unix_date("t")).rangeBetween(start, 0)
    counted = marks.withColumn("n_used", F.sum("n").over(w)).withColumn("n_dates", F.sum("d").over(w))
    return counted.where("d = 0").select("t", F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("n_dates", F.lit(0)).alias("n_dates"))
