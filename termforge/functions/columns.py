"""Column expressions of the engine: calendar, curve loadings, labels, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, functions as F


# calendar -----------------------------------------------------------------------------------
def week_end(day: Column) -> Column:
    """The Friday on or after a day; Saturday and Sunday belong to the next Friday."""
    return F.next_day(F.date_sub(F.to_date(day), 1), "FRI")


def is_weekday(day: Column) -> Column:
    return F.weekday(F.to_date(day)) < 5


def add_weeks(day: Column, weeks: int) -> Column:
    return F.date_add(day, 7 * weeks)


# curve loadings -----------------------------------------------------------------------------
def loadings(tau: float, decay: float) -> tuple[float, float, float]:
    """Level, slope and curvature loading at a maturity; (1, 1, 0) in the limit of zero maturity."""
    a = tau / decay
    if abs(a) < 1e-8:
        return 1.0, 1.0, 0.0
    s = -math.expm1(-a) / a
    return 1.0, s, s - math.exp(-a)


def second_curvature(tau: float, decay: float) -> float:
    """The fourth loading of the four-factor curve."""
    return loadings(tau, decay)[2]


def slope_loading(tau: Column, decay: Column) -> Column:
    a = tau / decay
    return F.when(F.abs(a) < 1e-8, F.lit(1.0)).otherwise((1 - F.exp(-a)) / a)


def curvature_loading(tau: Column, decay: Column) -> Column:
    a = tau / decay
    return F.when(F.abs(a) < 1e-8, F.lit(0.0)).otherwise((1 - F.exp(-a)) / a - F.exp(-a))


def log_price(tau: float, decay: float, prefix: str = "beta") -> Column:
    """Fitted log price at a maturity from factor columns beta0, beta1, beta2."""
    _, s, c = loadings(tau, decay)
    return F.col(f"{prefix}0") + F.lit(s) * F.col(f"{prefix}1") + F.lit(c) * F.col(f"{prefix}2")


# scores and labels --------------------------------------------------------------------------
def logit(p: Column, edge: float = 1e-4) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))
    return F.when(p.isNotNull(), F.log(q / (1 - q)))  # least() and greatest() pass over nulls


def sigmoid(z: Column) -> Column:
    return F.when(z.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))


def average_rank(value: Column, keys: list[str]) -> Column:
    """1-based rank with ties sharing their mean, within keys."""
    tied = Window.partitionBy(*keys, value)
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(tied) - 1) / 2.0


def regime(slope: Column, threshold: float = 0.0) -> Column:
    """backwardation above the threshold, contango below its negative, else (and for null) neutral."""
    return F.when(slope > threshold, "backwardation").when(slope < -threshold, "contango").otherwise("neutral")


def auc_verdict(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    return (
        F.when(auc.isNull(), "UNDEFINED")
        .when(F.least(n_pos, n_neg) < 5, "INSUFFICIENT")
        .when(auc > 0.58, "GENUINE")
        .when(auc >= 0.42, "WEAK")
        .otherwise("INVERTED")
    )


def stars(p: Column) -> Column:
    """Significance marks at 1, 5 and 10 per cent."""
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def stationarity_verdict(adf_p: Column, kpss_p: Column, alpha: float = 0.05) -> Column:
    """Joint reading of a unit-root test (rejection: stationary) and a stationarity test (rejection: not)."""
    return (
        F.when((adf_p < alpha) & (kpss_p >= alpha), "STATIONARY")
        .when((adf_p >= alpha) & (kpss_p < alpha), "NON_STATIONARY")
        .when((adf_p < alpha) & (kpss_p < alpha), "TREND_STATIONARY")
        .otherwise("INCONCLUSIVE")
    )


def half_life(decay: float) -> float:
    """Weeks after which an exponential weight halves."""
    return math.log(0.5) / math.log(decay) if decay < 1 else math.inf


def effective_size(decay: float) -> float:
    """Effective sample size of an infinite exponentially weighted window."""
    return (1 + decay) / (1 - decay) if decay < 1 else math.inf


def barrier_hit(price: Column, barrier: Column, up: bool) -> Column:
    """1 or 0 for a strict crossing of the barrier, null where the price is missing."""
    hit = price > barrier if up else price < barrier
    return F.when(price.isNull(), None).otherwise(hit.cast("int"))


def reliability_bin(p: Column, n_bins: int = 10) -> Column:
    """Bin 0 to n-1 of equal width, by comparison with the edges i/n; 1.0 falls into the last bin."""
    edges = [i / n_bins for i in range(1, n_bins)]
    total = F.lit(0)
    for e in edges:
        total = total + (p >= F.lit(e)).cast("int")
    return total


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function from built-ins, error below 1.5e-7."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def log_gamma_half(df: Column) -> Column:
    """log gamma(df / 2) of a whole number df: a sum of logarithms down from df / 2."""
    terms = F.sequence(F.lit(1), F.greatest(F.floor((df - 1) / 2).cast("int"), F.lit(1)))
    start = F.when(df % 2 == 1, F.lit(0.5 * math.log(math.pi))).otherwise(F.lit(0.0))
    return start + F.when(df > 2, F.aggregate(terms, F.lit(0.0), lambda s, k: s + F.log(df / 2.0 - k))).otherwise(0.0)


def chi2_log_tail(x: Column, df: Column, steps: int = 300) -> Column:
    """Logarithm of the chance of a chi-square number above x, for whole df: finite where the chance itself underflows.

    Far out (x / 2 >= df / 2 + 1) the continued fraction of the upper incomplete gamma function is multiplied out; nearer,
    one minus the power series of the lower one is taken.
    """
    a, z = df / 2.0, F.greatest(x, F.lit(1e-300)) / 2.0
    front = a * F.log(z) - z - log_gamma_half(df)
    tiny = 1e-300

    def fraction(s: Column, i: Column) -> Column:
        numerator, b = -i * (i - a), s["b"] + 2.0
        d = 1.0 / (numerator * s["d"] + b)
        c = b + numerator / s["c"]
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    b = z + 1.0 - a
    first = F.struct(b.alias("b"), F.lit(1 / tiny).alias("c"), (1.0 / b).alias("d"), (1.0 / b).alias("h"))
    upper = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: k.cast("double")), first, fraction, lambda s: s["h"])
    term = F.struct((1.0 / a).alias("t"), (1.0 / a).alias("s"))
    lower = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: k.cast("double")), term, lambda s, k: F.struct((s["t"] * z / (a + k)).alias("t"), (s["s"] + s["t"] * z / (a + k)).alias("s")), lambda s: s["s"]
    )
    return F.when(z >= a + 1.0, front + F.log(upper)).otherwise(F.log1p(-F.least(F.exp(front) * lower, F.lit(1.0))))
