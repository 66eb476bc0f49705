"""Calibration maps p' = sigmoid(a * logit(p) + b), pooled and rolling, fitted point in time.

Fits are two-parameter problems on the rows of one key: Newton steps on sums, which are aggregates or
running sums. Scores and map application are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructType

from termforge.functions.columns import logit, sigmoid
from termforge.operators.probability import brier


def fit_pooled(rows: DataFrame, keys: list[str], least: int = 20, steps: int = 12) -> DataFrame:
    """a, b, n_fit for each key from p and actual; keys with fewer rows have none.

    Newton steps on the log loss from a = 0 and the base rate's logit. A step needs five sums a key, which are
    partial aggregates over counts by p, so a key of any size is never in one task. A negative slope is replaced by 0 and the
    base rate, and slopes stop at 50.
    """
    z = logit(F.col("p"))
    points = rows.where("p is not null and actual is not null").groupBy(*keys, z.alias("z")).agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("y"))
    rate = F.greatest(F.least(F.sum("y") / F.sum("n"), F.lit(1 - 1e-4)), F.lit(1e-4))
    start = points.groupBy(*keys).agg(F.sum("n").alias("n_fit"), F.log(rate / (1 - rate)).alias("flat")).where(F.col("n_fit") >= least)
    fit = start.select(*keys, "n_fit", "flat", F.lit(0.0).alias("a"), F.col("flat").alias("b"))
    for _ in range(steps):
        s = sigmoid(F.col("a") * F.col("z") + F.col("b"))
        h = F.col("n") * s * (1 - s)
        g = F.col("y") - F.col("n") * s
        held = F.first
        sums = points.join(fit, keys).groupBy(*keys).agg(
            held("n_fit").alias("n_fit"), held("flat").alias("flat"), held("a").alias("a"), held("b").alias("b"),
            F.sum(g * F.col("z")).alias("ga"), F.sum(g).alias("gb"), F.sum(h * F.col("z") * F.col("z")).alias("haa"), F.sum(h * F.col("z")).alias("hab"), F.sum(h).alias("hbb"),
        )
        haa, hbb = F.col("haa") + 1e-9, F.col("hbb") + 1e-9
        det = haa * hbb - F.col("hab") * F.col("hab")
        fit = sums.select(*keys, "n_fit", "flat", (F.col("a") + (hbb * F.col("ga") - F.col("hab") * F.col("gb")) / det).alias("a"), (F.col("b") + (haa * F.col("gb") - F.col("hab") * F.col("ga")) / det).alias("b"))
    rising = F.col("a") > 0
    return fit.select(*keys, F.when(rising, F.least("a", F.lit(50.0))).otherwise(0.0).alias("a"), F.when(rising, F.col("b")).otherwise(F.col("flat")).alias("b"), "n_fit")


def apply_map(rows: DataFrame, coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """rows with p_cal; coefficients has one row a key."""
    return rows.join(coefficients, keys, "left").withColumn("p_cal", sigmoid(F.col("a") * logit(F.col("p")) + F.col("b")))


def pooled(rows: DataFrame, keys: list[str], shock, least: int = 20) -> DataFrame:
    """Fit before the shock, apply everywhere; in_domain marks the weeks fitted on."""
    fit = fit_pooled(rows.where(F.col("week_end") < F.lit(shock)), keys, least)
    return apply_map(rows, fit, keys).withColumn("in_domain", F.col("week_end") < F.lit(shock))


def skill_table(calibrated: DataFrame, keys: list[str]) -> DataFrame:
    """Brier score and skill of raw and calibrated probabilities side by side."""
    raw = brier(calibrated, keys).select(*keys, F.col("brier_score").alias("brier_raw"), F.col("brier_skill").alias("bss_raw"), "base_rate", "n")
    cal = brier(calibrated.where("p_cal is not null").withColumn("p", F.col("p_cal")), keys)
    return raw.join(cal.select(*keys, F.col("brier_score").alias("brier_cal"), F.col("brier_skill").alias("bss_cal")), keys, "left")


#: Bins of the logit over (-EDGE, EDGE), steps, the largest step, and the penalty on half the squared slope, of rolling fits.
BINS, EDGE, STEPS, LARGEST_STEP, RIDGE = 64, 9.22, 16, 2.0, 0.01
#: Logits are added as whole numbers of 1 / UNIT, so that sums don't depend on the order of rows.
UNIT = 1_000_000_000


@F.pandas_udf(StructType().add("a", DoubleType()).add("b", DoubleType()))
def newton(n: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
    """a, b of sigmoid(a * z + b) for each row's arrays of counts, of hits and of mean logits: Newton steps of many rows at once.

    Steps start from a = 0 and the base rate and are cut to LARGEST_STEP; the penalty keeps separated outcomes
    finite. Where all outcomes are equal, or the slope would not be positive, a is 0 and b the base rate.
    """
    width = max([BINS, *map(len, n)])  # the same for all batches, so that sums are too
    grid = np.zeros((3, len(n), width))
    for k, column in enumerate((n, y, z)):
        for i, values in enumerate(column):
            grid[k, i, : len(values)] = values
    n, y, z = grid
    total, hits = n.sum(1), y.sum(1)
    rate = np.clip(hits / np.maximum(total, 1), 1e-4, 1 - 1e-4)
    flat = np.log(rate / (1 - rate))
    a, b = np.zeros(len(n)), flat.copy()
    for _ in range(STEPS):
        s = 1 / (1 + np.exp(-np.clip(a[:, None] * z + b[:, None], -30, 30)))
        g, h = y - n * s, n * s * (1 - s)
        ga, gb = (g * z).sum(1) - RIDGE * a, g.sum(1)
        haa, hab, hbb = (h * z * z).sum(1) + RIDGE, (h * z).sum(1), h.sum(1) + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        cut = np.maximum(1.0, np.maximum(np.abs(da), np.abs(db)) / LARGEST_STEP)
        a, b = a + da / cut, b + db / cut
    plain = (hits == 0) | (hits == total) | (a <= 0)
    return pd.DataFrame({"a": np.where(plain, 0.0, a), "b": np.where(plain, flat, b)})


def _active(cells: DataFrame, keys: list[str], dates: DataFrame, values: list[str], window_weeks: int | None) -> DataFrame:
    """keys, week_end, sums of values over the cells (week_end, realized_date) that count at each date of dates: realised by it, and not too old.

    A cell comes in on the day it is realised and goes out when it is too old; running sums over those days give all dates at once.
    """
    came = cells.select(*keys, F.col("realized_date").alias("day"), *values)
    if window_weeks is not None:
        lasts = F.date_add("week_end", 7 * window_weeks)
        cells = cells.where(F.col("realized_date") <= lasts)
        came = cells.select(*keys, F.col("realized_date").alias("day"), *values)
        came = came.unionByName(cells.select(*keys, F.date_add(lasts, 1).alias("day"), *[(-F.col(v)).alias(v) for v in values]))
    marks = dates.select(*keys, F.col("week_end").alias("day"), *[F.lit(None).cast("long").alias(v) for v in values], F.lit(True).alias("asked"))
    both = came.withColumn("asked", F.lit(False)).unionByName(marks)
    upto = Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(Window.unboundedPreceding, 0)
    summed = both.select(*keys, F.col("day").alias("week_end"), "asked", *[F.sum(v).over(upto).alias(v) for v in values])
    return summed.where("asked").drop("asked")


def rolling(rows: DataFrame, keys: list[str], window_weeks: int | None, shock, least_rows: int = 20, least_dates: int = 10) -> DataFrame:
    """One fit per key and date t from outcomes realised by t, at most window_weeks old; after the shock the last fit stands.

    rows: keys, week_end, realized_date, p, actual (several rows a date are pooled into its
    fit). Returns keys, week_end, a, b, n_used, n_dates_used, in_domain, one row per key and
    date; in_domain: fitted at the date itself, before the shock. Rows from the shock on are never fitted on; dates with fewer
    rows or dates than asked for have no fit before the shock, and the last there was from it on.

    No date is refitted from its rows. Logits fall into BINS bins, each with its number of rows, of hits and its mean logit,
    as running sums over the days on which rows come in and go out; the fits are Newton steps on
    these, many dates in one Arrow batch.
    """
    known = rows.where(F.col("p").isNotNull() & F.col("actual").isNotNull() & F.col("realized_date").isNotNull() & (F.col("week_end") < F.lit(shock)))
    z = logit(F.col("p"))
    place = F.least(F.floor((z + EDGE) / (2 * EDGE) * BINS), F.lit(BINS - 1)).cast("int")
    cells = known.groupBy(*keys, "week_end", "realized_date", place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("actual").cast("long").alias("y"), F.sum(F.round(z * UNIT).cast("long")).alias("z")
    )
    dates = rows.select(*keys, "week_end").distinct()
    used = dates.join(cells.select(*keys, "bin").distinct(), keys)
    sums = _active(cells, [*keys, "bin"], used, ["n", "y", "z"], window_weeks).where("n > 0")
    listed = sums.groupBy(*keys, "week_end").agg(F.sum("n").cast("int").alias("n_used"), F.sort_array(F.collect_list(F.struct("bin", "n", "y", (F.col("z") / F.col("n") / UNIT).alias("z")))).alias("bins"))
    origins = known.select(*keys, "week_end", "realized_date").distinct().withColumn("d", F.lit(1).cast("long"))
    counted = _active(origins, keys, dates, ["d"], window_weeks).select(*keys, "week_end", F.col("d").cast("int").alias("n_dates_used"))
    inside = F.col("week_end") < F.lit(shock)
    ready = inside & (F.col("n_used") >= least_rows) & (F.col("n_dates_used") >= least_dates)
    fitted = listed.join(counted, [*keys, "week_end"]).where(ready).withColumn("f", newton("bins.n", "bins.y", "bins.z")).select(*keys, "week_end", "f.a", "f.b")
    every = dates.join(listed.drop("bins"), [*keys, "week_end"], "left").join(counted, [*keys, "week_end"], "left").join(fitted, [*keys, "week_end"], "left")
    last = Window.partitionBy(*keys).orderBy("week_end").rowsBetween(Window.unboundedPreceding, 0)
    stands = lambda c: F.when(inside, F.col(c)).otherwise(F.last(c, True).over(last)).alias(c)
    zero = F.lit(0)
    return every.select(*keys, "week_end", stands("a"), stands("b"), F.coalesce("n_used", zero).alias("n_used"), F.coalesce("n_dates_used", zero).alias("n_dates_used"), F.coalesce(inside & F.col("a").isNotNull(), F.lit(False)).alias("in_domain"))


def rolling_apply(rows: DataFrame, keys: list[str], window_weeks: int | None, shock, **least) -> DataFrame:
    fits = rolling(rows, keys, window_weeks, shock, **least)
    return rows.join(fits, [*keys, "week_end"], "left").withColumn("p_cal", sigmoid(F.col("a") * logit(F.col("p")) + F.col("b")))


def window_search(rows: DataFrame, keys: list[str], windows, shock) -> DataFrame:
    """Mean calibrated Brier skill of each trailing window (null: expanding), over in-domain weeks."""
    parts = None
    for weeks in windows:
        scored = rolling_apply(rows, keys, weeks, shock).where("in_domain and p_cal is not null and actual is not null").withColumn("p", F.col("p_cal"))
        part = brier(scored, keys).agg(F.avg("brier_skill").alias("mean_bss"), F.count(F.lit(1)).alias("n_cells"))
        part = part.select(F.lit(weeks).cast("int").alias("window_weeks"), "mean_bss", "n_cells")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def compare_rolling(pooled_rows: DataFrame, rolling_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Calibrated skill of the pooled and the rolling map for each key."""
    a = skill_table(pooled_rows, keys).select(*keys, F.col("bss_raw"), F.col("bss_cal").alias("bss_pooled"))
    b = skill_table(rolling_rows, keys).select(*keys, F.col("bss_cal").alias("bss_rolling"))
    return a.join(b, keys, "full")

