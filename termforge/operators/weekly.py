"""Weekly alignment and transforms of dated series.

Daily tables of any size are first aggregated to one row per (week, series) with partial
aggregates. Windows ordered by week run on that small weekly table only; where a table has
several series the window is partitioned by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from termforge.functions.columns import is_weekday, week_end


def by_week(*keys: str):
    return Window.partitionBy(*keys).orderBy("week_end")


def weekly_last(daily: DataFrame, day: str, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Last non-null value of each column in the week ending Friday; weekends are left out.

    order: columns that, after the day, fix which of several rows of a day is last.
    """
    rows = daily.where(is_weekday(F.col(day))).withColumn("week_end", week_end(F.col(day)))
    at = F.struct(day, *order)
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) for v in values]
    return rows.groupBy("week_end", *keys).agg(*last)


def curve_panel(trades: DataFrame, day: str, maturity: str, amount: str, quantity: str, maturities) -> DataFrame:
    """(week_end, maturity, price): volume-weighted price of each maturity in each Friday week."""
    rows = trades.where(is_weekday(F.col(day)) & F.col(maturity).isin(*maturities))
    return rows.groupBy(week_end(F.col(day)).alias("week_end"), F.col(maturity).cast("int").alias("maturity")).agg(
        (F.sum(amount) / F.sum(quantity)).alias("price")
    )


def to_wide(panel: DataFrame, maturities, value: str = "price", prefix: str = "m") -> DataFrame:
    """One row a week with a column for each maturity (m01, m02, ...), null where there is none."""
    cells = [F.max(F.when(F.col("maturity") == m, F.col(value))).alias(f"{prefix}{m:02d}") for m in maturities]
    return panel.groupBy("week_end").agg(*cells)


def week_spine(weekly: DataFrame) -> DataFrame:
    """Every Friday from the first to the last week of a weekly table."""
    ends = weekly.agg(F.min("week_end").alias("a"), F.max("week_end").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week_end"))


def on_spine(weekly: DataFrame) -> DataFrame:
    """A weekly table with rows (of nulls) for its missing weeks."""
    return week_spine(weekly).join(weekly, "week_end", "left")


def date_gaps(days: DataFrame, day: str, over: int) -> DataFrame:
    """Pairs of consecutive days more than `over` days apart."""
    rows = days.select(F.to_date(day).alias("day")).distinct()
    rows = rows.withColumn("previous", F.lag("day").over(Window.orderBy("day")))
    return rows.withColumn("gap_days", F.datediff("day", "previous")).where(F.col("gap_days") > over)


def change(value: str, weeks: int, w) -> Column:
    """Difference to the value so many rows before."""
    return F.col(value) - F.lag(value, weeks).over(w)


def rolling_z(value: str, w, size: int = 52, least: int = 26) -> Column:
    """(x - mean) / standard deviation over the last `size` rows; null below `least` values or at zero spread."""
    frame = w.rowsBetween(1 - size, 0)
    enough = F.count(value).over(frame) >= least
    spread = F.when(enough, F.nullif(F.stddev_samp(value).over(frame), F.lit(0.0)))
    return (F.col(value) - F.avg(value).over(frame)) / spread


def fill_one(value: str, w) -> Column:
    """The value, or where it is null that of the row before."""
    return F.coalesce(F.col(value), F.lag(value, 1).over(w))


def macro_transforms(weekly: DataFrame, value: str, key: str, weeks=(1, 4, 13, 26)) -> DataFrame:
    """(week_end, key, transform, value): level, changes over several spans and the 52-week z-score."""
    w = by_week(key)
    cols = {"level": F.col(value)} | {f"d{k}W": change(value, k, w) for k in weeks} | {"z52W": rolling_z(value, w)}
    wide = weekly.select("week_end", key, *[c.alias(n) for n, c in cols.items()])
    return wide.unpivot(["week_end", key], list(cols), "transform", "value")


def trailing_volatility(weekly: DataFrame, price: str, horizon: int, size: int = 52) -> DataFrame:
    """Log-return volatility over a full trailing window, scaled to a horizon in weeks."""
    rows = weekly.where(F.col(price).isNotNull())
    w = by_week()
    rows = rows.withColumn("__ret", F.log(price) - F.lag(F.log(price)).over(w))
    frame = w.rowsBetween(1 - size, 0)
    vol = F.when(F.count("__ret").over(frame) >= size, F.stddev_samp("__ret").over(frame))
    scale = (52.0**0.5) * ((horizon / 52.0) ** 0.5)
    return rows.withColumn("volatility", vol * scale).drop("__ret")


def lag_join(left: DataFrame, right: DataFrame, value: str, lag: int) -> DataFrame:
    """left with `value` of right lagged by rows of right, on the week; weeks without one get null."""
    lagged = right.select("week_end", F.lag(value, lag).over(by_week()).alias(f"{value}_lag{lag}"))
    return left.join(lagged, "week_end", "left")


def deduplicate(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated total order (give descending order to keep the last)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def coverage_by_year(weekly: DataFrame, values: list[str]) -> DataFrame:
    """Share of non-null values of each column in each year, in per cent."""
    share = [(100.0 * F.avg(F.col(v).isNotNull().cast("int"))).alias(v) for v in values]
    return weekly.groupBy(F.year("week_end").alias("year")).agg(F.count(F.lit(1)).alias("weeks"), *share)


def check_missing(weekly: DataFrame, values: list[str], limit: float = 0.05) -> DataFrame:
    """Share of nulls of each column, and whether it exceeds the limit."""
    wide = weekly.agg(*[F.avg(F.col(v).isNull().cast("int")).alias(v) for v in values])
    return wide.unpivot([], values, "column", "missing").withColumn("over", F.col("missing") > limit)


def nearest_within(left: DataFrame, day: str, right: DataFrame, other_day: str, days: int = 3) -> DataFrame:
    """left with the row of right nearest in time, at most `days` away; of two as near, the later.

    Each right row is offered to the 2*days+1 days around it, so the join is an equi-join.
    """
    offered = right.withColumn("__at", F.explode(F.sequence(F.date_sub(other_day, days), F.date_add(other_day, days))))
    near = offered.groupBy("__at").agg(
        F.min(F.struct(F.abs(F.datediff("__at", other_day)).alias("gap"), (-F.unix_date(other_day)).alias("later"), F.struct(*right.columns).alias("row"))).alias("best")
    )
    return left.join(near.select("__at", "best.row"), left[day] == F.col("__at"), "left").select(*left.columns, "row.*")


def sparse_weeks(wide: DataFrame, values: list[str], over: int = 3) -> DataFrame:
    """Weeks with more than `over` missing columns, and how many are missing."""
    missing = sum((F.col(v).isNull().cast("int") for v in values), F.lit(0))
    return wide.select("week_end", missing.alias("n_missing")).where(F.col("n_missing") > over)


def nearest_week(weekly: DataFrame, target) -> DataFrame:
    """The week nearest to a date; of two as near, the earlier."""
    gap = F.abs(F.datediff("week_end", F.lit(target)))
    return weekly.agg(F.min_by("week_end", F.struct(gap, "week_end")).alias("week_end"))


def describe(rows: DataFrame, key: str, value: str) -> DataFrame:
    """n, n_distinct, mean, sd, least, greatest and their weeks for each key."""
    return rows.groupBy(key).agg(
        F.count(value).alias("n"), F.countDistinct(value).alias("n_distinct"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("least"), F.max(value).alias("greatest"),
        F.min_by("week_end", F.struct(value, "week_end")).alias("least_week"), F.max_by("week_end", F.struct(value, "week_end")).alias("greatest_week"),
    )


def attach(rows: DataFrame, table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with columns of a table, by its distinct rows of keys and columns; null where it has no such key.

    A key with several values in the table gives a row for each.
    """
    return rows.join(table.select(*keys, *columns).distinct(), keys, "left")


def first_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an order, with their place from 1; n is small, and each task keeps only its own first n."""
    first = rows.orderBy(*order).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))
