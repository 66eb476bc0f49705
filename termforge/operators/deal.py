"""Probabilities and buffers of a dated position that rolls down the curve.

The position is entered at a far maturity and closed, after `horizon` weeks, at the maturity
that is then left; at zero the loadings are the limit (1, 1, 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from termforge.functions.columns import barrier_hit, loadings
from termforge.operators.weekly import nearest_within, trailing_volatility


def remaining_maturity(months: float, weeks: int) -> float:
    return months - weeks / (52.0 / 12.0)


def realised_differences(fact: DataFrame, horizon: int) -> DataFrame:
    """Residual pool of the random walk: factor changes over `horizon` rows with the date they were realised."""
    w = Window.orderBy("week_end")
    ahead = [(F.lead(f"beta{i}", horizon).over(w) - F.col(f"beta{i}")).alias(f"r{i}") for i in range(3)]
    rows = fact.select(F.lit(horizon).alias("horizon"), F.lit(0).alias("model"), F.col("week_end").alias("origin"), F.lead("week_end", horizon).over(w).alias("realized_date"), *ahead)
    return rows.where("realized_date is not null")


def roll_down(forecasts: DataFrame, pool: DataFrame, wide: DataFrame, exits: DataFrame, entry: int, horizon: int, decay: float, constant_maturity: bool = False, least: int = 5) -> DataFrame:
    """week_end, model, entry_price, sigma, p_up, p_down, expected_vol, exit_price, actual_up, actual_down, n_pool.

    exits: (day, exit_price) of the closing market, looked up within three days of the
    closing date. constant_maturity: value at the entry maturity instead of the one left.
    expected_vol is the population deviation of the simulated returns.
    """
    tau = float(entry) if constant_maturity else remaining_maturity(entry, horizon)
    _, s, c = loadings(tau, decay)
    price = f"m{entry:02d}"
    sigma = trailing_volatility(wide.select("week_end", price), price, horizon).where("volatility is not null")
    entries = sigma.select("week_end", F.col(price).alias("entry_price"), F.col("volatility").alias("sigma"))
    rows = forecasts.where(F.col("horizon") == horizon).join(entries, "week_end").join(pool, ["horizon", "model"]).where("realized_date <= week_end")
    simulated = F.exp(F.col("beta0_hat") + F.col("r0") + F.lit(s) * (F.col("beta1_hat") + F.col("r1")) + F.lit(c) * (F.col("beta2_hat") + F.col("r2")))
    rows = rows.withColumn("ret", simulated / F.col("entry_price") - 1)
    out = rows.groupBy("week_end", "model", "entry_price", "sigma").agg(
        F.avg((F.col("ret") > F.col("sigma")).cast("double")).alias("p_up"),
        F.avg((F.col("ret") < -F.col("sigma")).cast("double")).alias("p_down"),
        F.stddev_pop("ret").alias("expected_vol"),
        F.count(F.lit(1)).alias("n_pool"),
    ).where(F.col("n_pool") >= least).withColumn("closing", F.date_add("week_end", 7 * horizon))
    out = nearest_within(out, "closing", exits, "day")
    up, down = F.col("entry_price") * (1 + F.col("sigma")), F.col("entry_price") * (1 - F.col("sigma"))
    return out.select("*", barrier_hit(F.col("exit_price"), up, True).alias("actual_up"), barrier_hit(F.col("exit_price"), down, False).alias("actual_down")).drop("closing", "day")


def volatility_errors(deals: DataFrame) -> DataFrame:
    """Absolute errors of the model's and of the trailing volatility against the realised move, by model."""
    move = F.abs(F.col("exit_price") / F.col("entry_price") - 1)
    rows = deals.where("exit_price is not null").withColumn("e_naive", F.abs(F.col("sigma") - move)).withColumn("e_model", F.abs(F.col("expected_vol") - move))
    return rows.groupBy("model").agg(
        F.avg("e_naive").alias("mae_naive"), F.avg("e_model").alias("mae_model"), F.avg((F.col("e_model") < F.col("e_naive")).cast("int")).alias("win_rate"), F.count(F.lit(1)).alias("n")
    )


def liquidity_buffer(deals: DataFrame, tonnes: float) -> DataFrame:
    """Reference and probability-weighted buffers of a notional, and what the latter saves; a null probability keeps the reference."""
    notional = F.lit(float(tonnes)) * F.col("entry_price")
    naive = notional * F.col("sigma")
    short, long = naive * F.coalesce("p_up", F.lit(1.0)), naive * F.coalesce("p_down", F.lit(1.0))
    return deals.select(
        "week_end", "model", "entry_price", notional.alias("notional"), naive.alias("naive_buffer"), short.alias("dynamic_short"), long.alias("dynamic_long"),
        (naive - short).alias("saving_short"), (naive - long).alias("saving_long"),
    )


def deal_summary(deals: DataFrame) -> DataFrame:
    """By model: mean probabilities and the share of weeks with a probability above one half."""
    return deals.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_up").alias("mean_p_up"), F.avg("p_down").alias("mean_p_down"),
        (100.0 * F.avg((F.col("p_up") > 0.5).cast("int"))).alias("pct_up_over_half"), (100.0 * F.avg((F.col("p_down") > 0.5).cast("int"))).alias("pct_down_over_half"),
    )


def in_episodes(rows: DataFrame, episodes: list[tuple]) -> DataFrame:
    """rows with the name of each dated episode they fall in; the list of episodes is a literal table."""
    table = rows.sparkSession.createDataFrame(episodes, "episode string, from_day date, to_day date")
    return rows.join(F.broadcast(table), rows["week_end"].between(F.col("from_day"), F.col("to_day"))).drop("from_day", "to_day")


def breaches(wide: DataFrame, exits: DataFrame, entry: int, horizon: int) -> DataFrame:
    """Weeks whose realised move to the closing price exceeds the trailing volatility."""
    price = f"m{entry:02d}"
    rows = trailing_volatility(wide.select("week_end", price), price, horizon).where("volatility is not null")
    rows = rows.withColumn("closing", F.date_add("week_end", 7 * horizon))
    rows = nearest_within(rows, "closing", exits, "day").where("exit_price is not null")
    move = F.col("exit_price") / F.col(price) - 1
    return rows.withColumn("move", move).where(F.abs("move") > F.col("volatility")).select("week_end", F.col(price).alias("entry_price"), "exit_price", "volatility", "move")
