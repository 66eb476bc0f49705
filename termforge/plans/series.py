"""Weekly alignment, transforms and table operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from termforge.functions.columns import is_weekday, week_end
from termforge.operators import weekly
from termforge.plans.base import MACRO, ORDERS, PANEL, WIDE, macro, orders_weekly, panel, rounded, table, week_sql, wide, with_sql

Q, SQL = {}, {}


def add(name: str, query, sql: str | None = None) -> None:
    Q[name] = query
    if sql:
        SQL[name] = sql


def _last_close(spark, d):
    out = weekly.weekly_last(table(spark, d, "lineitem"), "l_shipdate", ["l_linenumber"], ["l_extendedprice"], ["l_orderkey"])
    return out.select("week_end", F.col("l_linenumber").alias("maturity"), F.col("l_extendedprice").alias("last_price"))


add("weekly_last_close", _last_close, f"""
SELECT {week_sql('l_shipdate')} AS week_end, l_linenumber AS maturity, arg_max(l_extendedprice, (l_shipdate, l_orderkey)) AS last_price
FROM lineitem WHERE isodow(l_shipdate) <= 5 GROUP BY 1, 2""")

add("weekly_curve_panel", lambda s, d: rounded(wide(s, d)), with_sql(PANEL, WIDE, "SELECT week_end, " + ", ".join(f"round(m{m:02d}, 6) AS m{m:02d}" for m in range(1, 7)) + " FROM wide"))


def _spine(spark, d):
    urgent = table(spark, d, "orders").where(is_weekday(F.col("o_orderdate")))
    sparse = urgent.groupBy(week_end(F.col("o_orderdate")).alias("week_end")).agg(F.count(F.lit(1)).alias("n"))
    return weekly.on_spine(sparse).select("week_end", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().cast("int").alias("missing"))


add("weekly_spine_gaps", _spine, with_sql(
    f"w AS (SELECT {week_sql('o_orderdate')} AS week_end, count(*) AS n FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1)",
    "sp AS (SELECT unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY))::DATE AS week_end FROM w)",
    "SELECT week_end, coalesce(n, 0) AS n, (n IS NULL)::INTEGER AS missing FROM sp LEFT JOIN w USING (week_end)"))

add("date_gap_check", lambda s, d: weekly.date_gaps(table(s, d, "orders"), "o_orderdate", 1),
    """WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
    y AS (SELECT day, lag(day) OVER (ORDER BY day) AS previous FROM x)
    SELECT day, previous, CAST(day - previous AS INTEGER) AS gap_days FROM y WHERE day - previous > 1""")


def _changes(spark, d):
    w = weekly.by_week("series")
    return rounded(macro(spark, d).select("week_end", "series", *[weekly.change("value", k, w).alias(f"d{k}w") for k in (1, 4, 13, 26)]))


add("macro_changes_d1_d4_d13_d26", _changes, with_sql(MACRO, "SELECT week_end, series, " + ", ".join(
    f"round(value - lag(value, {k}) OVER w, 6) AS d{k}w" for k in (1, 4, 13, 26)) + " FROM macro WINDOW w AS (PARTITION BY series ORDER BY week_end)"))

add("rolling_zscore_52", lambda s, d: rounded(macro(s, d).select("week_end", "series", weekly.rolling_z("value", weekly.by_week("series")).alias("z"))), with_sql(MACRO, """
SELECT week_end, series, round(CASE WHEN count(value) OVER w >= 26 THEN (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END, 6) AS z
FROM macro WINDOW w AS (PARTITION BY series ORDER BY week_end ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)"""))


def _transforms(spark, d):
    t = weekly.macro_transforms(macro(spark, d), "value", "series")
    return rounded(t.groupBy("series", "transform").agg(F.count("value").alias("n"), F.avg("value").alias("mean")), 3)


_LAGS = " UNION ALL ".join(f"SELECT series, 'd{k}W' AS transform, value - lag(value, {k}) OVER (PARTITION BY series ORDER BY week_end) AS v FROM macro" for k in (1, 4, 13, 26))
add("macro_transform_panel", _transforms, with_sql(MACRO, f"""t AS (SELECT series, 'level' AS transform, value AS v FROM macro UNION ALL {_LAGS} UNION ALL
  SELECT series, 'z52W', CASE WHEN count(value) OVER w >= 26 THEN (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END FROM macro
  WINDOW w AS (PARTITION BY series ORDER BY week_end ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))""",
    "SELECT series, transform, count(v) AS n, round(avg(v), 3) AS mean FROM t GROUP BY 1, 2"))


def _ffill(spark, d):
    day = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("v"))
    ends = day.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return ends.join(day, "day", "left").select("day", "v", weekly.fill_one("v", Window.orderBy("day")).alias("filled"))


add("ffill_limit_1", _ffill, """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS v FROM orders GROUP BY 1),
sp AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM o)
SELECT day, v, coalesce(v, lag(v) OVER (ORDER BY day)) AS filled FROM sp LEFT JOIN o USING (day)""")

add("trailing_vol_13w", lambda s, d: rounded(weekly.trailing_volatility(wide(s, d).select("week_end", "m01"), "m01", 13).select("week_end", "volatility")), with_sql(PANEL, WIDE, """
r AS (SELECT week_end, ln(m01) - lag(ln(m01)) OVER (ORDER BY week_end) AS x FROM wide WHERE m01 IS NOT NULL)""", """
SELECT week_end, round(CASE WHEN count(x) OVER w >= 52 THEN stddev_samp(x) OVER w END * sqrt(52.0) * sqrt(13 / 52.0), 6) AS volatility FROM r
WINDOW w AS (ORDER BY week_end ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)"""))


def _inventory(spark, d):
    rows = table(spark, d, "lineitem").where(is_weekday(F.col("l_shipdate")))
    stock = rows.groupBy(week_end(F.col("l_shipdate")).alias("week_end")).agg(F.sum("l_quantity").alias("inventory"))
    return rounded(weekly.lag_join(orders_weekly(spark, d), stock, "inventory", 2), 4)


add("inventory_lag_join", _inventory, with_sql(ORDERS,
    f"q AS (SELECT {week_sql('l_shipdate')} AS week_end, sum(l_quantity) AS inventory FROM lineitem WHERE isodow(l_shipdate) <= 5 GROUP BY 1)",
    "ql AS (SELECT week_end, lag(inventory, 2) OVER (ORDER BY week_end) AS inventory_lag2 FROM q)",
    "SELECT week_end, round(value, 4) AS value, round(inventory_lag2, 4) AS inventory_lag2 FROM orders_weekly LEFT JOIN ql USING (week_end)"))

_EVENTS = "SELECT event_id, user_id, date_trunc('hour', ts) AS hour, event_type, value FROM events"


def _dedup(last: bool):
    def q(spark, d):
        rows = table(spark, d, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type", "value")
        order = F.col("event_id").desc() if last else F.col("event_id").asc()
        return weekly.deduplicate(rows, ["user_id", "hour"], [order])
    return q


for _name, _last, _fn in (("dedup_keep_last", True, "DESC"), ("dedup_keep_first", False, "ASC")):
    add(_name, _dedup(_last), f"WITH e AS ({_EVENTS}) SELECT event_id, user_id, hour, event_type, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id, hour ORDER BY event_id {_fn}) = 1")


def _net(spark, d):
    rows = table(spark, d, "orders").where(is_weekday(F.col("o_orderdate"))).groupBy(week_end(F.col("o_orderdate")).alias("week_end")).agg(
        F.count(F.lit(1)).alias("open_interest"), *[F.sum((F.col("o_orderstatus") == k).cast("long")).alias(n) for k, n in (("O", "longs"), ("F", "shorts"))])
    return rounded(rows.select("week_end", (F.col("longs") - F.col("shorts")).alias("net"), (100.0 * (F.col("longs") - F.col("shorts")) / F.nullif(F.col("open_interest"), F.lit(0))).alias("net_pct")))


add("net_position_pct", _net, f"""WITH x AS (SELECT {week_sql('o_orderdate')} AS week_end, count(*) AS oi, count(*) FILTER (o_orderstatus = 'O') AS l, count(*) FILTER (o_orderstatus = 'F') AS s
FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1) SELECT week_end, l - s AS net, round(100.0::DOUBLE * (l - s) / nullif(oi, 0), 6) AS net_pct FROM x""")


def _coverage(spark, d):
    sparse = table(spark, d, "lineitem")
    p = weekly.to_wide(weekly.curve_panel(sparse, "l_shipdate", "l_linenumber", "l_extendedprice", "l_quantity", range(1, 7)), range(1, 7))
    return rounded(weekly.coverage_by_year(p, [f"m{m:02d}" for m in range(1, 7)]))


_SPARSE = PANEL
add("coverage_by_year", _coverage, with_sql(_SPARSE, WIDE, "SELECT CAST(year(week_end) AS INTEGER) AS year, count(*) AS weeks, " + ", ".join(
    f"round(100.0::DOUBLE * count(m{m:02d}) / count(*), 6) AS m{m:02d}" for m in range(1, 7)) + " FROM wide GROUP BY 1"))


def _missing(spark, d):
    sparse = table(spark, d, "lineitem")
    p = weekly.to_wide(weekly.curve_panel(sparse, "l_shipdate", "l_linenumber", "l_extendedprice", "l_quantity", range(1, 7)), range(1, 7))
    return rounded(weekly.check_missing(p, [f"m{m:02d}" for m in range(1, 7)]))


add("missing_gate", _missing, with_sql(_SPARSE, WIDE, " UNION ALL ".join(
    f"SELECT 'm{m:02d}' AS \"column\", round(1 - count(m{m:02d})::DOUBLE / count(*), 6) AS missing, 1 - count(m{m:02d})::DOUBLE / count(*) > 0.05 AS over FROM wide" for m in range(1, 7))))


def _nearest(spark, d):
    targets = orders_weekly(spark, d).select(F.date_add("week_end", 2).alias("target"))
    rows = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("price"))
    return weekly.nearest_within(targets, "target", rows, "day").select("target", "day", "price")


add("nearest_asof_3d", _nearest, with_sql(ORDERS, "t AS (SELECT week_end + 2 AS target FROM orders_weekly)",
    "o AS (SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS price FROM orders GROUP BY 1)",
    "SELECT target, day, price FROM t LEFT JOIN o ON abs(target - day) <= 3 QUALIFY row_number() OVER (PARTITION BY target ORDER BY abs(target - day), day DESC) = 1"))


def _percentiles(spark, d):
    return rounded(macro(spark, d).groupBy("series").agg(
        *[F.percentile("value", F.lit(q)).alias(f"p{int(q * 100):02d}") for q in (0.05, 0.5, 0.95)], F.max_by("week_end", F.struct("value", "week_end")).alias("max_week")), 4)


add("series_percentiles", _percentiles, with_sql(MACRO, "SELECT series, " + ", ".join(f"round(quantile_cont(value, {q}), 4) AS p{int(q * 100):02d}" for q in (0.05, 0.5, 0.95)) +
    ", arg_max(week_end, (value, week_end)) AS max_week FROM macro GROUP BY series"))


def _pivot(spark, d):
    t = weekly.macro_transforms(macro(spark, d), "value", "series")
    return rounded(t.groupBy("series").pivot("transform", ["level", "d1W", "d4W"]).agg(F.min("value")), 4)


add("transform_pivot", _pivot, with_sql(MACRO, "t AS (SELECT series, value AS a, value - lag(value) OVER w AS b, value - lag(value, 4) OVER w AS c FROM macro WINDOW w AS (PARTITION BY series ORDER BY week_end))",
    'SELECT series, round(min(a), 4) AS "level", round(min(b), 4) AS "d1W", round(min(c), 4) AS "d4W" FROM t GROUP BY series'))


def _isin(spark, d):
    n = table(spark, d, "nation").where(F.col("n_regionkey").isin(1, 2))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_nationkey")


add("isin_semi", _isin, "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))")
add("expected_missing_anti", lambda s, d: table(s, d, "nation").join(table(s, d, "supplier").where("s_acctbal > 9000"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_name"),
    "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
add("index_intersect", lambda s, d: orders_weekly(s, d).select("week_end").intersect(wide(s, d).select("week_end")),
    with_sql(ORDERS, PANEL, "SELECT week_end FROM orders_weekly INTERSECT SELECT week_end FROM panel"))
add("index_except", lambda s, d: wide(s, d).select("week_end").exceptAll(orders_weekly(s, d).select("week_end")),
    with_sql(ORDERS, PANEL, "SELECT DISTINCT week_end FROM panel EXCEPT SELECT week_end FROM orders_weekly"))
add("union_segments", lambda s, d: table(s, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")).unionByName(
    table(s, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))).groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("balance"), 2).alias("top")),
    "SELECT kind, nation, count(*) AS n, round(max(balance), 2) AS top FROM (SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier) GROUP BY 1, 2")


def _outer(spark, d):
    a = orders_weekly(spark, d).select("week_end", "value")
    b = wide(spark, d).select("week_end", "m01")
    return rounded(a.join(b, "week_end", "full"))


add("outer_alignment", _outer, with_sql(ORDERS, PANEL, WIDE, "SELECT week_end, round(value, 6) AS value, round(m01, 6) AS m01 FROM orders_weekly FULL JOIN (SELECT week_end, m01 FROM wide) USING (week_end)"))


def _turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("turn", 2).over(w).alias("two_later"))


add("positional_lead_lag", _turns, "SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(turn, 2) OVER w AS two_later FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")

add("calendar_shift_join", lambda s, d: rounded((lambda p: p.alias("a").join(p.alias("b"), F.expr("b.week_end = date_add(a.week_end, 91)")).select(F.col("a.week_end"), F.col("a.m01").alias("now"), F.col("b.m01").alias("later")))(wide(s, d))),
    with_sql(PANEL, WIDE, "SELECT a.week_end, round(a.m01, 6) AS now, round(b.m01, 6) AS later FROM wide a JOIN wide b ON b.week_end = a.week_end + 91"))


def _events(spark, d):
    from termforge.streaming.weekly import windowed_last

    out = windowed_last(table(spark, d, "events"), "ts", ["event_type"], "value", "1 hour")
    return rounded(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total"), 4)


add("events_hourly_window", _events, "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")


def _holes(spark, d):
    sparse = table(spark, d, "lineitem")
    return weekly.to_wide(weekly.curve_panel(sparse, "l_shipdate", "l_linenumber", "l_extendedprice", "l_quantity", range(1, 7)), range(1, 7))


_THIN = PANEL
add("sparse_weeks", lambda s, d: weekly.sparse_weeks(_holes(s, d), [f"m{m:02d}" for m in range(1, 7)]), with_sql(_THIN, WIDE,
    "x AS (SELECT week_end, (" + " + ".join(f"(m{m:02d} IS NULL)::INTEGER" for m in range(1, 7)) + ")::INTEGER AS n_missing FROM wide)", "SELECT * FROM x WHERE n_missing > 3"))
add("nearest_week", lambda s, d: weekly.nearest_week(wide(s, d), "1998-05-18"), with_sql(PANEL, "SELECT arg_min(week_end, (abs(week_end - DATE '1998-05-18'), week_end)) AS week_end FROM panel"))
add("series_description", lambda s, d: rounded(weekly.describe(macro(s, d), "series", "value")), with_sql(MACRO,
    """SELECT series, count(value) AS n, count(DISTINCT value) AS n_distinct, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS least, round(max(value), 6) AS greatest,
    arg_min(week_end, (value, week_end)) AS least_week, arg_max(week_end, (value, week_end)) AS greatest_week FROM macro GROUP BY 1"""))


add("latest_price_by_maturity", lambda s, d: rounded(panel(s, d).where("price is not null").groupBy("maturity").agg(F.max("week_end").alias("week_end"), F.max_by("price", "week_end").alias("price"))), with_sql(PANEL,
    "SELECT maturity, max(week_end) AS week_end, round(arg_max(price, week_end), 6) AS price FROM panel WHERE price IS NOT NULL GROUP BY 1"))
# Cents are whole numbers, so ties are exact; the SQL decides them by remainder.
add("prices_half_even", lambda s, d: rounded(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 1, even=True), """WITH c AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders)
SELECT o_orderkey, (cents // 10 + CASE WHEN cents % 10 > 5 OR (cents % 10 = 5 AND (cents // 10) % 2 = 1) THEN 1 ELSE 0 END) / 10.0::DOUBLE AS o_totalprice FROM c""")
