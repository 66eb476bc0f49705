"""Tables that the registered queries start from, and their SQL counterparts.

The weekly curve is the volume-weighted price of line numbers 1 to 6 in Friday weeks; orders
give macro-like weekly series. SQL texts are for DuckDB and are written independently of the
DataFrame code they check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from termforge.config import Settings, ship_package
from termforge.functions.columns import is_weekday, loadings, week_end
from termforge.operators import curve, weekly

S = Settings()
MATURITIES = S.maturities
DECAY = S.decay


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.curve_panel(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_linenumber", "l_extendedprice", "l_quantity", MATURITIES)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.to_wide(panel(spark, sf_dir), MATURITIES)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.factors(panel(spark, sf_dir), MATURITIES, DECAY)


def orders_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week_end, value): mean order value of each Friday week."""
    rows = table(spark, sf_dir, "orders").where(is_weekday(F.col("o_orderdate")))
    return rows.groupBy(week_end(F.col("o_orderdate")).alias("week_end")).agg(F.avg("o_totalprice").alias("value"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week_end, series, value): mean order value by priority."""
    rows = table(spark, sf_dir, "orders").where(is_weekday(F.col("o_orderdate")))
    return rows.groupBy(week_end(F.col("o_orderdate")).alias("week_end"), F.col("o_orderpriority").alias("series")).agg(F.avg("o_totalprice").alias("value"))


def macro_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [F.max(F.when(F.col("series").startswith(str(i)), F.col("value"))).alias(f"x{i}") for i in range(1, 6)]
    return macro(spark, sf_dir).groupBy("week_end").agg(*cells)


def rounded(df: DataFrame, digits: int = 6, even: bool = False) -> DataFrame:
    """Doubles rounded, since engines add in different orders; even: ties go to the even digit, else away from zero."""
    half = F.bround if even else F.round
    return df.select(*[half(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# SQL ----------------------------------------------------------------------------------------
def week_sql(day: str) -> str:
    return f"(CAST({day} AS DATE) + CAST((5 - isodow({day}) + 7) % 7 AS INTEGER))"


PANEL = f"""panel AS (
  SELECT {week_sql('l_shipdate')} AS week_end, l_linenumber AS maturity, sum(l_extendedprice) / sum(l_quantity) AS price
  FROM lineitem WHERE isodow(l_shipdate) <= 5 AND l_linenumber BETWEEN 1 AND 6 GROUP BY 1, 2)"""
WIDE = """wide AS (
  SELECT week_end, """ + ", ".join(f"max(price) FILTER (maturity = {m}) AS m{m:02d}" for m in MATURITIES) + """
  FROM panel GROUP BY week_end)"""
ORDERS = f"""orders_weekly AS (
  SELECT {week_sql('o_orderdate')} AS week_end, avg(o_totalprice) AS value FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1)"""
MACRO = f"""macro AS (
  SELECT {week_sql('o_orderdate')} AS week_end, o_orderpriority AS series, avg(o_totalprice) AS value
  FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1, 2)"""


def load_sql(decays, maturities=MATURITIES, name: str = "loads") -> str:
    rows = ", ".join(f"({float(d)!r}::DOUBLE, {m}, {loadings(m, d)[1]!r}::DOUBLE, {loadings(m, d)[2]!r}::DOUBLE)" for d in decays for m in maturities)
    return f"{name}(decay, maturity, s, c) AS (VALUES {rows})"


def fit_sql(source: str = "panel", name: str = "fits", least: int = 3) -> str:
    """CTEs that fit (decay, week_end) by Cramer's rule on the normal equations, and their rmse."""
    return f"""{name}_x AS (
  SELECT l.decay, p.week_end, ln(p.price) AS y, l.s, l.c FROM {source} p JOIN loads l USING (maturity) WHERE p.price > 0),
{name}_m AS (
  SELECT decay, week_end, count(*)::DOUBLE AS n, sum(s) AS a, sum(c) AS b, sum(s*s) AS d, sum(s*c) AS e, sum(c*c) AS f,
         sum(y) AS u, sum(s*y) AS v, sum(c*y) AS w FROM {name}_x GROUP BY 1, 2),
{name}_b AS (
  SELECT decay, week_end, n, CASE WHEN n >= {least} THEN (u*(d*f-e*e) - a*(v*f-e*w) + b*(v*e-d*w)) / (n*(d*f-e*e) - a*(a*f-e*b) + b*(a*e-d*b)) END AS beta0,
         CASE WHEN n >= {least} THEN (n*(v*f-e*w) - u*(a*f-e*b) + b*(a*w-v*b)) / (n*(d*f-e*e) - a*(a*f-e*b) + b*(a*e-d*b)) END AS beta1,
         CASE WHEN n >= {least} THEN (n*(d*w-v*e) - a*(a*w-v*b) + u*(a*e-d*b)) / (n*(d*f-e*e) - a*(a*f-e*b) + b*(a*e-d*b)) END AS beta2
  FROM {name}_m),
{name} AS (
  SELECT k.decay, k.week_end, k.n::INTEGER AS n_maturities, k.beta0, k.beta1, k.beta2,
         sqrt(avg((x.y - k.beta0 - x.s*k.beta1 - x.c*k.beta2) * (x.y - k.beta0 - x.s*k.beta1 - x.c*k.beta2))) AS rmse
  FROM {name}_b k JOIN {name}_x x USING (decay, week_end) GROUP BY ALL)"""


FACT = ",\n".join([PANEL, load_sql([DECAY]), fit_sql(), "fact AS (SELECT week_end, beta0, beta1, beta2, rmse FROM fits)"])


def with_sql(*parts: str) -> str:
    """WITH the given CTEs; the last part is the query."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def rewalk_sql(horizons) -> str:
    """CTE rw: random-walk forecasts from test_start on, with the week h rows later."""
    parts = " UNION ALL ".join(
        f"SELECT week_end, {h} AS horizon, beta0, beta1, beta2, lead(week_end, {h}) OVER (ORDER BY week_end) AS t_plus_h FROM fact" for h in horizons
    )
    return f"rw AS (SELECT * FROM ({parts}) WHERE week_end >= DATE '{S.test_start}')"


def curve_sql(beta: str = "beta{}", load: str = "l") -> str:
    return f"exp({beta.format(0)} + {load}.s*{beta.format(1)} + {load}.c*{beta.format(2)})"
