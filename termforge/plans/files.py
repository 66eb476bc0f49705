"""Queries over text files: whole tables are written in the layouts of the raw files and read back by the readers.

Files go to a fresh folder under spark.checkpoint.dir (the default folder of local runs where that is unset), so that
executors elsewhere can read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from termforge.config import shared_path
from termforge.functions.columns import is_weekday, week_end
from termforge.operators import weekly
from termforge.plans.base import rounded, table, week_sql
from termforge.sources import readers

Q, SQL = {}, {}


def add(name: str, query, sql: str | None = None) -> None:
    Q[name] = query
    if sql:
        SQL[name] = sql


def _folder(spark: SparkSession) -> str:
    return shared_path(spark, "files")


def _write(df: DataFrame, path: str, **options) -> str:
    df.select(*[F.col(c).cast("string") for c in df.columns]).write.options(header=True, emptyValue="", **options).csv(path)
    return path


def _thousands(c: Column) -> Column:
    return F.format_number(c, 4)


def _daily(spark, d, how=F.avg) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(how("o_totalprice").alias("v"))


def _series_file(spark, d, folder: str) -> str:
    """Days with '.' for Mondays and blanks for Tuesdays, and a row whose date can't be read."""
    value = F.when(F.weekday("day") == 0, ".").when(F.weekday("day") == 1, "").otherwise(F.col("v").cast("string"))
    rows = _daily(spark, d).select(F.col("day").cast("string").alias("observation_date"), value.alias("PRICE"))
    return _write(rows.union(spark.createDataFrame([("no date", "1")], "a string, b string")), f"{folder}/series")


def _macro_file(spark, d):
    return rounded(readers.read_macro_csv(spark, _series_file(spark, d, _folder(spark))), 4)


add("source_series_csv", _macro_file, """SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN isodow(CAST(o_orderdate AS DATE)) > 2 THEN round(avg(o_totalprice), 4) END AS value FROM orders GROUP BY CAST(o_orderdate AS DATE)""")


def _price_files(spark, d, folder: str) -> list[str]:
    """Two files of thousands-separated prices by maturity, in other column names; the second repeats 1998 with doubled prices."""
    rows = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"))
    wide = rows.agg(*[F.max(F.when(F.col("l_linenumber") == m, F.col("l_extendedprice"))).alias(f"x{m}") for m in range(1, 7)])
    cells = [F.coalesce(_thousands(F.col(f"x{m}")), F.lit("#N/A")).alias(f"LP {m}") for m in range(1, 7)]
    twice = [F.coalesce(_thousands(2 * F.col(f"x{m}")), F.lit("#N/A")).alias(f"price {m}") for m in range(1, 7)]
    day = F.col("day").cast("string").alias("Date")
    return [_write(wide.select(day, *cells), f"{folder}/one"), _write(wide.where("year(day) = 1998").select(day, *twice), f"{folder}/two")]


def _prices(spark, d, first_only=False):
    return rounded(readers.read_price_files(spark, _price_files(spark, d, _folder(spark)), first_only), 3)


_CELL = "round(max(l_extendedprice) FILTER (l_linenumber = {m}) * CASE WHEN year(l_shipdate) = 1998 THEN 2 ELSE 1 END, 3) AS m{m:02d}"
add("source_price_files", _prices, "SELECT CAST(l_shipdate AS DATE) AS day, " + ", ".join(_CELL.format(m=m) for m in range(1, 7)) + " FROM lineitem GROUP BY CAST(l_shipdate AS DATE), year(l_shipdate)")
add("source_inventory_files", lambda s, d: _prices(s, d, True), "SELECT CAST(l_shipdate AS DATE) AS day, " + _CELL.format(m=1) + " FROM lineitem GROUP BY CAST(l_shipdate AS DATE), year(l_shipdate)")


def _risk(spark, d):
    rows = _daily(spark, d, F.max).select(F.col("day").cast("string").alias("date"), F.lit("x").alias("source"), F.when(F.weekday("day") < 5, F.col("v")).alias("GPRD"), F.lit(1).alias("version"))
    return rounded(readers.read_risk_index(spark, _write(rows, f"{_folder(spark)}/risk")), 4)


add("source_risk_index", _risk, "SELECT CAST(o_orderdate AS DATE) AS day, round(max(o_totalprice), 4) AS value FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1")

_GROUPS = {"open_interest": None, "noncomm_long": "O", "noncomm_short": "F", "noncomm_spread": "P"}


def _positions(spark, d):
    """Counts of orders by priority as positions reports; a second file repeats them all, a third has another header."""
    folder, names = _folder(spark), readers.POSITIONS
    rows = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).alias("code"), "o_orderpriority").agg(
        *[F.count(F.lit(1) if k is None else F.when(F.col("o_orderstatus") == k, 1)).alias(n) for n, k in _GROUPS.items()])
    text = [F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")).alias(names["market"]), F.col("day").cast("string").alias(names["day"]), F.concat(F.lit(" "), F.col("code"), F.lit("  ")).alias(names["code"])]
    one = _write(rows.select(*text, *[F.format_number(1_000 * F.col(n), 0).alias(names[n]) for n in _GROUPS]), f"{folder}/one")
    two = _write(rows.select(*text, *[F.lit("7").alias(names[n]) for n in _GROUPS]), f"{folder}/two")
    three = _write(rows.select("day", "code"), f"{folder}/three")
    out = readers.read_positions(spark, [one, two, three], ["1", "2"])
    return rounded(out.select("day", "code", "market", *_GROUPS, "net_speculative", "net_spec_pct_oi"), 5)


add("source_positions_reports", _positions, """SELECT day, code, market, oi AS open_interest, l AS noncomm_long, s AS noncomm_short, p AS noncomm_spread, l - s AS net_speculative, round(100.0::DOUBLE * (l - s) / nullif(oi, 0), 5) AS net_spec_pct_oi
FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority[1] AS code, o_orderpriority AS market, 1000 * count(*) AS oi, 1000 * count(*) FILTER (o_orderstatus = 'O') AS l, 1000 * count(*) FILTER (o_orderstatus = 'F') AS s, 1000 * count(*) FILTER (o_orderstatus = 'P') AS p
FROM orders WHERE o_orderpriority[1] IN ('1', '2') GROUP BY ALL)""")


def _cash(spark, d):
    """A file a year of long dates and prices with thousands commas, with a header repeated inside, and one without its second price."""
    folder, daily = _folder(spark), _daily(spark, d, F.max)
    rows = daily.select(F.date_format("day", "dd. MMMM yyyy").alias("date"), _thousands(F.col("v")).alias("cash"), _thousands(F.col("v") / 2).alias("three_month"), F.year("day").alias("year"))
    paths = []
    for year in range(1995, 2002):
        header = spark.createDataFrame([("date", "cash", "three_month")], "date string, cash string, three_month string")
        paths.append(_write(rows.where(F.col("year") == year).drop("year").union(header), f"{folder}/{year}"))
    broken = _write(rows.select("date", "cash"), f"{folder}/broken")
    return rounded(readers.read_cash_files(spark, [*paths, broken]), 3)


add("source_cash_files", _cash, "SELECT CAST(o_orderdate AS DATE) AS day, round(max(o_totalprice), 3) AS cash, round(max(o_totalprice) / 2, 3) AS m03 FROM orders GROUP BY 1")


def _metrics(spark, d):
    """Fit figures as one JSON file a model, read back as rows."""
    folder = _folder(spark)
    rows = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).alias("n"))
    rows.select(F.col("o_orderpriority").alias("model"), F.struct("mean", "n").alias("metrics")).write.json(f"{folder}/metrics")
    out = spark.read.schema("model string, metrics struct<mean: double, n: long>").json(f"{folder}/metrics")
    return rounded(out.select("model", "metrics.mean", "metrics.n"), 4)


add("source_metrics_json", _metrics, "SELECT o_orderpriority AS model, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 1")


def _audit(spark, d):
    folder = _folder(spark)
    late = _write(_daily(spark, d).where("day >= '1997-01-01'").select(F.col("day").alias("DATE"), F.col("v").alias("X")), f"{folder}/late")
    return readers.audit_series(spark, {"late": late, "series": _series_file(spark, d, folder), "absent": f"{folder}/absent"}, "1995-01-01")


add("source_audit", _audit, """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
a AS (SELECT 'late' AS name, min(day) AS first_day, max(day) AS last_day, 0 AS n_null FROM d WHERE day >= DATE '1997-01-01' UNION ALL SELECT 'series', min(day), max(day), count(*) FILTER (isodow(day) <= 2) FROM d)
SELECT name, first_day, last_day, n_null::BIGINT AS n_null, first_day - DATE '1995-01-01' > 30 AS starts_late, n_null > 5 AS many_nulls, false AS missing FROM a UNION ALL SELECT 'absent', NULL, NULL, NULL, NULL, NULL, true""")


def _partitioned(spark, d):
    """A table written by partition, of which one is read back, beside a report of two sheets."""
    folder = _folder(spark)
    rows = table(spark, d, "orders").where(is_weekday(F.col("o_orderdate"))).groupBy(week_end(F.col("o_orderdate")).alias("week_end"), F.substring("o_orderpriority", 1, 1).cast("int").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    readers.write_table(rows, f"{folder}/fact", ["model"])
    back = spark.read.parquet(f"{folder}/fact").where("model = 3")
    readers.write_report({"by_week": back.select("week_end", "n"), "total": back.agg(F.sum("n").alias("n"))}, f"{folder}/report")
    sheet = spark.read.csv(f"{folder}/report/by_week", header=True, schema="week_end date, n long")
    total = spark.read.csv(f"{folder}/report/total", header=True, schema="n long").select(F.lit(None).cast("date").alias("week_end"), "n")
    return sheet.unionByName(total)


add("sink_partitions_and_reports", _partitioned, f"""WITH x AS (SELECT {week_sql('o_orderdate')} AS week_end, count(*) AS n FROM orders WHERE isodow(o_orderdate) <= 5 AND o_orderpriority[1] = '3' GROUP BY 1)
SELECT week_end, n FROM x UNION ALL SELECT NULL, sum(n)::BIGINT FROM x""")


def _weekly_close(spark, d):
    """A series file aligned to weeks, the last value of each with one missing week filled."""
    days = readers.read_macro_csv(spark, _series_file(spark, d, _folder(spark)))
    closes = weekly.weekly_last(days, "day", [], ["value"], ["value"])
    return rounded(closes, 4)


add("source_series_weekly", _weekly_close, f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN isodow(CAST(o_orderdate AS DATE)) > 2 THEN avg(o_totalprice) END AS v FROM orders GROUP BY CAST(o_orderdate AS DATE))
SELECT {week_sql('day')} AS week_end, round(arg_max(v, day) FILTER (v IS NOT NULL), 4) AS value FROM d WHERE isodow(day) <= 5 GROUP BY 1""")
