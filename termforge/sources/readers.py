"""Readers of dated text files, and writers. Paths may be any that Spark can read."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _clean_number(c: Column) -> Column:
    """Number from text with thousands commas and padding; anything else is null."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def _any_date(c: Column, formats) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(c), F.lit(f))) for f in formats])


#: A cell up to its comma, in quotes or not.
_CELL = r'("(?:[^"\\]|\\.|"")*"|[^,]*),'


#: Scheme and host of a path.
_SCHEME = r"^[A-Za-z0-9+.-]+:(//[^/]*)?"


def _cells(line: Column) -> Column:
    """The cells of a line of comma-separated values, without quotes and padding."""
    plain = lambda c: F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), r'""|\\"', '"')
    return F.transform(F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(_CELL), F.lit(1)), lambda c: F.trim(F.when(c.startswith('"'), plain(c)).otherwise(c)))


def scan_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, place, at, header, cells: the lines below the header of every file of the paths (files, folders or globs), in one plan.

    Each file's first line is its own header, found by an aggregate over the same files, so a thousand files are two scan
    nodes and no job each. place: in the order
    of the list (0 for globs); `at` orders the lines of a file. Blank lines are left out; cells don't span lines.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(listed).select(
        F.regexp_replace("value", "^\ufeff", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at")
    ).where("trim(line) <> ''")
    heads = lines.select(F.col("file").alias("of"), "line", "at").groupBy("of").agg(F.min_by("line", "at").alias("first"), F.min("at").alias("top"))
    # A path's place is where it, or its folder, stands in the list written as one text.
    text = "\n".join(["", *[re.sub(_SCHEME, "", quote(p, safe="/:")).rstrip("/") for p in listed], ""])
    own = F.regexp_replace("of", _SCHEME, "")
    stands = lambda c: F.instr(F.lit(text), F.concat(F.lit("\n"), c, F.lit("\n")))
    heads = heads.select("of", "top", F.greatest(stands(own), stands(F.regexp_replace(own, "/[^/]*$", ""))).alias("place"), _cells(F.col("first")).alias("header"))
    return lines.join(heads, F.col("file") == F.col("of")).where("at > top").select("file", "place", "at", "header", _cells(F.col("line")).alias("cells"))


def _named(name: str, fold: bool = False) -> Column:
    """The cell under a header name; null where the file has no such column."""
    header = F.transform("header", F.lower) if fold else F.col("header")
    place = F.array_position(header, F.lit(name))
    return F.when(place > 0, F.get("cells", (place - 1).cast("int")))


def read_macro_csv(spark: SparkSession, path: str) -> DataFrame:
    """(day, value) of a two-column series file; '.' and blanks are null, the date column is the one named *date*."""
    raw = spark.read.csv(path, header=True)
    date_col = next((c for c in raw.columns if "date" in c.lower()), None)
    if date_col is None:
        raise ValueError(f"no date column among {raw.columns}")
    value = next(c for c in raw.columns if c != date_col)
    day = _any_date(F.col(date_col), ["yyyy-MM-dd"])
    return raw.select(day.alias("day"), F.nullif(F.trim(F.col(value)), F.lit(".")).try_cast("double").alias("value")).where("day is not null")


def read_price_files(spark: SparkSession, paths: str | list[str], first_only: bool = False, width: int | None = None) -> DataFrame:
    """(day, m01, m02, ...) from files of a date and price columns, whatever the prices are called.

    Columns are renamed by position; text that is no number is null; rows without a date are
    dropped; of rows with one date that of the last file of the list (then by name), then the last row, stays. Files without a price
    column are skipped. first_only: keep the first price column only (inventories). width: price columns; None: those of
    the widest file, which one job looks up.
    """
    rows = scan_files(spark, paths).where(F.size("header") >= 2)
    if width is None:
        width = rows.agg(F.max(F.size("header"))).first()[0]
        if width is None:
            raise ValueError("no price file could be read")
        width -= 1
    day = _any_date(F.get("cells", F.lit(0)), ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy"])
    values = [f"m{k:02d}" for k in range(1, (1 if first_only else width) + 1)]
    told = rows.select(day.alias("day"), F.struct("place", "file", "at").alias("__at"), *[_clean_number(F.get("cells", F.lit(k))).alias(c) for k, c in enumerate(values, 1)])
    return told.where("day is not null").groupBy("day").agg(*[F.max_by(c, "__at").alias(c) for c in values])


def read_risk_index(spark: SparkSession, path: str, date_col: str = "date", value_col: str = "GPRD") -> DataFrame:
    """(day, value) of a daily index file among other columns; raises where either column is missing."""
    raw = spark.read.csv(path, header=True)
    missing = {date_col, value_col} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    rows = raw.select(_any_date(F.col(date_col), ["yyyy-MM-dd", "M/d/yyyy"]).alias("day"), _clean_number(F.col(value_col)).alias("value"))
    return rows.where("day is not null and value is not null")


#: Header names of the positions reports.
POSITIONS = {
    "market": "Market and Exchange Names",
    "day": "As of Date in Form YYYY-MM-DD",
    "code": "CFTC Contract Market Code",
    "open_interest": "Open Interest (All)",
    "noncomm_long": "Noncommercial Positions-Long (All)",
    "noncomm_short": "Noncommercial Positions-Short (All)",
    "noncomm_spread": "Noncommercial Positions-Spreading (All)",
}


def read_positions(spark: SparkSession, paths: str | list[str], codes: list[str]) -> DataFrame:
    """day, code, market, positions and net_speculative, net_spec_pct_oi; files with another header are skipped.

    Of rows with one date and code that of the first file stays. Raises where no file has the header.
    """
    rows = scan_files(spark, paths).where(" and ".join(f"array_contains(header, '{c}')" for c in POSITIONS.values()))
    if rows.isEmpty():
        raise ValueError("no positions file could be read")
    numbers = [_clean_number(_named(POSITIONS[n])).cast("long").alias(n) for n in list(POSITIONS)[3:]]
    told = rows.select(_any_date(_named(POSITIONS["day"]), ["yyyy-MM-dd"]).alias("day"), _named(POSITIONS["code"]).alias("code"), _named(POSITIONS["market"]).alias("market"), *numbers, F.struct("place", "file", "at").alias("__at"))
    told = told.where(F.col("code").isin(*codes) & F.col("day").isNotNull())
    values = [c for c in told.columns if c not in ("day", "code", "__at")]
    first = told.groupBy("day", "code").agg(*[F.min_by(c, "__at").alias(c) for c in values])
    net = F.col("noncomm_long") - F.col("noncomm_short")
    return first.withColumn("net_speculative", net).withColumn("net_spec_pct_oi", 100.0 * net / F.nullif(F.col("open_interest"), F.lit(0)))


def read_cash_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(day, cash, m03) of yearly files with 'DD. Month YYYY' dates, repeated header rows and thousands commas.

    A file without the date and both price columns is skipped. Raises where no file has them.
    """
    rows = scan_files(spark, paths).where(" and ".join(f"array_contains(transform(header, x -> lower(x)), '{c}')" for c in ("date", "cash", "three_month")))
    if rows.isEmpty():
        raise ValueError("no cash file could be read")
    day = _any_date(F.regexp_replace(_named("date", True), r"\.", ""), ["d MMMM yyyy"])
    told = rows.select(day.alias("day"), _clean_number(_named("cash", True)).alias("cash"), _clean_number(_named("three_month", True)).alias("m03"), F.struct("place", "file", "at").alias("__at"))
    told = told.where("day is not null")  # repeated headers have no date
    return told.groupBy("day").agg(F.max_by("cash", "__at").alias("cash"), F.max_by("m03", "__at").alias("m03"))


def read_metrics_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def audit_series(spark: SparkSession, files: dict[str, str], start: str, late_days: int = 30, null_limit: int = 5) -> DataFrame:
    """name, first_day, last_day, n_null, starts_late, many_nulls, missing of each expected series file; a missing one has nulls."""
    found = {n: p for n, p in sorted(files.items()) if _exists(spark, p)}
    names = spark.createDataFrame([(n, n not in found) for n in sorted(files)], "name string, missing boolean")
    empty = spark.createDataFrame([], "day date, value double, name string")
    rows = reduce(DataFrame.unionByName, [read_macro_csv(spark, p).withColumn("name", F.lit(n)) for n, p in found.items()], empty)
    out = rows.groupBy("name").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum(F.col("value").isNull().cast("long")).alias("n_null"))
    out = out.withColumn("starts_late", F.datediff("first_day", F.lit(start).cast("date")) > late_days).withColumn("many_nulls", F.col("n_null") > null_limit)
    return F.broadcast(names).join(out, "name", "left").select("name", "first_day", "last_day", "n_null", "starts_late", "many_nulls", "missing")


def missing_names(present: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """Expected names that a table does not have."""
    table = present.sparkSession.createDataFrame([(e,) for e in expected], "name string")
    return table.join(present.select(F.col(column).alias("name")).distinct(), "name", "left_anti")


# sinks --------------------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Overwrite a table; facts are partitioned by e.g. model and horizon, so readers prune them."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_report(sheets: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    """Several tables of one report, a folder each."""
    for name, df in sheets.items():
        write_table(df, f"{path}/{name}", fmt=fmt)
