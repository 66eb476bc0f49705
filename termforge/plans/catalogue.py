"""All registered queries of the weekly engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termforge.plans import curves, files, scores, series


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly curve panel, three-factor fit, seasonal z-score and regime counts."""
    return curves.regime_counts(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return series.Q | curves.Q | scores.Q | files.Q


def oracle_sql() -> dict[str, str]:
    return series.SQL | curves.SQL | scores.SQL | files.SQL
