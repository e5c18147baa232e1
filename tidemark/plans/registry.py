"""Queries of the measurement operators and their SQL oracles, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import census, measurements, series, stateful, statistics  # noqa: F401  the others add to the same tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slowest record of each event type against its own time budget."""
    return series.QUERIES["a4_slowest_multiple"](spark, sf_dir)


def queries() -> dict:
    return dict(series.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(series.SQL)
