"""Shares, re-aggregation and reshaping of finished (small) reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _percent(value: str, window) -> Column:
    # NULL counts as nothing in the total; a zero total has no shares.
    total = F.coalesce(F.sum(value).over(window), F.lit(0))
    return F.try_divide(F.col(value), total) * 100


def share_within(report: DataFrame, keys: Sequence[str], value: str, name: str = "percentage") -> DataFrame:
    """Add the percentage of ``value`` within its ``keys`` group."""
    return report.withColumn(name, _percent(value, Window.partitionBy(*keys)))


def share_of_total(report: DataFrame, values: Sequence[str]) -> DataFrame:
    """Add ``<value>_share``: the percentage of each ``value`` in the whole report.

    For aggregated reports (a row per chain, asset or class), where one window
    over all rows is harmless.
    """
    return report.withColumns({f"{v}_share": _percent(v, Window.partitionBy()) for v in values})


def total_by(report: DataFrame, key: str, value: str) -> DataFrame:
    """Re-aggregate a report: NULL keys drop out, a group without values is 0."""
    return (
        report.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    )


def widen(report: DataFrame, key: str, series: str, names: dict[str, str], value: str) -> DataFrame:
    """One column per series: ``names`` maps a series value to its column."""
    wide = report.groupBy(key).pivot(series, list(names)).agg(F.first(value))
    return wide.withColumnsRenamed(names)
