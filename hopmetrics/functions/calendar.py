"""Calendar buckets and date predicates.

Time is TIMESTAMP_NTZ throughout. Buckets go through DATE arithmetic rather than
``date_trunc``, which works on zoned timestamps and would move with the session
time zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")

# Partition columns the materialised bridge table may carry, and their grain.
PARTITION_COLUMNS = {"created_day": "day", "created_month": "month"}


def as_date(value: dt.date | dt.datetime | str) -> dt.date:
    if isinstance(value, str):
        return dt.date.fromisoformat(value)
    return value.date() if isinstance(value, dt.datetime) else value


def bucket(grain: str, when: Column) -> Column:
    """Start of the day / week (Monday) / month of ``when``, as TIMESTAMP_NTZ."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
    return day_start(grain, F.to_date(when)).cast("timestamp_ntz")


def day_start(grain: str, day: Column) -> Column:
    """First day of the bucket that holds ``day``, as DATE."""
    return day if grain == "day" else F.trunc(day, grain)


def _bounded(rows: DataFrame, first: Column | None, last: Column | None) -> DataFrame:
    """Rows whose calendar date is in [first, last].

    On the feeds Catalyst turns the bounds on ``to_date(created_at)`` into a
    timestamp range and pushes it into both scans. On the bridge table the same
    bounds, moved to the start of a partition, also prune partitions.
    """
    day = F.to_date("created_at")
    partitions = {c: grain for c, grain in PARTITION_COLUMNS.items() if c in rows.columns}
    if first is not None:
        rows = rows.filter(day >= first)
        for column, grain in partitions.items():
            rows = rows.filter(F.col(column) >= day_start(grain, first))
    if last is not None:
        rows = rows.filter(day <= last)
        for column, grain in partitions.items():
            rows = rows.filter(F.col(column) <= last)
    return rows


def date_range(rows: DataFrame, start=None, end=None) -> DataFrame:
    """Rows whose calendar date is in [start, end]; an open end is None."""
    first = None if start is None else F.lit(as_date(start))
    last = None if end is None else F.lit(as_date(end))
    return _bounded(rows, first, last)


def trailing_days(rows: DataFrame, days: int, as_of=None) -> DataFrame:
    """The last ``days`` calendar days including ``as_of`` (today if None).

    There is no upper bound: rows dated after ``as_of`` stay.
    """
    today = F.current_date() if as_of is None else F.lit(as_date(as_of))
    return _bounded(rows, F.date_sub(today, days - 1), None)
