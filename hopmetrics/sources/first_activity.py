"""First activity as kept state: each wallet's earliest time per partition of the bridge table.

A first date needs the whole history, which is read anew by every report on users. The
state is a narrow table beside the bridge table, with the same partitions: a refresh of
the bridge table replaces the minima of the replaced partitions only, and as they are kept
by partition, a first record that goes away needs no look at the rest. A wallet's first
activity is the least of its minima.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmetrics.functions.calendar import date_range
from hopmetrics.sources import store

STATE = "wallet STRING, created_at TIMESTAMP_NTZ"


def minima(bridges: DataFrame, partition: str = "created_day") -> DataFrame:
    """(wallet, created_at): the earliest time of each wallet in each partition.

    Rows without a wallet are one group, as they are in the reports; rows without a time are left out.
    """
    rows = bridges.filter(F.col("created_at").isNotNull())
    return rows.groupBy("wallet", partition).agg(F.min("created_at").alias("created_at")).drop(partition)


def write_state(spark: SparkSession, table: str, path: str, partition: str = "created_day") -> None:
    """Minima of a whole bridge table."""
    store.write_bridges(minima(store.read_bridges(spark, table, partition), partition), path, partition)


def refresh_state(
    spark: SparkSession, table: str, path: str, since: dt.date | str, partition: str = "created_day"
) -> None:
    """Minima of the partitions from that of ``since`` on, after the table's refresh from there."""
    first = store.partition_start(partition, since)
    late = date_range(store.read_bridges(spark, table, partition), first)
    store.refresh_bridges(minima(late, partition), path, since, partition, STATE)


def read_state(spark: SparkSession, path: str, partition: str = "created_day") -> DataFrame:
    return store.read_bridges(spark, path, partition, STATE)


def with_history(bridges: DataFrame, state: DataFrame, start, partition: str = "created_day") -> DataFrame:
    """Rows from the partition of ``start`` on, and the minima of those before it.

    For the reports on users over a range from ``start`` on: rows before it only say that a
    wallet has been seen, which its minima say as well. Of the bridge table only the
    partitions from there on are read.
    """
    first = store.partition_start(partition, start)
    before = state.filter(F.col(partition) < F.lit(first)).select("wallet", "created_at", partition)
    return date_range(bridges, first).unionByName(before, allowMissingColumns=True)
