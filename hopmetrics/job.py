"""Batch job: bring the bridge table up to date, then write every report from it.

    spark-submit hopmetrics/job.py --transfers T --messages M --table B --out FOLDER

``T`` and ``M`` are Parquet paths or catalog tables. The first run writes the
bridge table ``B``; a later run with ``--since`` decodes only the feeds from that
day on and replaces all partitions from there. ``FOLDER`` gets one Parquet folder per
report and view, and must not hold them yet.
"""

from __future__ import annotations

import argparse
import os
import sys
from concurrent.futures import ThreadPoolExecutor

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from hopmetrics.functions.calendar import date_range  # noqa: E402
from hopmetrics.operators import cohorts, normalize  # noqa: E402
from hopmetrics.plans import reports  # noqa: E402
from hopmetrics.sources import feeds, first_activity, store  # noqa: E402


CONCURRENT_REPORTS = 4


def all_reports(
    bridges: DataFrame, grain: str, start, end, as_of=None, seen: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Every report by name, not yet run; those on volume by status as the table they follow from.

    ``seen`` is the relation for the reports on new and returning users, if it is another.
    """
    seen = bridges if seen is None else seen
    return {
        "period_kpis": reports.period_kpis(bridges, start, end),
        "kpis_7d": reports.kpis_7d(bridges, as_of),
        "kpis_30d": reports.kpis_30d(bridges, as_of),
        "activity_by_period": reports.activity_by_period(bridges, grain, start, end),
        "user_growth": reports.user_growth(seen, grain, start, end),
        "status_totals": cohorts.status_totals(seen, start, end),
        "source_chain_status_users": reports.source_chain_status_users(seen, start, end),
        "txn_count_buckets": reports.txn_count_buckets(bridges, start, end),
        "amount_buckets": reports.amount_buckets(bridges, start, end),
        "asset_breakdown": reports.asset_breakdown(bridges, start, end),
        "source_chain_breakdown": reports.source_chain_breakdown(bridges, start, end),
        "dest_chain_breakdown": reports.dest_chain_breakdown(bridges, start, end),
    }


def write_reports(spark: SparkSession, made: dict[str, DataFrame], out: str, grain: str = "month") -> None:
    """Write each report, and what follows from it (reports, views) from the written rows.

    A few reports run side by side, so that the short last stages of one do not
    leave the cluster idle.
    """
    follows = {**reports.VIEWS, "status_totals": reports.from_status_totals(grain)}

    def write(name: str, report: DataFrame) -> None:
        store.write_report(report, f"{out}/{name}")
        rows = spark.read.schema(report.schema).parquet(f"{out}/{name}")
        for other, build in follows.get(name, {}).items():
            write(other, build(rows))

    with ThreadPoolExecutor(CONCURRENT_REPORTS) as pool:
        list(pool.map(write, made, made.values()))


def update_table(
    spark: SparkSession,
    transfers: str,
    messages: str,
    table: str,
    routers=normalize.ROUTERS,
    message_routers=None,
    partition: str = "created_day",
    since=None,
    state: str | None = None,
) -> DataFrame:
    """Write the whole bridge table, or its partitions from ``since`` on, and read it.

    ``state`` is the path of the first activity kept beside the table (``first_activity``).

    Records settle late, so ``since`` should reach back as far as they may change.
    It is moved to the start of its partition: a partition is replaced as a whole, and
    removed if it has no records any more.
    """
    sources = [feeds.read_transfers(spark, transfers), feeds.read_messages(spark, messages)]
    if since is not None:
        store.read_bridges(spark, table, partition)  # raises if there is no such table to refresh
        first = store.partition_start(partition, since)
        sources = [date_range(feed, first) for feed in sources]
    relation = normalize.bridges(*sources, routers, message_routers)
    if since is None:
        store.write_bridges(relation, table, partition)
        if state is not None:
            first_activity.write_state(spark, table, state, partition)
    else:
        store.refresh_bridges(relation, table, since, partition)
        if state is not None:
            first_activity.refresh_state(spark, table, state, since, partition)
    return store.read_bridges(spark, table, partition)


def run(
    spark: SparkSession,
    transfers: str,
    messages: str,
    table: str,
    out: str,
    grain: str = "month",
    start="2023-01-01",
    end="2025-08-31",
    as_of=None,
    routers=normalize.ROUTERS,
    message_routers=None,
    partition: str = "created_day",
    since=None,
    state: str | None = None,
) -> None:
    update_table(spark, transfers, messages, table, routers, message_routers, partition, since, state)
    # The feeds were read with the session's split size; only the table takes the small one.
    split_size = "spark.sql.files.maxPartitionBytes"
    if not spark.sparkContext.getConf().contains(split_size):
        spark.conf.set(split_size, store.ROW_GROUP_BYTES)
    bridges = store.read_bridges(spark, table, partition)
    seen = None
    if state is not None:
        kept = first_activity.read_state(spark, state, partition)
        seen = first_activity.with_history(bridges, kept, start, partition)
    write_reports(spark, all_reports(bridges, grain, start, end, as_of, seen), out, grain)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--transfers", required=True)
    parser.add_argument("--messages", required=True)
    parser.add_argument("--table", required=True, help="path of the bridge table")
    parser.add_argument("--out", required=True, help="folder for the reports")
    parser.add_argument("--grain", default="month", choices=["day", "week", "month"])
    parser.add_argument("--start", default="2023-01-01")
    parser.add_argument("--end", default="2025-08-31")
    parser.add_argument("--as-of", help="last day of the trailing reports (today)")
    parser.add_argument("--router", action="append", help="router address, repeatable")
    parser.add_argument("--partition", default="created_day", choices=["created_day", "created_month"])
    parser.add_argument("--since", help="first day to decode again (all)")
    parser.add_argument("--state", help="path of the users' first activity, kept beside the table (none)")
    arguments = parser.parse_args()
    spark = SparkSession.builder.appName("hopmetrics").getOrCreate()
    run(
        spark,
        arguments.transfers,
        arguments.messages,
        arguments.table,
        arguments.out,
        arguments.grain,
        arguments.start,
        arguments.end,
        arguments.as_of,
        arguments.router or normalize.ROUTERS,
        partition=arguments.partition,
        since=arguments.since,
        state=arguments.state,
    )


if __name__ == "__main__":
    main()
