"""Time the thirteen reports and print one JSON line.

``queries`` are the registered callables on ``$BENCH_SF_DIR``: they build both
raw feeds from the test tables (joins and JSON writing included), decode them and
report. ``value`` is their sum. Two more sections time the way the library is
meant to be used: ``from_feeds`` with the raw feeds lying in Parquet, and
``from_table`` with the bridge relation written once (``write_table``).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from hopmetrics.fixtures import feeds as fixtures  # noqa: E402
from hopmetrics.fixtures import queries as registry  # noqa: E402
from hopmetrics.operators import normalize  # noqa: E402
from hopmetrics.plans import reports  # noqa: E402
from hopmetrics.sources import feeds, store  # noqa: E402


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hopmetrics-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    # JVM warm-up on the smallest data; not timed.
    for name in ("activity_by_period", "status_volume"):
        registry.REPORTS[name](spark, os.path.join(os.path.dirname(sf_dir), "sf0.001")).collect()

    queries = {
        name: seconds(lambda query=query: query(spark, sf_dir).collect())
        for name, query in registry.REPORTS.items()
    }

    folder = tempfile.mkdtemp(prefix="hopmetrics-bench-")
    fixtures.transfers(spark, sf_dir).write.parquet(f"{folder}/transfers")
    fixtures.messages(spark, sf_dir).write.parquet(f"{folder}/messages")

    def relation(columns=normalize.COLUMNS) -> DataFrame:
        return normalize.bridges(
            feeds.read_transfers(spark, f"{folder}/transfers"),
            feeds.read_messages(spark, f"{folder}/messages"),
            fixtures.TRANSFER_ROUTERS,
            fixtures.MESSAGE_ROUTERS,
            columns=columns,
        )

    def report(name: str, bridges: DataFrame) -> None:
        getattr(reports, name)(bridges, *registry.report_arguments(name)).collect()

    from_feeds = {
        name: seconds(lambda name=name, columns=columns: report(name, relation(columns)))
        for name, columns in reports.COLUMNS.items()
    }
    write_table = seconds(
        lambda: store.write_bridges(relation(), f"{folder}/bridges", partition="created_month")
    )
    table = store.read_bridges(spark, f"{folder}/bridges", partition="created_month")
    from_table = {name: seconds(lambda name=name: report(name, table)) for name in reports.COLUMNS}

    print(
        json.dumps(
            {
                "metric": "thirteen reports, total wall time",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": float(os.path.basename(sf_dir).removeprefix("sf")),
                "from_feeds": from_feeds,
                "from_feeds_total": round(sum(from_feeds.values()), 3),
                "write_table": write_table,
                "from_table": from_table,
                "from_table_total": round(sum(from_table.values()), 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
