"""A refresh of the bridge table replaces its whole range."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import ts

from hopmetrics import job
from hopmetrics.sources import schemas, store

DAYS = {"a": "2024-01-05", "b": "2024-02-03", "c": "2024-02-20", "d": "2024-03-09"}


@pytest.mark.parametrize(
    ("partition", "failed", "left"),
    [
        ("created_day", "cd", "ab"),
        ("created_day", "bcd", "ab"),  # before since, so not decoded again
        ("created_month", "cd", "ab"),
        ("created_month", "bcd", "a"),
        ("created_month", "", "abcd"),
    ],
)
def test_refresh_removes_partitions_without_records(spark, tmp_path, partition, failed, left):
    def feed(name: str, bad: str) -> str:
        rows = [
            (i, ts(day), "w", "0xROUTER", "executed", "failed" if i in bad else "received", '{"send": {"amount": "1"}}')
            for i, day in DAYS.items()
        ]
        by_name = ["id", "created_at", "recipient_address", "sender_address", "status", "simplified_status", "data"]
        spark.createDataFrame(
            [tuple(dict(zip(by_name, row, strict=True))[f.strip().split()[0]] for f in schemas.TRANSFER_FEED.split(",")) for row in rows],
            schemas.TRANSFER_FEED,
        ).write.parquet(f"{tmp_path}/{name}")
        return f"{tmp_path}/{name}"

    messages = f"{tmp_path}/messages"
    spark.createDataFrame([], schemas.MESSAGE_FEED).write.parquet(messages)
    table = f"{tmp_path}/table"
    more = {"routers": ["0xROUTER", "router"], "partition": partition}
    assert job.update_table(spark, feed("first", ""), messages, table, **more).count() == 4
    found = job.update_table(spark, feed("late", failed), messages, table, since="2024-02-15", **more)
    assert sorted(r.id for r in found.collect()) == list(left)


def test_rows_without_a_time_stay(spark, bridge_rows):
    path = store.new_table_path(spark, "bridges")
    rows = [{"id": "a", "created_at": None}, {"id": "b", "created_at": ts("2024-01-02")}]
    store.write_bridges(bridge_rows(rows), path)
    store.refresh_bridges(bridge_rows([]), path, dt.date(2024, 1, 1))
    assert [r.id for r in store.read_bridges(spark, path).collect()] == ["a"]


def test_another_partition_column_raises(spark, bridge_rows):
    path = store.new_table_path(spark, "bridges")
    rows = bridge_rows([{"id": "a", "created_at": ts("2024-01-01")}])
    store.write_bridges(rows, path, partition="created_month")
    with pytest.raises(ValueError, match="not partitioned by created_day"):
        store.read_bridges(spark, path)
    with pytest.raises(ValueError, match="not partitioned by created_day"):
        store.refresh_bridges(rows, path, "2024-01-01")
    assert store.read_bridges(spark, path, "created_month").count() == 1
