"""Refreshes that survive their driver, kept first activity, and the shared status aggregate."""

from __future__ import annotations

import os
import re

import pytest
from conftest import DATA, tuples, ts

from hopmetrics import job
from hopmetrics.fixtures import feeds as fixtures
from hopmetrics.operators import cohorts
from hopmetrics.plans import reports
from hopmetrics.sources import first_activity, store

OLD = {"a": "2024-01-05", "b": "2024-02-03", "c": "2024-02-20", "d": "2024-03-09"}
NEW = {"b2": "2024-02-03", "e": "2024-02-25"}


class Lost(Exception):
    """The driver dies here."""


@pytest.fixture
def table(spark, bridge_rows):
    path = store.new_table_path(spark, "bridges")
    store.write_bridges(bridge_rows([{"id": i, "created_at": ts(d)} for i, d in OLD.items()]), path)
    return path


def ids(spark, path):
    return sorted(r.id for r in store.read_bridges(spark, path).collect())


def new_rows(bridge_rows):
    return bridge_rows([{"id": i, "created_at": ts(d)} for i, d in NEW.items()])


def lose(monkeypatch, name, when, after=False):
    """The store's function ``name`` dies at the first call whose arguments fulfil ``when``."""
    real, calls = getattr(store, name), []

    def dying(*arguments, **more):
        if when(*arguments, **more) and not calls:
            calls.append(arguments)
            if after:
                real(*arguments, **more)
            raise Lost
        return real(*arguments, **more)

    monkeypatch.setattr(store, name, dying)


@pytest.mark.parametrize(
    ("name", "when", "after", "seen"),
    [
        # before the marker: nothing has happened
        ("write_bridges", lambda rows, path, *more: ".refresh-" in path, True, "old"),
        ("_write_marker", lambda *more: True, False, "old"),
        # from the marker on: the new rows
        ("_write_marker", lambda *more: True, True, "new"),
        ("write_bridges", lambda rows, path, partition, mode="": mode == "overwrite", False, "new"),
        ("write_bridges", lambda rows, path, partition, mode="": mode == "overwrite", True, "new"),
        ("_delete", lambda spark, path: "created_day=" in path, False, "new"),
        ("_delete", lambda spark, path: "created_day=" in path, True, "new"),
        ("_delete", lambda spark, path: path.endswith(store.MARKER), False, "new"),
    ],
)
def test_a_refresh_survives_its_driver(spark, bridge_rows, table, monkeypatch, name, when, after, seen):
    with monkeypatch.context() as patch:
        lose(patch, name, when, after)
        with pytest.raises(Lost):
            store.refresh_bridges(new_rows(bridge_rows), table, "2024-02-01")
    fresh = ["a", "b2", "e"]
    assert ids(spark, table) == (sorted(OLD) if seen == "old" else fresh)
    # The next refresh completes it first: here one of a later range, which keeps what it brought.
    store.refresh_bridges(bridge_rows([{"id": "f", "created_at": ts("2024-03-01")}]), table, "2024-03-01")
    assert ids(spark, table) == (["a", "b", "c", "f"] if seen == "old" else [*fresh, "f"])
    assert not os.path.exists(f"{table}/{store.MARKER}")


def test_an_unfinished_refresh_prunes_and_is_completed_once(spark, bridge_rows, table, monkeypatch):
    with monkeypatch.context() as patch:
        lose(patch, "_write_marker", lambda *more: True, after=True)
        with pytest.raises(Lost):
            store.refresh_bridges(new_rows(bridge_rows), table, "2024-02-01")
    plan = store.read_bridges(spark, table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "created_day" in plan.split("PartitionFilters")[1]
    store.finish_refresh(spark, table)
    store.finish_refresh(spark, table)
    assert ids(spark, table) == ["a", "b2", "e"]
    days = sorted(name for name in os.listdir(table) if "=" in name)
    assert days == ["created_day=2024-01-05", "created_day=2024-02-03", "created_day=2024-02-25"]
    # New rows stay beside the table for readers that had begun, until the next refresh.
    folder, name = os.path.split(table)
    assert len([n for n in os.listdir(folder) if n.startswith(f"{name}.refresh-")]) == 1


VISITS = [
    # wallet, day, chain; x's and y's first records go away with the refresh
    ("x", "2024-01-10", "A"),
    ("x", "2024-03-05", "A"),
    ("y", "2024-02-10", "b"),
    ("y", "2024-03-05", "B"),
    ("z", "2024-01-10", "A"),
    (None, "2024-02-10", "A"),
    (None, "2024-03-06", None),
    ("z", "2024-03-06", "c"),
    ("new", "2024-03-06", "c"),
]
LATE = [("y", "2024-03-05", "B"), ("x", "2024-03-05", "A"), ("late", "2024-02-28", "a"), ("new", "2024-03-06", "c"), ("z", "2024-03-06", "c"), (None, "2024-03-06", None)]


@pytest.mark.parametrize("partition", ["created_day", "created_month"])
@pytest.mark.parametrize("start", ["2024-01-01", "2024-02-20", "2024-03-05"])
def test_reports_from_state_after_a_refresh(spark, bridge_rows, partition, start):
    def rows(visits):
        return bridge_rows(
            [{"id": f"{w}{d}", "wallet": w, "created_at": ts(d), "source_chain": c, "amount_usd": 10.0} for w, d, c in visits]
        )

    table, state = store.new_table_path(spark, "bridges"), store.new_table_path(spark, "state")
    store.write_bridges(rows(VISITS), table, partition)
    first_activity.write_state(spark, table, state, partition)
    store.refresh_bridges(rows(LATE), table, "2024-02-05", partition)
    first_activity.refresh_state(spark, table, state, "2024-02-05", partition)
    bridges = store.read_bridges(spark, table, partition)
    kept = first_activity.read_state(spark, state, partition)
    assert sorted(map(str, tuples(cohorts.first_activity_ts(kept)))) == sorted(map(str, tuples(cohorts.first_activity_ts(bridges))))
    seen = first_activity.with_history(bridges, kept, start, partition)
    end = "2024-03-31"
    for report, *more in [
        (reports.user_growth, "day"),
        (reports.status_volume_by_period, "month"),
        (reports.status_volume,),
        (reports.source_chain_status_users,),
    ]:
        whole = tuples(report(bridges, *more, start, end))
        assert whole and sorted(map(str, tuples(report(seen, *more, start, end)))) == sorted(map(str, whole))


def test_state_has_a_row_per_wallet_and_partition_and_no_timeless_rows(spark, bridge_rows):
    table, state = store.new_table_path(spark, "bridges"), store.new_table_path(spark, "state")
    visits = [("w", "2024-01-02"), ("w", "2024-01-02"), ("w", "2024-01-03"), (None, "2024-01-03"), ("w", None)]
    store.write_bridges(bridge_rows([{"wallet": w, "created_at": d and ts(d)} for w, d in visits]), table)
    first_activity.write_state(spark, table, state)
    found = first_activity.read_state(spark, state).select("wallet", "created_at").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(
        str((w, ts(d))) for w, d in [("w", "2024-01-02"), ("w", "2024-01-03"), (None, "2024-01-03")]
    )


def test_history_reads_the_late_partitions_only(spark, bridge_rows):
    table, state = store.new_table_path(spark, "bridges"), store.new_table_path(spark, "state")
    store.write_bridges(bridge_rows([{"wallet": w, "created_at": ts(d)} for w, d, _ in VISITS]), table)
    first_activity.write_state(spark, table, state)
    seen = first_activity.with_history(
        store.read_bridges(spark, table), first_activity.read_state(spark, state), "2024-03-01"
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    report = reports.user_growth(seen, "month", "2024-03-01", "2024-03-31")
    plan = report._jdf.queryExecution().sparkPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("ReadSchema: struct<created_at:timestamp_ntz,wallet:string>" in s or "ReadSchema: struct<wallet:string,created_at:timestamp_ntz>" in s for s in scans)
    table_scans = [s for s in scans if "/bridges-" in s]
    assert table_scans and all(re.search(r"PartitionFilters: \[[^]]*created_day#\d+ >= 2024-03-01", s) for s in table_scans)
    state_scans = [s for s in scans if "/state-" in s]
    assert state_scans and all(re.search(r"PartitionFilters: \[[^]]*created_day#\d+ < 2024-03-01", s) for s in state_scans)


def test_job_runs_the_status_aggregate_once_and_keeps_the_state(spark, tmp_path, monkeypatch):
    transfers, messages = f"{tmp_path}/transfers", f"{tmp_path}/messages"
    fixtures.transfers(spark, f"{DATA}/sf0.001").write.parquet(transfers)
    fixtures.messages(spark, f"{DATA}/sf0.001").write.parquet(messages)
    calls = []
    real = cohorts.status_totals
    monkeypatch.setattr(cohorts, "status_totals", lambda *a: calls.append(a) or real(*a))
    limits = {"start": "1997-03-11", "end": "1999-08-20", "as_of": fixtures.AS_OF}
    routers = {"routers": fixtures.TRANSFER_ROUTERS, "message_routers": fixtures.MESSAGE_ROUTERS}
    more = {"state": f"{tmp_path}/state", "partition": "created_month", **limits, **routers}
    job.run(spark, transfers, messages, f"{tmp_path}/table", f"{tmp_path}/first", **more)
    assert len(calls) == 1
    job.run(spark, transfers, messages, f"{tmp_path}/table", f"{tmp_path}/again", since="1998-01-01", **more)
    bridges = store.read_bridges(spark, f"{tmp_path}/table", "created_month")
    ranged = limits["start"], limits["end"]
    expected = {
        "status_volume": reports.status_volume(bridges, *ranged),
        "status_volume_by_period": reports.status_volume_by_period(bridges, "month", *ranged),
        "status_volume_wide": reports.status_volume_wide(reports.status_volume_by_period(bridges, "month", *ranged)),
        "user_growth": reports.user_growth(bridges, "month", *ranged),
        "source_chain_status_users": reports.source_chain_status_users(bridges, *ranged),
    }
    for name, report in expected.items():
        rows = sorted(map(str, tuples(report)))
        for out in ("first", "again"):
            assert rows and sorted(map(str, tuples(spark.read.parquet(f"{tmp_path}/{out}/{name}")))) == rows
    totals = spark.read.parquet(f"{tmp_path}/first/status_totals")
    for build in reports.from_status_totals("day").values():
        plan = build(totals)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "wallet" not in plan


def test_status_of_every_row_matches_the_literal_join(spark, bridge_rows):
    import random

    from test_reports import literal_status_join

    for seed, limits in [(0, (None, None)), (1, ("2024-01-05", "2024-01-20")), (2, ("2024-01-01", "2024-12-31"))]:
        pick = random.Random(seed)
        data = [
            {
                "id": f"i{pick.randrange(50)}",
                # One instant and one wallet hold a third of the rows; some have no time.
                "created_at": pick.choice([ts("2024-01-07")] * 5 + [None] + [ts(f"2024-01-{d:02d}") for d in range(1, 28)]),
                "wallet": pick.choice(["hot"] * 8 + [None, None] + [f"w{i}" for i in range(14)]),
                "amount_usd": 1.0,
                "source_chain": pick.choice(["A", "a", None]),
            }
            for _ in range(150)
        ]
        rows = bridge_rows(data + data[:20])
        start, end = limits
        joined = literal_status_join(rows, start, end).groupBy("id", "created_at", "wallet", "user_status").count()
        each = cohorts.status_rows_each(rows, start, end)
        assert each.columns == [*rows.columns, "is_new", "copies"]
        found = cohorts.status_of_each(each).groupBy("id", "created_at", "wallet", "user_status").agg({"copies": "sum"})
        assert sorted(map(str, tuples(found))) == sorted(map(str, tuples(joined)))
        in_range = rows if start is None else rows.filter(f"to_date(created_at) between '{start}' and '{end}'")
        assert each.count() == in_range.count()
        # Its totals are those of the reports.
        per_status = dict(tuples(cohorts.status_of_each(each).groupBy("user_status").agg({"copies": "sum"})))
        assert per_status == dict(tuples(cohorts.status_rows(rows, start, end)))


def test_status_of_every_row_without_rows(bridge_rows):
    assert cohorts.status_of_each(cohorts.status_rows_each(bridge_rows([]))).collect() == []


def test_status_lookup_is_salted(spark, bridge_rows, tmp_path):
    """No shuffle and no join by the instant alone, and a hot instant meets in many groups."""
    hot = [{"id": str(i), "wallet": f"w{i}", "created_at": ts("2024-01-01")} for i in range(300)]
    rest = [{"id": f"r{i}", "wallet": f"w{i}", "created_at": ts(f"2024-02-{1 + i % 28:02d}")} for i in range(600)]
    bridge_rows(hot + rest).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    old = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        each = cohorts.status_rows_each(rows)
        plan = each._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"SortMergeJoin \[(.*?)\], \[", plan)
        assert len(keys) == 2 and all("_deal" in k for k in keys)
        from pyspark.sql import functions as F

        tasks = each.filter("created_at = '2024-01-01'").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= 5 and max(r["count"] for r in tasks) < 150
        firsts = [sum(j % 28 == d for j in range(300, 600)) for d in range(28)]
        assert each.agg(F.sum("copies")).first()[0] == 300 * 300 + sum(firsts[i % 28] for i in range(600))
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
