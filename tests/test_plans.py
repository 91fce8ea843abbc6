"""What the physical plans must look like at scale."""

from __future__ import annotations

import re

import pytest
from conftest import DATA
from pyspark.errors import AnalysisException

from hopmetrics.fixtures import feeds as fixtures
from hopmetrics.operators import normalize
from hopmetrics.plans import reports
from hopmetrics.sources import feeds, store

RANGE = ("2000-01-01", "2024-12-31")


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Both feeds as Parquet, which is how they arrive."""
    folder = tmp_path_factory.mktemp("feeds")
    fixtures.transfers(spark, f"{DATA}/sf0.001").write.parquet(f"{folder}/transfers")
    fixtures.messages(spark, f"{DATA}/sf0.001").write.parquet(f"{folder}/messages")
    return folder


def relation(spark, raw, name):
    return normalize.bridges(
        feeds.read_transfers(spark, f"{raw}/transfers"),
        feeds.read_messages(spark, f"{raw}/messages"),
        fixtures.TRANSFER_ROUTERS,
        fixtures.MESSAGE_ROUTERS,
        columns=reports.COLUMNS[name],
    )


def run(spark, raw, name):
    bridges = relation(spark, raw, name)
    report = getattr(reports, name)
    if name.startswith("kpis_"):
        return report(bridges, fixtures.AS_OF)
    if name in ("activity_by_period", "user_growth", "status_volume_by_period"):
        return report(bridges, "month", *RANGE)
    return report(bridges, *RANGE)


def executed_plan(frame):
    """The final adaptive plan, initial plans cut out."""
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"\n[ :+-]*== Initial Plan ==.*?(?=\n[ :]*\+- \*\(|\Z)", "", text, flags=re.S)


@pytest.fixture(scope="module", autouse=True)
def long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", sorted(reports.COLUMNS))
def test_each_feed_is_scanned_once(spark, raw, name):
    plan = executed_plan(run(spark, raw, name))
    assert plan.count("FileScan parquet") == 2
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    # One parse per record: never inside a filter, at most once per feed.
    assert len(re.findall(r"Generate inline\(array\(from_json", plan)) <= 2
    assert not re.search(r"Filter .*from_json", plan)


@pytest.mark.parametrize("name", sorted(reports.COLUMNS))
def test_filters_reach_the_scan(spark, raw, name):
    plan = executed_plan(run(spark, raw, name))
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan)
    assert len(pushed) == 2
    for filters in pushed:
        assert "EqualTo(status,executed)" in filters
        assert "EqualTo(simplified_status,received)" in filters
        assert "(created_at," in filters


def test_wallet_reports_do_not_read_the_transfer_payload(spark, raw):
    for name in ("user_growth", "txn_count_buckets"):
        schemas = re.findall(r"ReadSchema: struct<(.*?)>", executed_plan(run(spark, raw, name)))
        transfers, messages = sorted(schemas, key=lambda s: "data" in s)
        assert "sender_address" in transfers and "data" not in transfers
        assert "data" in messages


def test_status_does_not_join(spark, raw):
    for name in ("status_volume", "status_volume_by_period", "source_chain_status_users"):
        assert "Join" not in executed_plan(run(spark, raw, name))


def test_bridge_table_round_trip_and_pruning(spark, raw):
    bridges = normalize.bridges(
        feeds.read_transfers(spark, f"{raw}/transfers"),
        feeds.read_messages(spark, f"{raw}/messages"),
        fixtures.TRANSFER_ROUTERS,
        fixtures.MESSAGE_ROUTERS,
    )
    path = store.new_table_path(spark, "bridges")
    store.write_bridges(bridges, path, partition="created_month")
    table = store.read_bridges(spark, path, partition="created_month")
    key = lambda frame: sorted(map(repr, frame.select(*normalize.COLUMNS).collect()))
    assert key(table) == key(bridges)

    narrow = reports.source_chain_breakdown(table, "2000-01-15", "2000-03-15")
    wanted = reports.source_chain_breakdown(bridges, "2000-01-15", "2000-03-15")
    assert narrow.collect() == wanted.collect()
    plan = executed_plan(narrow)
    assert "created_month#" in re.search(r"PartitionFilters: \[(.*?)\]", plan).group(1)
    read = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "fee" not in read and "raw_asset" not in read

    for name in sorted(reports.COLUMNS):
        if name.startswith("kpis_"):
            arguments = (fixtures.AS_OF,)
        elif name in ("activity_by_period", "user_growth", "status_volume_by_period"):
            arguments = ("month", *RANGE)
        else:
            arguments = RANGE
        report = getattr(reports, name)
        assert sorted(map(repr, report(table, *arguments).collect())) == sorted(
            map(repr, report(bridges, *arguments).collect())
        )


def test_tables_go_to_the_configured_folder(spark):
    assert store.new_table_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")


def test_refresh_replaces_only_the_given_days(spark, bridge_rows):
    from conftest import ts

    path = store.new_table_path(spark, "bridges")
    rows = [{"id": "a", "created_at": ts("2024-01-01")}, {"id": "b", "created_at": ts("2024-01-02")}]
    store.write_bridges(bridge_rows(rows), path)
    late = bridge_rows([{"id": "c", "created_at": ts("2024-01-02")}])
    store.write_bridges(late, path, mode="overwrite")
    assert {row.id for row in store.read_bridges(spark, path).collect()} == {"a", "c"}


def test_report_sink(spark, raw):
    path = store.new_table_path(spark, "report")
    report = run(spark, raw, "source_chain_breakdown")
    store.write_report(report, path)
    assert spark.read.parquet(path).count() == report.count()


def test_job_writes_every_report(spark, raw, tmp_path):
    from hopmetrics import job

    out = str(tmp_path / "out")
    job.run(
        spark,
        f"{raw}/transfers",
        f"{raw}/messages",
        str(tmp_path / "table"),
        out,
        start=RANGE[0],
        end=RANGE[1],
        as_of=fixtures.AS_OF,
        routers=fixtures.TRANSFER_ROUTERS,
        message_routers=fixtures.MESSAGE_ROUTERS,
        partition="created_month",
    )
    for name in reports.COLUMNS:
        written = spark.read.parquet(f"{out}/{name}").collect()
        assert sorted(map(repr, written)) == sorted(map(repr, run(spark, raw, name).collect()))
        for view, build in reports.VIEWS.get(name, {}).items():
            written = spark.read.parquet(f"{out}/{view}").collect()
            assert sorted(map(repr, written)) == sorted(map(repr, build(run(spark, raw, name)).collect()))


@pytest.mark.parametrize("partition", ["created_day", "created_month"])
def test_late_records_are_picked_up(spark, tmp_path, partition):
    import json

    from conftest import ts

    from hopmetrics import job
    from hopmetrics.sources import schemas

    def feed(rows, name):
        whole = [(i, ts(day), "w", "0xr", status, "received", "{}") for i, day, status in rows]
        path = str(tmp_path / name)
        spark.createDataFrame(whole, schemas.TRANSFER_FEED).write.parquet(path)
        return path

    payload = json.dumps({"approved": {"returnValues": {"contractAddress": "0xr"}}})
    message = [("m", ts("2024-03-20"), "executed", "received", payload)]
    messages = str(tmp_path / "messages")
    spark.createDataFrame(message, schemas.MESSAGE_FEED).write.parquet(messages)
    first = [("a", "2024-01-31", "executed"), ("b", "2024-02-05", "executed"), ("c", "2024-02-20", "pending")]
    late = [*first[:2], ("c", "2024-02-20", "executed"), ("d", "2024-03-01", "executed")]
    table = str(tmp_path / "table")
    arguments = {"routers": ["0xR"], "partition": partition}
    job.update_table(spark, feed(first, "first"), messages, table, **arguments)
    found = job.update_table(spark, feed(late, "late"), messages, table, since="2024-02-15", **arguments)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        job.update_table(spark, feed(late, "again"), messages, f"{table}-missing", since="2024-02-15", **arguments)
    assert sorted(row.id for row in found.collect()) == ["a", "b", "c", "d", "m"]


def test_feeds_from_the_catalog(spark, raw):
    from_path = feeds.read_messages(spark, f"{raw}/messages")
    from_path.createOrReplaceTempView("message_feed")
    from_view = feeds.read_messages(spark, "message_feed")
    assert from_view.schema == from_path.schema
    assert from_view.count() == from_path.count()
