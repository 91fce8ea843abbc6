
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmetrics.fixtures import feeds
from hopmetrics.fixtures.feeds import (
    AS_OF,
    END,
    MESSAGE_ROUTERS,
    MID_END,
    MID_START,
    START,
    TRANSFER_ROUTERS,
)
from hopmetrics.functions import usd
from hopmetrics.functions.assets import with_asset_label
from hopmetrics.functions.calendar import bucket, date_range, trailing_days
from hopmetrics.functions.numeric import clean_double, safe_product
from hopmetrics.operators import cohorts, normalize, profile
from hopmetrics.plans import reports
from hopmetrics.sources import first_activity, store

Query = Callable[[SparkSession, str], DataFrame]


def _rows() -> Column:
    return F.count(F.lit(1)).alias("rows")


def _on_bridges(operator: Callable[..., DataFrame], *arguments, columns=normalize.COLUMNS) -> Query:
    return lambda spark, sf_dir: operator(feeds.bridges(spark, sf_dir, columns), *arguments)


def _report(name: str, *arguments) -> Query:
    return _on_bridges(getattr(reports, name), *arguments, columns=reports.COLUMNS[name])


def scan(feed: Callable[[SparkSession, str], DataFrame]) -> Query:
    return lambda spark, sf_dir: feed(spark, sf_dir).groupBy("status", "simplified_status").agg(_rows())


def payload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counts(feed: str, decoded: DataFrame) -> DataFrame:
        leaves = [c for c in decoded.columns if c.startswith("p_")]
        totals = decoded.agg(_rows(), *(F.count(c).alias(c) for c in leaves))
        lines = [
            F.struct(F.lit(c.removeprefix("p_")).alias("leaf"), "rows", F.col(c).alias("non_null"))
            for c in leaves
        ]
        return totals.select(F.lit(feed).alias("feed"), F.inline(F.array(*lines)))

    transfers = normalize.decode_transfers(feeds.transfers(spark, sf_dir))
    messages = normalize.decode_messages(feeds.messages(spark, sf_dir))
    return counts("transfers", transfers).unionByName(counts("messages", messages))


def _leaves(decoded: DataFrame) -> DataFrame:
    return decoded.select("id", *(c for c in decoded.columns if c.startswith("p_")))


def payload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(normalize.decode_messages(feeds.messages(spark, sf_dir)))


def payload_paths_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(normalize.decode_transfers(feeds.transfers(spark, sf_dir)))


def numeric_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount, price = F.col("p_amount"), F.col("p_price")
    return normalize.decode_transfers(feeds.transfers(spark, sf_dir)).select(
        "id",
        amount.alias("amount_text"),
        clean_double(amount).alias("amount"),
        clean_double(price).alias("price"),
        safe_product(amount, price).alias("product"),
    )


def settled_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.settled(feeds.transfers(spark, sf_dir)).select("id")


def router_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.routed_transfers(feeds.transfers(spark, sf_dir), TRANSFER_ROUTERS)
    return rows.select("id", "sender_address")


def router_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = normalize.decode_messages(feeds.messages(spark, sf_dir))
    rows = normalize.routed_messages(decoded, MESSAGE_ROUTERS)
    return rows.select("id", F.col("p_contract_address").alias("contract_address"))


def transfers_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_transfers(feeds.transfers(spark, sf_dir), TRANSFER_ROUTERS)


def messages_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_messages(feeds.messages(spark, sf_dir), MESSAGE_ROUTERS)


def message_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_normalized(spark, sf_dir).select("id", "fee")


def _per_service(rows: DataFrame) -> DataFrame:
    return rows.groupBy("service").agg(_rows())


def bridges_union(bridges: DataFrame) -> DataFrame:
    return bridges.groupBy("service").agg(_rows(), F.count_distinct("id").alias("ids"))


def service_summary(bridges: DataFrame) -> DataFrame:
    return bridges.groupBy("service").agg(
        _rows(),
        F.count("amount").alias("amounts"),
        F.count("fee").alias("fees"),
        usd.sum_exact(F.col("amount_usd")).alias("volume"),
        usd.sum_exact(F.col("fee")).alias("fee_total"),
    )


def large_totals(bridges: DataFrame) -> DataFrame:
    """Totals of amounts far above the cents of a double, part of which cancel out."""
    dollars = F.floor("amount_usd").cast("double")
    amounts = F.array(dollars * 2.0**80, dollars * 1e12, dollars * -(2.0**80))
    return (
        bridges.filter("amount_usd IS NOT NULL")
        .select("service", F.explode(amounts).alias("usd"))
        .groupBy("service")
        .agg(usd.sum_exact(F.col("usd")).alias("total"), usd.sum_rounded(F.abs("usd")).alias("turnover"))
    )


def _both_spellings(bridges: DataFrame) -> DataFrame:
    """Each row once as spelled and once in lower case, from one scan."""
    variants = F.array(
        F.struct(F.lit("as spelled").alias("variant"), "source_chain", "destination_chain"),
        F.struct(
            F.lit("lower case").alias("variant"),
            F.lower("source_chain").alias("source_chain"),
            F.lower("destination_chain").alias("destination_chain"),
        ),
    )
    return bridges.select(F.inline(variants))


def chain_case(bridges: DataFrame) -> DataFrame:
    return _both_spellings(bridges).groupBy("variant", "source_chain").agg(_rows())


def unique_routes(bridges: DataFrame) -> DataFrame:
    rows = _both_spellings(bridges)
    return rows.groupBy("variant").agg(F.count_distinct(normalize.route()).alias("routes"))


def median_by_period(bridges: DataFrame, start, end) -> DataFrame:
    rows = date_range(bridges, start, end).withColumn("date", bucket("month", F.col("created_at")))
    values = profile.entries(rows, ["date"], {}, F.col("amount_usd"))
    return profile.medians(values, ["date"])


def status_rows_each(bridges: DataFrame, start=None, end=None) -> DataFrame:
    """Status and copies of every row, ids of several rows together."""
    each = cohorts.status_of_each(cohorts.status_rows_each(bridges, start, end))
    return each.groupBy("id", "created_at", "user_status").agg(F.sum("copies").alias("copies"))


def asset_label(bridges: DataFrame) -> DataFrame:
    labelled = with_asset_label(bridges)
    return labelled.groupBy("raw_asset", F.col("symbol").alias("label")).agg(_rows())


def bridge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the relation, read it back by partition, and report from it."""
    path = store.new_table_path(spark, "bridges")
    store.write_bridges(feeds.bridges(spark, sf_dir), path, partition="created_month")
    bridges = store.read_bridges(spark, path, partition="created_month")
    return reports.activity_by_period(bridges, "month", START, END)


def bridge_table_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh a table whose late rows are out of date and in other months, and report from it."""
    path = store.new_table_path(spark, "bridges")
    relation = feeds.bridges(spark, sf_dir)
    since = "1998-06-15"
    late = F.col("created_at") >= F.lit("1998-06-01").cast("timestamp_ntz")
    moved = F.when(late, F.col("created_at") + F.expr("INTERVAL 60 MONTH")).otherwise(F.col("created_at"))
    store.write_bridges(relation.withColumn("created_at", moved), path, partition="created_month")
    store.refresh_bridges(relation, path, since, partition="created_month")
    bridges = store.read_bridges(spark, path, partition="created_month")
    return reports.activity_by_period(bridges, "month", START, END)


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Table and first activity after a refresh; before it, records of some wallets were earlier by years."""
    table, state = (store.new_table_path(spark, name) for name in ("bridges", "first-activity"))
    relation = feeds.bridges(spark, sf_dir)
    since, partition = "1994-01-01", "created_month"
    early = F.pmod(F.xxhash64("wallet"), F.lit(3)) == 0
    moved = F.when(early, F.greatest(F.col("created_at") - F.expr("INTERVAL 24 MONTH"), F.lit(since).cast("timestamp_ntz")))
    store.write_bridges(relation.withColumn("created_at", F.coalesce(moved, "created_at")), table, partition)
    first_activity.write_state(spark, table, state, partition)
    store.refresh_bridges(relation, table, since, partition)
    first_activity.refresh_state(spark, table, state, since, partition)
    return store.read_bridges(spark, table, partition), first_activity.read_state(spark, state, partition)


def _from_state(report: Callable[..., DataFrame], *arguments) -> Query:
    """A report on users over the middle range, with the history before it from the kept state."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bridges, state = _refreshed(spark, sf_dir)
        return report(first_activity.with_history(bridges, state, MID_START, "created_month"), *arguments, MID_START, MID_END)

    return run


def first_activity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.first_activity_ts(_refreshed(spark, sf_dir)[1])


def _from_status_totals(report: str) -> Query:
    """A report from the stored status aggregate."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = store.new_table_path(spark, "status-totals")
        totals = cohorts.status_totals(feeds.bridges(spark, sf_dir, USD), START, END)
        store.write_report(totals, path)
        return reports.from_status_totals("month")[report](spark.read.schema(totals.schema).parquet(path))

    return run


GRAIN_REPORTS = ("activity_by_period", "user_growth", "status_volume_by_period")
TRAILING_REPORTS = ("kpis_7d", "kpis_30d")


def report_arguments(name: str, start: str = START, end: str = END) -> tuple:
    if name in TRAILING_REPORTS:
        return (AS_OF,)
    return ("month", start, end) if name in GRAIN_REPORTS else (start, end)


REPORTS: dict[str, Query] = {name: _report(name, *report_arguments(name)) for name in reports.COLUMNS}

OTHER_GRAINS: dict[str, Query] = {
    f"{name}_{grain}": _report(name, grain, START, END)
    for name in GRAIN_REPORTS
    for grain in ("week", "day")
}

# A range with history before and after it, both ends inside a month.
MID_RANGE: dict[str, Query] = {
    f"{name}_mid_range": _report(name, *report_arguments(name, MID_START, MID_END))
    for name in reports.COLUMNS
    if name not in TRAILING_REPORTS
}



def _view(report: str, view: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: view(REPORTS[report](spark, sf_dir))


VIEWS: dict[str, Query] = {
    name: _view(report, view) for report, views in reports.VIEWS.items() for name, view in views.items()
}

ACTIVITY = reports.COLUMNS["user_growth"]
USD = reports.COLUMNS["status_volume"]
EACH = ("created_at", "wallet", "id")

OPERATORS: dict[str, Query] = {
    "scan_transfers": scan(feeds.transfers),
    "scan_messages": scan(feeds.messages),
    "payload_decode": payload_decode,
    "payload_paths": payload_paths,
    "payload_paths_transfers": payload_paths_transfers,
    "numeric_clean": numeric_clean,
    "settled_transfers": settled_transfers,
    "router_transfers": router_transfers,
    "router_messages": router_messages,
    "date_range": _on_bridges(
        lambda bridges: _per_service(date_range(bridges, START, END)), columns=("created_at", "service")
    ),
    "trailing_days": _on_bridges(
        lambda bridges: _per_service(trailing_days(bridges, 7, AS_OF)), columns=("created_at", "service")
    ),
    "transfers_normalized": transfers_normalized,
    "messages_normalized": messages_normalized,
    "bridges_union": _on_bridges(bridges_union, columns=("service", "id")),
    "service_summary": _on_bridges(service_summary, columns=("service", "amount", "amount_usd", "fee")),
    "large_totals": _on_bridges(large_totals, columns=("service", "amount_usd")),
    "message_fee": message_fee,
    "chain_case": _on_bridges(chain_case, columns=("source_chain", "destination_chain")),
    "unique_routes": _on_bridges(unique_routes, columns=("source_chain", "destination_chain")),
    "median_by_period": _on_bridges(median_by_period, START, END, columns=("created_at", "amount_usd")),
    "first_activity_ts": _on_bridges(cohorts.first_activity_ts, columns=ACTIVITY),
    "first_activity_date": _on_bridges(cohorts.first_activity_date, columns=ACTIVITY),
    "users_by_period": _on_bridges(cohorts.users_by_period, "month", START, END, columns=ACTIVITY),
    "new_users_by_period": _on_bridges(cohorts.new_users_by_period, "month", START, END, columns=ACTIVITY),
    "status_rows_each": _on_bridges(status_rows_each, columns=EACH),
    "status_rows_each_mid_range": _on_bridges(status_rows_each, MID_START, MID_END, columns=EACH),
    "status_join": _on_bridges(cohorts.status_rows, columns=USD),
    "asset_label": _on_bridges(asset_label, columns=("raw_asset",)),
    "first_activity_state": first_activity_state,
    "user_growth_from_state": _from_state(reports.user_growth, "month"),
    "status_volume_by_period_from_state": _from_state(reports.status_volume_by_period, "month"),
    "status_volume_from_state": _from_state(reports.status_volume),
    "source_chain_status_users_from_state": _from_state(reports.source_chain_status_users),
    "status_volume_by_period_from_totals": _from_status_totals("status_volume_by_period"),
    "status_volume_from_totals": _from_status_totals("status_volume"),
    "bridge_table": bridge_table,
    "bridge_table_refresh": bridge_table_refresh,
}


def queries() -> dict[str, Query]:
    return {**REPORTS, **OTHER_GRAINS, **MID_RANGE, **VIEWS, **OPERATORS}
