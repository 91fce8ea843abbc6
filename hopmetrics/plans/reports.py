"""The thirteen reports over the bridge relation (message chains as spelled), and
the views drawn from them.

Each takes the relation from ``operators.normalize.bridges`` or, cheaper when
several run, from ``sources.store.read_bridges``. Dates are inclusive; ``grain``
is day, week or month. Ties in a descending order are broken by the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmetrics.functions import usd
from hopmetrics.functions.assets import with_asset_label
from hopmetrics.functions.buckets import amount_bucket, count_bucket
from hopmetrics.functions.calendar import bucket, date_range, trailing_days
from hopmetrics.operators import cohorts, shares
from hopmetrics.operators.normalize import route
from hopmetrics.operators.profile import profile

# Columns of the bridge relation each report reads. When a report runs straight
# from the feeds, pass them to ``bridges`` so that only their leaves are decoded.
COLUMNS = {
    "period_kpis": (
        "created_at", "id", "wallet", "amount_usd", "raw_asset", "source_chain", "destination_chain",
    ),
    "kpis_7d": ("created_at", "id", "wallet", "amount_usd"),
    "kpis_30d": ("created_at", "id", "wallet", "amount_usd"),
    "activity_by_period": ("created_at", "id", "wallet", "amount_usd"),
    "user_growth": ("created_at", "wallet"),
    "status_volume_by_period": ("created_at", "wallet", "amount_usd"),
    "status_volume": ("created_at", "wallet", "amount_usd"),
    "source_chain_status_users": ("created_at", "wallet", "source_chain"),
    "txn_count_buckets": ("created_at", "id", "wallet"),
    "amount_buckets": ("created_at", "id", "amount_usd"),
    "asset_breakdown": ("created_at", "id", "amount_usd", "raw_asset"),
    "source_chain_breakdown": ("created_at", "id", "wallet", "amount_usd", "source_chain"),
    "dest_chain_breakdown": ("created_at", "id", "wallet", "amount_usd", "destination_chain"),
}


def period_kpis(bridges: DataFrame, start, end) -> DataFrame:
    """Headline indicators of the range, one row."""
    found = profile(
        date_range(bridges, start, end),
        by=[],
        distinct={
            "bridges": F.col("id"),
            "users": F.col("wallet"),
            "tokens": F.col("raw_asset"),
            "routes": route(),
        },
        value=F.col("amount_usd"),
    )
    return found.select(
        "bridges",
        "users",
        F.col("total").alias("volume"),
        "tokens",
        F.round("maximum").alias("max_amount"),
        F.round("average").alias("avg_amount"),
        F.round("median").alias("median_amount"),
        "routes",
    )


def trailing_kpis(bridges: DataFrame, days: int, as_of=None) -> DataFrame:
    """Bridges, users and volume of the last ``days`` days, one row."""
    return trailing_days(bridges, days, as_of).agg(
        F.count_distinct("id").alias("bridges"),
        F.count_distinct("wallet").alias("users"),
        usd.sum_rounded(F.col("amount_usd")).alias("volume"),
    )


def kpis_7d(bridges: DataFrame, as_of=None) -> DataFrame:
    return trailing_kpis(bridges, 7, as_of)


def kpis_30d(bridges: DataFrame, as_of=None) -> DataFrame:
    return trailing_kpis(bridges, 30, as_of)


def activity_by_period(bridges: DataFrame, grain: str, start, end) -> DataFrame:
    """Bridges, volume, median amount and users per bucket."""
    rows = date_range(bridges, start, end).withColumn("date", bucket(grain, F.col("created_at")))
    found = profile(
        rows,
        by=["date"],
        distinct={"bridges": F.col("id"), "users": F.col("wallet")},
        value=F.col("amount_usd"),
    )
    return found.select(
        "date",
        "bridges",
        F.col("total").alias("volume"),
        F.round("median").alias("median_amount"),
        "users",
    ).orderBy("date")


def user_growth(bridges: DataFrame, grain: str, start, end) -> DataFrame:
    """Total, new and returning users per bucket, and cumulative new users."""
    return cohorts.user_growth(bridges, grain, start, end)


def status_volume_by_period(bridges: DataFrame, grain: str, start, end) -> DataFrame:
    """Volume of new and returning users per bucket."""
    return cohorts.status_volume(bridges, start, end, grain).orderBy("date", "user_status")


def status_volume(bridges: DataFrame, start, end) -> DataFrame:
    """Volume of new and returning users."""
    return cohorts.status_volume(bridges, start, end)


def source_chain_status_users(bridges: DataFrame, start, end) -> DataFrame:
    """New and old users per source chain (chain names in lower case)."""
    found = cohorts.status_users_by_chain(bridges, start, end)
    return found.orderBy(F.desc("users"), "source_chain", "user_status")


def txn_count_buckets(bridges: DataFrame, start, end) -> DataFrame:
    """Users by their number of bridges.

    Rows without a wallet count as one user group that has a class but adds no
    user to it; wallets are unique after the inner aggregation.
    """
    per_user = date_range(bridges, start, end).groupBy("wallet").agg(
        count_bucket(F.count_distinct("id")).alias("txn_bucket")
    )
    return (
        per_user.groupBy("txn_bucket")
        .agg(F.count("wallet").alias("users"))
        .orderBy(F.desc("users"), "txn_bucket")
    )


def amount_buckets(bridges: DataFrame, start, end) -> DataFrame:
    """Bridges by USD amount; an id with rows in two classes counts in both."""
    return (
        date_range(bridges, start, end)
        .filter(F.col("amount_usd").isNotNull())
        .groupBy(amount_bucket(F.col("amount_usd")).alias("amount_bucket"))
        .agg(F.count_distinct("id").alias("transactions"))
        .orderBy(F.desc("transactions"), "amount_bucket")
    )


def asset_breakdown(bridges: DataFrame, start, end) -> DataFrame:
    """Bridges and volume per asset label; rows without an asset drop out."""
    rows = date_range(bridges, start, end).filter(F.col("raw_asset").isNotNull())
    return (
        with_asset_label(rows)
        .groupBy("symbol")
        .agg(
            F.count_distinct("id").alias("bridges"),
            usd.sum_rounded(F.col("amount_usd")).alias("volume"),
        )
        .orderBy(F.desc("bridges"), "symbol")
    )


def _chain_breakdown(bridges: DataFrame, chain: str, start, end) -> DataFrame:
    return (
        date_range(bridges, start, end)
        .groupBy(chain)
        .agg(
            F.count_distinct("id").alias("bridges"),
            F.count_distinct("wallet").alias("users"),
            usd.sum_rounded(F.col("amount_usd")).alias("volume"),
        )
        .orderBy(F.desc("bridges"), chain)
    )


def source_chain_breakdown(bridges: DataFrame, start, end) -> DataFrame:
    """Bridges, users and volume per source chain; a missing chain is a group."""
    return _chain_breakdown(bridges, "source_chain", start, end)


def dest_chain_breakdown(bridges: DataFrame, start, end) -> DataFrame:
    """Bridges, users and volume per destination chain."""
    return _chain_breakdown(bridges, "destination_chain", start, end)


def from_status_totals(grain: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The two reports on volume by status, from the written rows of ``cohorts.status_totals``.

    The costly part, by wallet and instant, is done once for both and for any grain; what
    is left adds up a row per instant and status.
    """
    return {
        "status_volume_by_period": lambda totals: cohorts.status_volume_of(totals, grain).orderBy("date", "user_status"),
        "status_volume": cohorts.status_volume_of,
    }


# Views: what the charts add to a finished report (a few rows).


def status_volume_share(volume: DataFrame) -> DataFrame:
    """``status_volume_by_period`` with the percentage of each bucket's volume."""
    return shares.share_within(volume, ["date"], "volume").orderBy("date", "user_status")


def status_volume_wide(volume: DataFrame) -> DataFrame:
    """``status_volume_by_period`` with one column per user status."""
    names = {cohorts.NEW: "new_volume", cohorts.RETURNING: "returning_volume"}
    return shares.widen(volume, "date", "user_status", names, "volume").orderBy("date")


def status_volume_total(volume: DataFrame) -> DataFrame:
    """``status_volume`` with 0 instead of a missing volume."""
    return shares.total_by(volume, "user_status", "volume")


def slices(key: str, *sizes: str) -> Callable[[DataFrame], DataFrame]:
    """View of a report as shares of the whole: a slice name and its sizes."""
    return lambda report: shares.share_of_total(report.select(key, *sizes), sizes)


VIEWS: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {
    "status_volume_by_period": {
        "status_volume_share": status_volume_share,
        "status_volume_wide": status_volume_wide,
    },
    "status_volume": {
        "status_volume_total": status_volume_total,
        "status_share": slices("user_status", "volume"),
    },
    "txn_count_buckets": {"txn_bucket_share": slices("txn_bucket", "users")},
    "amount_buckets": {"amount_bucket_share": slices("amount_bucket", "transactions")},
    "asset_breakdown": {"asset_share": slices("symbol", "volume", "bridges")},
    "source_chain_breakdown": {"share_of_total": slices("source_chain", "volume", "bridges")},
    "dest_chain_breakdown": {"dest_chain_share": slices("destination_chain", "volume", "bridges")},
}
