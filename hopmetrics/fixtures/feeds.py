"""Set A of FIXTURES.md: both raw feeds, payload included, from the test tables."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hopmetrics.operators import normalize

TRANSFER_ROUTERS = ("Red", "BLUE", "green")
MESSAGE_ROUTERS = ("Click", "VIEW", "purchase")
START, END, AS_OF = "1995-01-01", "2024-12-31", "2024-01-30"
MID_START, MID_END = "1997-03-11", "1999-08-20"

ASSET_OF_TYPE = {
    "PROMO": "uusdc",
    "LARGE": "weth-wei",
    "SMALL": "factory/sei10hubX",
    "ECONOMY": "uatom",
    "MEDIUM": "other-medium",
}


@functools.cache
def _schema(spark: SparkSession, path: str) -> StructType:
    """Schema in the footer, looked up once per session instead of once per query."""
    return spark.read.parquet(path).schema


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def _transfer_payload(amount: Column, asset: Column) -> Column:
    return F.to_json(
        F.struct(
            F.struct(
                amount.alias("amount"),
                F.col("source_name").alias("original_source_chain"),
                F.col("destination_name").alias("original_destination_chain"),
                F.col("l_tax").cast("string").alias("fee_value"),
            ).alias("send"),
            F.struct(F.col("p_retailprice").alias("price"), asset.alias("asset")).alias("link"),
        )
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer feed: one record per order line."""
    nation = _table(spark, sf_dir, "nation")
    source = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source_name"))
    destination = nation.select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("destination_name")
    )
    lines = (
        _table(spark, sf_dir, "lineitem")
        .join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(source, "c_nationkey")
        .join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(destination, "s_nationkey")
        .join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    asset = F.coalesce(*(F.when(F.col("p_type") == t, a) for t, a in ASSET_OF_TYPE.items()))
    text = F.when(F.col("l_linenumber") == 6, "n/a").otherwise(F.col("l_quantity").cast("string"))
    # Line 7 carries a real JSON array where a number is expected.
    data = F.when(
        F.col("l_linenumber") == 7, _transfer_payload(F.array(F.lit(1), F.lit(2)), asset)
    ).otherwise(_transfer_payload(text, asset))
    return lines.select(
        F.concat(F.lit("T"), F.col("l_orderkey")).alias("id"),
        F.col("l_shipdate").alias("created_at"),
        F.col("c_name").alias("recipient_address"),
        F.concat(F.lit("0x"), F.upper("p_name")).alias("sender_address"),
        F.when(F.col("l_linestatus") == "F", "executed").otherwise("pending").alias("status"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("received").alias("simplified_status"),
        data.alias("data"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message feed: one record per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.col("event_type")
    data = F.to_json(
        F.struct(
            F.col("value").alias("amount"),
            F.round(F.col("value") * k, 2).alias("value"),
            F.upper(event).alias("symbol"),
            F.struct(F.when(k < 90, k).alias("gas_used_amount")).alias("gas"),
            F.struct(
                F.struct(F.struct(F.col("value").alias("usd")).alias("token_price")).alias("source_token")
            ).alias("gas_price_rate"),
            F.struct(F.when(k >= 95, k).alias("express_fee_usd")).alias("fees"),
            F.struct(
                F.struct(F.concat(F.lit("0x"), F.upper(event)).alias("contractAddress")).alias("returnValues")
            ).alias("approved"),
            F.struct(
                F.concat(F.lit("NATION_"), k % 25).alias("chain"),
                F.struct(F.concat(F.lit("NATION_"), F.col("user_id") % 25).alias("destinationChain")).alias(
                    "returnValues"
                ),
                F.struct(
                    F.when(F.col("user_id") % 50 != 0, F.concat(F.lit("U"), F.col("user_id"))).alias("from")
                ).alias("transaction"),
            ).alias("call"),
        )
    )
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("G"), F.col("event_id")).alias("id"),
        F.col("ts").alias("created_at"),
        F.when(event == "error", "error").otherwise("executed").alias("status"),
        F.lit("received").alias("simplified_status"),
        data.alias("data"),
    )


def bridges(spark: SparkSession, sf_dir: str, columns: Sequence[str] = normalize.COLUMNS) -> DataFrame:
    """The bridge relation of both feeds, message chains as spelled."""
    return normalize.bridges(
        transfers(spark, sf_dir),
        messages(spark, sf_dir),
        TRANSFER_ROUTERS,
        MESSAGE_ROUTERS,
        columns=columns,
    )
