"""Display labels of raw asset names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Raw asset -> label.
ASSET_LABELS = {
    "arb-wei": "ARB",
    "avalanche-uusdc": "Avalanche USDC",
    "avax-wei": "AVAX",
    "bnb-wei": "BNB",
    "busd-wei": "BUSD",
    "cbeth-wei": "cbETH",
    "cusd-wei": "cUSD",
    "dai-wei": "DAI",
    "dot-planck": "DOT",
    "eeur": "EURC",
    "ern-wei": "ERN",
    "eth-wei": "ETH",
    "factory/sei10hud5e5er4aul2l7sp2u9qp2lag5u4xf8mvyx38cnjvqhlgsrcls5qn5ke/seilor": "SEILOR",
    "fil-wei": "FIL",
    "frax-wei": "FRAX",
    "ftm-wei": "FTM",
    "glmr-wei": "GLMR",
    "hzn-wei": "HZN",
    "link-wei": "LINK",
    "matic-wei": "MATIC",
    "mkr-wei": "MKR",
    "mpx-wei": "MPX",
    "oath-wei": "OATH",
    "op-wei": "OP",
    "orbs-wei": "ORBS",
    "pepe-wei": "PEPE",
    "polygon-uusdc": "Polygon USDC",
    "reth-wei": "rETH",
    "ring-wei": "RING",
    "shib-wei": "SHIB",
    "sonne-wei": "SONNE",
    "stuatom": "stATOM",
    "uatom": "ATOM",
    "uaxl": "AXL",
    "ukuji": "KUJI",
    "ulava": "LAVA",
    "uluna": "LUNA",
    "ungm": "NGM",
    "uni-wei": "UNI",
    "uosmo": "OSMO",
    "usomm": "SOMM",
    "ustrd": "STRD",
    "utia": "TIA",
    "uumee": "UMEE",
    "uusd": "USTC",
    "uusdc": "USDC",
    "uusdt": "USDT",
    "vela-wei": "VELA",
    "wavax-wei": "WAVAX",
    "wbnb-wei": "WBNB",
    "wbtc-satoshi": "WBTC",
    "weth-wei": "WETH",
    "wfil-wei": "WFIL",
    "wftm-wei": "WFTM",
    "wglmr-wei": "WGLMR",
    "wmai-wei": "WMAI",
    "wmatic-wei": "WMATIC",
    "wsteth-wei": "wstETH",
    "yield-eth-wei": "yieldETH",
}
# Case-insensitive prefixes and their label.
ASSET_PREFIXES = {"factory/sei10hub": "SEILOR"}


def label_dimension(spark: SparkSession, labels: dict[str, str] = ASSET_LABELS) -> DataFrame:
    """The label map as a two-column local relation."""
    rows = F.array(*(F.struct(F.lit(raw), F.lit(label)) for raw, label in labels.items()))
    return spark.range(1).select(F.inline(rows.cast("array<struct<asset:string,asset_label:string>>")))


def _prefix_label(raw: Column) -> Column:
    return F.coalesce(
        *(F.when(raw.ilike(f"{prefix}%"), label) for prefix, label in ASSET_PREFIXES.items())
    )


def with_asset_label(rows: DataFrame, labels: dict[str, str] = ASSET_LABELS) -> DataFrame:
    """Add ``symbol``: exact label, else prefix label, else the raw name.

    The planner sees the size of the labels and broadcasts what is small. No
    exact key starts with a prefix that has another label, so the order of the
    two rules does not matter.
    """
    raw = F.col("raw_asset")
    dimension = label_dimension(rows.sparkSession, labels)
    return (
        rows.join(dimension, raw == F.col("asset"), "left")
        .withColumn("symbol", F.coalesce("asset_label", _prefix_label(raw), raw))
        .drop("asset", "asset_label")
    )
