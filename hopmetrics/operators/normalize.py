"""From the raw feeds to the bridge relation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmetrics.functions.numeric import clean_double, fee_with_fallback, safe_product
from hopmetrics.sources import schemas

# The router contracts whose traffic is analysed.
ROUTERS = (
    "0xce16F69375520ab01377ce7B88f5BA8C48F8D666",  # main
    "0x492751eC3c57141deb205eC2da8bFcb410738630",  # blast
    "0xDC3D8e1Abe590BCa428a8a2FC4CfDbD1AcF57Bd9",  # fraxtal
    "0xdf4fFDa22270c12d0b5b3788F1669D709476111E",  # coral
    "0xe6B3949F9bBF168f4E3EFc82bc8FD849868CC6d8",  # coral hub
)
TRANSFER_SERVICE = "Token Transfers"
MESSAGE_SERVICE = "GMP"

# Columns of the bridge relation, and the payload leaves each one is made from
# (others come from the envelope).
COLUMNS = (
    "created_at",
    "source_chain",
    "destination_chain",
    "wallet",
    "amount",
    "amount_usd",
    "fee",
    "id",
    "service",
    "raw_asset",
)
TRANSFER_LEAVES_OF = {
    "source_chain": ("source_chain",),
    "destination_chain": ("destination_chain",),
    "amount": ("amount",),
    "amount_usd": ("amount", "price"),
    "fee": ("fee_value",),
    "raw_asset": ("asset",),
}
MESSAGE_LEAVES_OF = {
    "source_chain": ("source_chain",),
    "destination_chain": ("destination_chain",),
    "wallet": ("sender",),
    "amount": ("amount",),
    "amount_usd": ("value",),
    "fee": ("gas_used", "token_usd", "express_fee"),
    "raw_asset": ("symbol",),
}


def settled(feed: DataFrame) -> DataFrame:
    """Executed and received records; both equalities reach the Parquet scan."""
    return feed.filter((F.col("status") == "executed") & (F.col("simplified_status") == "received"))


def mentions_any(column: str, texts: Sequence[str]) -> Column:
    """Case-insensitive: ``column`` contains one of ``texts``.

    One ILIKE ANY rather than an OR of ILIKEs, so that ``column`` is evaluated
    once per row. Addresses hold no wildcard, quote or escape character.
    """
    for text in texts:
        if not text or set(text) & set("%_'\\"):
            raise ValueError(f"not a plain address: {text!r}")
    patterns = ", ".join(f"'%{text}%'" for text in texts)
    return F.expr(f"{column} ILIKE ANY ({patterns})")


def decode(feed: DataFrame, leaves: dict[str, str], names: Iterable[str] | None = None) -> DataFrame:
    """Replace ``data`` by one text column per payload leaf, prefixed ``p_``.

    ``names`` picks some of the ``leaves``; without any the payload is not read.
    Malformed JSON, JSON null and missing paths give NULL. The struct goes
    through ``inline`` because a filter on a leaf would otherwise be pushed below
    the projection and parse the payload again, once per mention.
    """
    envelope = [c for c in feed.columns if c != "data"]
    wanted = {n: path for n, path in leaves.items() if names is None or n in set(names)}
    if not wanted:
        return feed.select(*envelope)
    payload = F.from_json("data", schemas.payload_type(wanted.values()))
    return feed.select(*envelope, F.inline(F.array(payload))).select(
        *envelope, *(F.col(path).alias(f"p_{name}") for name, path in wanted.items())
    )


def decode_transfers(feed: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    return decode(feed, schemas.TRANSFER_LEAVES, names)


def decode_messages(feed: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    return decode(feed, schemas.MESSAGE_LEAVES, names)


def routed_transfers(feed: DataFrame, routers: Sequence[str] = ROUTERS) -> DataFrame:
    """Transfers sent by a router (tested on the envelope, before any decoding)."""
    return feed.filter(mentions_any("sender_address", routers))


def routed_messages(decoded: DataFrame, routers: Sequence[str] = ROUTERS) -> DataFrame:
    """Decoded messages approved for a router contract."""
    return decoded.filter(mentions_any("p_contract_address", routers))


def _leaves_of(columns: Iterable[str], leaves: dict[str, tuple[str, ...]]) -> set[str]:
    return {leaf for column in columns for leaf in leaves.get(column, ())}


def normalize_transfers(
    feed: DataFrame, routers: Sequence[str] = ROUTERS, columns: Sequence[str] = COLUMNS
) -> DataFrame:
    """The transfer feed as bridge rows."""
    rows = routed_transfers(settled(feed), routers)
    rows = decode_transfers(rows, _leaves_of(columns, TRANSFER_LEAVES_OF))
    made = {
        "source_chain": F.lower("p_source_chain"),
        "destination_chain": F.lower("p_destination_chain"),
        "wallet": F.col("recipient_address"),
        "amount": clean_double(F.col("p_amount")),
        "amount_usd": safe_product(F.col("p_amount"), F.col("p_price")),
        "fee": clean_double(F.col("p_fee_value")),
        "service": F.lit(TRANSFER_SERVICE),
        "raw_asset": F.col("p_asset"),
    }
    return rows.select(*(made.get(name, F.col(name)).alias(name) for name in columns))


def normalize_messages(
    feed: DataFrame, routers: Sequence[str] = ROUTERS, columns: Sequence[str] = COLUMNS
) -> DataFrame:
    """The message feed as bridge rows, chain names as spelled."""
    needed = _leaves_of(columns, MESSAGE_LEAVES_OF) | {"contract_address"}
    rows = routed_messages(decode_messages(settled(feed), needed), routers)
    made = {
        "source_chain": F.col("p_source_chain"),
        "destination_chain": F.col("p_destination_chain"),
        "wallet": F.col("p_sender"),
        "amount": clean_double(F.col("p_amount")),
        "amount_usd": clean_double(F.col("p_value")),
        "fee": fee_with_fallback(
            F.col("p_gas_used"), F.col("p_token_usd"), F.col("p_express_fee")
        ),
        "service": F.lit(MESSAGE_SERVICE),
        "raw_asset": F.col("p_symbol"),
    }
    return rows.select(*(made.get(name, F.col(name)).alias(name) for name in columns))


def bridges(
    transfers: DataFrame,
    messages: DataFrame,
    transfer_routers: Sequence[str] = ROUTERS,
    message_routers: Sequence[str] | None = None,
    lower_message_chains: bool = False,
    columns: Sequence[str] = COLUMNS,
) -> DataFrame:
    """Both feeds as one relation, duplicates kept.

    Message chain names keep their spelling unless ``lower_message_chains``;
    transfer chains are always lower case. The reports take the relation as
    spelled and lower the names themselves where they need to. ``columns``
    narrows the relation before decoding: a payload leaf that no column needs is
    not decoded, and the transfer payload is not even read for wallet activity.
    """
    if message_routers is None:
        message_routers = transfer_routers
    union = normalize_transfers(transfers, transfer_routers, columns).unionByName(
        normalize_messages(messages, message_routers, columns)
    )
    return lower_chains(union) if lower_message_chains else union


def lower_chains(rows: DataFrame) -> DataFrame:
    """Fold the chain names to lower case (a no-op on transfer rows)."""
    chains = [c for c in ("source_chain", "destination_chain") if c in rows.columns]
    return rows.withColumns({name: F.lower(name) for name in chains})


def route() -> Column:
    """Source and destination as one text; NULL when either is."""
    return F.concat("source_chain", F.lit("➡"), "destination_chain")
