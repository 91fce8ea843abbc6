"""Schemas of the two raw feeds, their payloads and the bridge relation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

# Raw feeds: typed envelope plus one JSON text column.
TRANSFER_FEED = """
    id STRING, created_at TIMESTAMP_NTZ, recipient_address STRING, sender_address STRING,
    status STRING, simplified_status STRING, data STRING
"""
MESSAGE_FEED = """
    id STRING, created_at TIMESTAMP_NTZ, status STRING, simplified_status STRING, data STRING
"""

# Path of every payload leaf the reports read, under a flat name. All leaves are
# decoded as STRING: a number, boolean, array or object arrives as its JSON text
# and is judged by the numeric cleaning, never by the JSON reader.
TRANSFER_LEAVES = {
    "amount": "send.amount",
    "source_chain": "send.original_source_chain",
    "destination_chain": "send.original_destination_chain",
    "fee_value": "send.fee_value",
    "price": "link.price",
    "asset": "link.asset",
}
MESSAGE_LEAVES = {
    "amount": "amount",
    "value": "value",
    "symbol": "symbol",
    "gas_used": "gas.gas_used_amount",
    "token_usd": "gas_price_rate.source_token.token_price.usd",
    "express_fee": "fees.express_fee_usd",
    "contract_address": "approved.returnValues.contractAddress",
    "source_chain": "call.chain",
    "destination_chain": "call.returnValues.destinationChain",
    "sender": "call.transaction.from",
}



def payload_type(paths: Iterable[str]) -> T.StructType:
    """The smallest struct that holds STRING leaves at the dotted ``paths``."""
    children: dict[str, list[str]] = {}
    for path in paths:
        head, _, rest = path.partition(".")
        children.setdefault(head, [])
        if rest:
            children[head].append(rest)
    return T.StructType(
        [
            T.StructField(name, payload_type(inner) if inner else T.StringType())
            for name, inner in children.items()
        ]
    )


# The bridge relation, one row per settled routed transfer or message.
BRIDGES = """
    created_at TIMESTAMP_NTZ, source_chain STRING, destination_chain STRING, wallet STRING,
    amount DOUBLE, amount_usd DOUBLE, fee DOUBLE, id STRING, service STRING, raw_asset STRING
"""
