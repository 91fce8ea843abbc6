"""Decoding, cleaning, filters and the bridge relation on hand-made records."""

from __future__ import annotations

import json

import pytest
from conftest import by_key, ts, tuples

from hopmetrics.functions.calendar import bucket, date_range, trailing_days
from hopmetrics.functions.numeric import clean_double
from hopmetrics.operators import normalize
from hopmetrics.sources import schemas
from pyspark.sql import functions as F

ROUTERS = ["0xRouter"]


def transfer(amount="1", price="2", **send):
    return json.dumps({"send": {"amount": amount, **send}, "link": {"price": price, "asset": "uusdc"}})


def message(**fields):
    base = {
        "approved": {"returnValues": {"contractAddress": "0xROUTER"}},
        "call": {"chain": "Avalanche", "returnValues": {"destinationChain": "X"}, "transaction": {"from": "w"}},
    }
    return json.dumps({**base, **fields})


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1e3", 1000.0),
        (".5", 0.5),
        ("+5", 5.0),
        (" 1 ", 1.0),
        ("7.", 7.0),
        ("-2.5E-1", -0.25),
        ("", None),
        ("1d", None),
        ("1.5f", None),
        ("0x1p3", None),
        ("1,000", None),
        ("true", None),
        ("[1,2]", None),
        ('{"a":1}', None),
        ("NaN", None),
        ("Infinity", None),
        ("1e999", None),
        ("1 2", None),
        ("-", None),
        (None, None),
    ],
)
def test_number_text(spark, text, expected):
    rows = spark.createDataFrame([(text,)], "t STRING").select(clean_double(F.col("t")))
    assert rows.first()[0] == expected


@pytest.mark.parametrize(
    ("payload", "amount", "usd"),
    [
        (transfer("3", "2"), 3.0, 6.0),
        (transfer(3, 2.5), 3.0, 7.5),
        (transfer([1, 2], "2"), None, None),
        (transfer({"a": 1}, "2"), None, None),
        (transfer(True, "2"), None, None),
        (transfer("3", {"a": 1}), 3.0, None),
        (transfer(None, "2"), None, None),
        (json.dumps({"send": {"amount": "3"}}), 3.0, None),
        (json.dumps({"link": {"price": "3"}}), None, None),
        ("{bad", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_transfer_amounts(transfer_feed, payload, amount, usd):
    rows = normalize.normalize_transfers(transfer_feed([payload]), ROUTERS)
    assert rows.select("amount", "amount_usd").collect() == [(amount, usd)]


def test_message_number_as_json_number_and_fee_arms(message_feed):
    gas = {"gas": {"gas_used_amount": "2"}, "gas_price_rate": {"source_token": {"token_price": {"usd": 1.5}}}}
    express = {"fees": {"express_fee_usd": "7"}}
    broken = {**gas, "gas": {"gas_used_amount": [2]}}
    feed = message_feed(
        [message(value=3.25, **gas, **express), message(**express), message(), message(**broken, **express)]
    )
    rows = normalize.normalize_messages(feed, ROUTERS).orderBy("id")
    assert tuples(rows.select("amount_usd", "fee")) == [(3.25, 3.0), (None, 7.0), (None, None), (None, 7.0)]


def test_malformed_messages_do_not_match_a_router(message_feed):
    assert normalize.normalize_messages(message_feed(["{bad", None, "[]", "1"]), ROUTERS).count() == 0


def test_router_match_ignores_case_and_surroundings(spark, transfer_feed):
    feeds = [
        transfer_feed([transfer()], sender_address=sender)
        for sender in ("0xROUTER", "0xrouter", "x-0xRoUtEr-y", "0xother", None)
    ]
    found = [normalize.routed_transfers(feed, ["nope", *ROUTERS]).count() for feed in feeds]
    assert found == [1, 1, 1, 0, 0]


def test_router_text_must_be_plain(transfer_feed):
    for bad in ("0x%", "0x_", "0x'", "\\", ""):
        with pytest.raises(ValueError):
            normalize.routed_transfers(transfer_feed([transfer()]), [bad])


@pytest.mark.parametrize(
    ("status", "simplified", "kept"),
    [
        ("executed", "received", 1),
        ("executed", "sent", 0),
        ("pending", "received", 0),
        ("Executed", "received", 0),
        (None, "received", 0),
        ("executed", None, 0),
    ],
)
def test_settled(transfer_feed, status, simplified, kept):
    feed = transfer_feed([transfer()], status=status, simplified_status=simplified)
    assert normalize.settled(feed).count() == kept


def test_union_keeps_duplicates_and_spelling(transfer_feed, message_feed):
    transfers = transfer_feed([transfer(original_source_chain="AVALANCHE")] * 2)
    messages = message_feed([message(), message()])
    raw = normalize.bridges(transfers, messages, ROUTERS)
    assert raw.schema.simpleString() == transfers.sparkSession.createDataFrame([], schemas.BRIDGES).schema.simpleString()
    assert by_key(raw.groupBy("source_chain").count()) == {"avalanche": 2, "Avalanche": 2}
    lowered = normalize.bridges(transfers, messages, ROUTERS, lower_message_chains=True)
    assert by_key(lowered.groupBy("source_chain").count()) == {"avalanche": 4}


def test_narrow_relation_has_the_same_rows(transfer_feed, message_feed):
    transfers = transfer_feed([transfer(), "{bad", None])
    messages = message_feed([message(value="5"), message()])
    columns = ("wallet", "id", "amount_usd")
    whole = normalize.bridges(transfers, messages, ROUTERS).select(*columns)
    narrow = normalize.bridges(transfers, messages, ROUTERS, columns=columns)
    assert sorted(map(repr, tuples(narrow))) == sorted(map(repr, tuples(whole)))


def test_routes_are_null_propagating(bridge_rows):
    rows = bridge_rows(
        [
            {"source_chain": "a", "destination_chain": "b"},
            {"source_chain": None, "destination_chain": "b"},
            {"source_chain": "a", "destination_chain": None},
        ]
    )
    assert rows.select(F.count_distinct(normalize.route())).first()[0] == 1


def test_date_range_includes_both_days(bridge_rows):
    stamps = ["2024-01-01", "2024-01-31T23:59:59.999999", "2024-02-01", "2023-12-31T23:59:59.999999"]
    rows = bridge_rows([{"id": s, "created_at": ts(s)} for s in stamps] + [{"id": "null"}])
    kept = {row.id for row in date_range(rows, "2024-01-01", "2024-01-31").collect()}
    assert kept == set(stamps[:2])


def test_trailing_days_include_today_and_the_future(bridge_rows):
    stamps = ["2024-01-24", "2024-01-23T23:59:59", "2024-01-30T12:00:00", "2024-02-05"]
    rows = bridge_rows([{"id": s, "created_at": ts(s)} for s in stamps])
    kept = {row.id for row in trailing_days(rows, 7, "2024-01-30").collect()}
    assert kept == {stamps[0], stamps[2], stamps[3]}
    assert trailing_days(rows, 7).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
@pytest.mark.parametrize(
    ("grain", "stamp", "expected"),
    [
        ("week", "2025-01-01", "2024-12-30"),
        ("week", "2024-12-30", "2024-12-30"),
        ("day", "2024-03-10T02:30:00", "2024-03-10"),
        ("month", "2024-03-31T23:59:59.999999", "2024-03-01"),
    ],
)
def test_buckets_do_not_depend_on_the_time_zone(spark, bridge_rows, zone, grain, stamp, expected):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = bridge_rows([{"created_at": ts(stamp)}]).select(bucket(grain, F.col("created_at")).alias("b"))
        assert rows.schema["b"].dataType.typeName() == "timestamp_ntz"
        assert rows.first().b == ts(expected)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unknown_grain():
    with pytest.raises(ValueError):
        bucket("hour", None)
