"""Operators against small Python models on generated data."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import statistics
from collections import defaultdict

from conftest import by_key, tuples
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hopmetrics.functions.numeric import clean_double
from hopmetrics.operators import cohorts, normalize
from hopmetrics.operators.profile import entries, medians
from hopmetrics.plans import reports
from hopmetrics.sources import schemas
from pyspark.sql import functions as F
from pyspark.sql import types as T

slow = settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)

number_like = st.one_of(
    st.text(alphabet="0123456789.+-eE dfxNaI", max_size=8),
    st.floats(allow_nan=True, allow_infinity=True).map(repr),
    st.integers().map(str),
)


def model_number(text):
    trimmed = text.strip(" ")
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", trimmed, re.ASCII):
        return None
    value = float(trimmed)
    return value if math.isfinite(value) else None


@slow
@given(st.lists(number_like, min_size=40, max_size=80))
def test_clean_double(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    found = by_key(rows.select("i", clean_double(F.col("t"))))
    assert found == {i: model_number(text) for i, text in enumerate(texts)}


finite = st.floats(allow_nan=False, allow_infinity=False, min_value=-1e300, max_value=1e300)
crowded = st.floats(min_value=0.999999, max_value=1.000001)


@slow
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(finite, crowded, st.just(1.0))), min_size=1, max_size=80))
def test_medians(spark, data):
    rows = spark.createDataFrame(data, "g INT, v DOUBLE")
    groups = defaultdict(list)
    for group, value in data:
        groups[group].append(value)
    found = by_key(medians(entries(rows, ["g"], {}, F.col("v")), ["g"]))
    # Same interpolation: the mean of the two middle values, each halved first.
    expected = {}
    for group, values in groups.items():
        low, high = statistics.median_low(values), statistics.median_high(values)
        expected[group] = low if low == high else 0.5 * low + 0.5 * high
    assert found == expected


JANUARY = dt.datetime(2024, 1, 1)
visit = st.tuples(
    st.integers(0, 40),  # day
    st.one_of(st.none(), st.sampled_from("abcdef")),  # wallet
    st.one_of(st.none(), st.integers(-5, 200)),  # whole dollars
    st.sampled_from(["X", "x", "y", None]),  # chain
)


@slow
@given(st.lists(visit, min_size=1, max_size=50), st.integers(0, 30), st.integers(0, 15))
def test_cohorts(bridge_rows, visits, first_day, days):
    rows = bridge_rows(
        [
            {
                "created_at": JANUARY + dt.timedelta(days=day),
                "wallet": wallet,
                "amount_usd": None if usd is None else float(usd),
                "source_chain": chain,
            }
            for day, wallet, usd, chain in visits
        ]
    )
    start = (JANUARY + dt.timedelta(days=first_day)).date()
    end = start + dt.timedelta(days=days)
    in_range = range(first_day, first_day + days + 1)

    firsts = {}
    for day, wallet, _, _ in visits:
        firsts[wallet] = min(day, firsts.get(wallet, day))
    volume, emitted, users = defaultdict(list), defaultdict(int), defaultdict(set)
    for day, wallet, usd, chain in visits:
        if day not in in_range:
            continue
        partners = [w for w, first in firsts.items() if first == day] or ["nobody"]
        for partner in partners:
            new = wallet is not None and wallet == partner
            status = cohorts.NEW if new else cohorts.RETURNING
            emitted[status] += 1
            volume[status].append(usd)
            users[(chain and chain.lower(), "New" if new else "Old")].add(wallet)

    def total(values):
        known = [v for v in values if v is not None]
        return float(sum(known)) if known else None

    assert by_key(cohorts.status_rows(rows, start, end)) == emitted
    assert by_key(cohorts.status_volume(rows, start, end)) == {s: total(v) for s, v in volume.items()}
    found = {(c, s): n for c, s, n in tuples(cohorts.status_users_by_chain(rows, start, end))}
    assert found == {key: len(wallets - {None}) for key, wallets in users.items()}

    active, new = defaultdict(set), defaultdict(set)
    for day, wallet, _, _ in visits:
        if day in in_range:
            active[day].add(wallet)
    for wallet, day in firsts.items():
        if day in in_range:
            new[day].add(wallet)
    expected, growth = [], None
    for day in sorted(active):
        everyone = len(active[day] - {None})
        fresh = len(new[day] - {None}) if day in new else None
        if fresh is not None:
            growth = (growth or 0) + fresh
        returning = None if fresh is None else everyone - fresh
        expected.append((JANUARY + dt.timedelta(days=day), everyone, fresh, returning, growth))
    assert tuples(reports.user_growth(rows, "day", start, end)) == expected


def test_payload_keys_are_case_sensitive(transfer_feed):
    feed = transfer_feed([json.dumps({"send": {"Amount": "3", "amount": "4"}}), json.dumps({"Send": {"amount": "3"}})])
    decoded = normalize.decode_transfers(feed, ["amount"]).orderBy("id")
    assert [row.p_amount for row in decoded.collect()] == ["4", None]


def test_payload_type_merges_paths():
    found = schemas.payload_type(["a", "b.c", "b.d.e", "b.d.f"])
    assert found == T.StructType.fromDDL("a STRING, b STRUCT<c: STRING, d: STRUCT<e: STRING, f: STRING>>")
