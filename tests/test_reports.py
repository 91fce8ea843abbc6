"""Reports and cohort operators on hand-made bridge rows."""

from __future__ import annotations

import itertools
import math
import random
from fractions import Fraction

import pytest
from conftest import by_key, ts, tuples

from hopmetrics.functions import numeric, usd
from hopmetrics.functions.assets import ASSET_LABELS, ASSET_PREFIXES, with_asset_label
from hopmetrics.functions.buckets import amount_bucket, count_bucket
from hopmetrics.operators import cohorts, shares
from hopmetrics.operators.normalize import lower_chains
from hopmetrics.operators.profile import profile
from hopmetrics.plans import reports
from pyspark.sql import functions as F

RANGE = ("2024-01-01", "2024-12-31")


def test_tied_first_timestamps(bridge_rows):
    day = {1: ts("2024-01-01"), 2: ts("2024-01-02"), 3: ts("2024-01-03")}
    data = [(1, "x", 10), (1, "y", 20), (1, "z", 30), (2, "x", 5), (3, None, 7)]
    rows = bridge_rows(
        [
            {"created_at": day[d], "wallet": w, "amount_usd": float(u), "source_chain": "C"}
            for d, w, u in data
        ]
    )
    assert by_key(cohorts.status_rows(rows)) == {"New Users": 3, "Returning Users": 8}
    assert by_key(cohorts.status_volume(rows)) == {"New Users": 60.0, "Returning Users": 132.0}
    users = reports.source_chain_status_users(rows, *RANGE)
    assert sorted(tuples(users)) == [("c", "New", 3), ("c", "Old", 3)]


def literal_status_join(rows, start, end):
    """The join spelled out, for small inputs."""
    firsts = rows.groupBy("wallet").agg(F.min("created_at").alias("first_ts"))
    firsts = firsts.withColumnRenamed("wallet", "first_wallet")
    joined = rows.join(firsts, F.col("created_at") == F.col("first_ts"), "left")
    label = F.when(F.col("wallet") == F.col("first_wallet"), cohorts.NEW).otherwise(cohorts.RETURNING)
    joined = joined.withColumn("user_status", label)
    if start is not None:
        joined = joined.filter(F.to_date("created_at").between(F.lit(start), F.lit(end)))
    return joined


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("limits", [(None, None), ("2024-01-05", "2024-01-20"), RANGE])
def test_status_matches_the_literal_join(bridge_rows, seed, limits):
    pick = random.Random(seed)
    rows = bridge_rows(
        [
            {
                "id": f"i{pick.randrange(60)}",
                "created_at": ts(f"2024-01-{pick.randrange(1, 29):02d}"),
                # One wallet holds a third of the rows.
                "wallet": pick.choice(["hot"] * 8 + [None, None] + [f"w{i}" for i in range(14)]),
                "amount_usd": pick.choice([None, 2e15, round(pick.uniform(-5, 5000), 2), 12.5]),
                "source_chain": pick.choice(["A", "a", "b", None]),
            }
            for _ in range(120)
        ]
    )
    start, end = limits
    joined = literal_status_join(rows, start, end)
    expected = joined.groupBy("user_status").agg(F.count(F.lit(1)).alias("rows"))
    assert by_key(cohorts.status_rows(rows, start, end)) == by_key(expected)

    volume = usd.sum_rounded(F.col("amount_usd"))
    expected = joined.groupBy("user_status").agg(volume.alias("volume"))
    assert by_key(cohorts.status_volume(rows, start, end)) == by_key(expected)

    expected = joined.groupBy("created_at", "user_status").agg(volume.alias("volume"))
    found = cohorts.status_volume(rows, start, end, "day")
    assert sorted(map(repr, tuples(found))) == sorted(map(repr, tuples(expected)))

    lowered = literal_status_join(lower_chains(rows), start, end)
    status = F.when(F.col("user_status") == cohorts.NEW, "New").otherwise("Old")
    expected = lowered.groupBy("source_chain", status.alias("s")).agg(F.count_distinct("wallet"))
    found = cohorts.status_users_by_chain(rows, start, end)
    assert sorted(map(repr, tuples(found))) == sorted(map(repr, tuples(expected)))


def test_status_without_amounts_is_null(bridge_rows):
    rows = bridge_rows([{"created_at": ts("2024-01-01"), "wallet": "x"}])
    volume = cohorts.status_volume(rows, *RANGE)
    assert tuples(volume) == [("New Users", None)]
    assert tuples(shares.total_by(volume, "user_status", "volume")) == [("New Users", 0.0)]


def growth_rows(bridge_rows):
    visits = [
        ("2023-12-31", "old"),
        ("2024-01-05", "old"),  # a bucket without new users comes first
        ("2024-02-01", "a"),
        ("2024-02-02", "b"),
        ("2024-02-03", "old"),
        ("2024-03-01", "a"),
        ("2024-04-01", "c"),
        ("2024-04-02", "a"),
        ("2025-01-01", "late"),
    ]
    return bridge_rows([{"created_at": ts(d), "wallet": w} for d, w in visits])


def test_user_growth(bridge_rows):
    found = reports.user_growth(growth_rows(bridge_rows), "month", *RANGE)
    assert tuples(found) == [
        (ts("2024-01-01"), 1, None, None, None),
        (ts("2024-02-01"), 3, 2, 1, 2),
        (ts("2024-03-01"), 1, None, None, 2),
        (ts("2024-04-01"), 2, 1, 1, 3),
    ]


def test_user_growth_bucket_of_unknown_wallets(bridge_rows):
    rows = bridge_rows([{"created_at": ts("2024-01-01")}, {"created_at": ts("2024-02-01"), "wallet": "a"}])
    found = tuples(reports.user_growth(rows, "month", *RANGE))
    assert found == [(ts("2024-01-01"), 0, 0, 0, 0), (ts("2024-02-01"), 1, 1, 0, 1)]


@pytest.mark.parametrize("grain", ["day", "week", "month"])
def test_user_growth_parts(bridge_rows, grain):
    rows = growth_rows(bridge_rows)
    found = reports.user_growth(rows, grain, *RANGE).collect()
    assert {r.date: r.total for r in found} == by_key(cohorts.users_by_period(rows, grain, *RANGE))
    news = by_key(cohorts.new_users_by_period(rows, grain, *RANGE))
    assert {r.date: r.new for r in found if r.new is not None} == news
    assert all(r.new + r.returning == r.total for r in found if r.new is not None)
    assert found[-1].growth == sum(news.values()) == 3


def test_growth_when_the_range_starts_inside_a_bucket(bridge_rows):
    rows = growth_rows(bridge_rows)
    found = tuples(reports.user_growth(rows, "month", "2024-02-02", "2024-03-31"))
    # "a" was first seen on the day before the range, in the same month.
    assert found == [(ts("2024-02-01"), 2, 1, 1, 1), (ts("2024-03-01"), 1, None, None, 1)]


def test_amount_classes(spark):
    values = [-1.0, 10.0, 10.01, 100.0, 1000.0, 10000.0, 100000.0, 100000.01, None]
    rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select(amount_bucket(F.col("v")))
    assert [r[0] and r[0][0] for r in rows.collect()] == ["A", "A", "B", "B", "C", "D", "E", "F", None]


def test_count_classes(spark):
    values = [0, 1, 2, 5, 6, 10, 11, 20, 21, 100, 101]
    rows = spark.createDataFrame([(v,) for v in values], "v BIGINT").select(count_bucket(F.col("v")))
    assert [r[0] and r[0][0] for r in rows.collect()] == [None, *"ABBCCDDEEF"]


def test_unknown_wallets_form_a_class_without_users(bridge_rows):
    rows = [{"created_at": ts("2024-01-01"), "id": f"i{i}"} for i in range(120)]
    rows += [{"created_at": ts("2024-01-01"), "id": "x", "wallet": "w"}] * 3
    found = reports.txn_count_buckets(bridge_rows(rows), *RANGE)
    assert tuples(found) == [("A:1 Txn", 1), ("F: >100 Txns", 0)]


def test_an_id_counts_in_each_of_its_amount_classes(bridge_rows):
    at = ts("2024-01-01")
    rows = bridge_rows(
        [
            {"created_at": at, "id": "x", "amount_usd": 5.0},
            {"created_at": at, "id": "x", "amount_usd": 50.0},
            {"created_at": at, "id": "x", "amount_usd": 51.0},
            {"created_at": at, "id": "y", "amount_usd": None},
        ]
    )
    assert by_key(reports.amount_buckets(rows, *RANGE)) == {"A: V<=$10": 1, "B: $10<V<=$100": 1}


def test_asset_labels(bridge_rows):
    names = ["arb-wei", "FACTORY/sei10hubX", "zzz", None, "yield-eth-wei", "uusdc", "ARB-WEI"]
    rows = with_asset_label(bridge_rows([{"raw_asset": n} for n in names]))
    found = {r.raw_asset: r.symbol for r in rows.collect()}
    assert found == {
        "arb-wei": "ARB",
        "FACTORY/sei10hubX": "SEILOR",
        "zzz": "zzz",
        None: None,
        "yield-eth-wei": "yieldETH",
        "uusdc": "USDC",
        "ARB-WEI": "ARB-WEI",
    }
    assert len(ASSET_LABELS) == 59
    # The order of the exact and the prefix rule must not matter.
    for raw, label in ASSET_LABELS.items():
        for prefix, other in ASSET_PREFIXES.items():
            assert not raw.lower().startswith(prefix) or label == other


def test_same_label_from_two_raw_names_counts_an_id_once(bridge_rows):
    at = ts("2024-01-01")
    rows = bridge_rows(
        [
            {"created_at": at, "id": "x", "raw_asset": "uusdc", "amount_usd": 1.0},
            {"created_at": at, "id": "x", "raw_asset": "USDC", "amount_usd": 2.0},
            {"created_at": at, "id": "y", "amount_usd": 4.0},
        ]
    )
    assert tuples(reports.asset_breakdown(rows, *RANGE)) == [("USDC", 1, 3.0)]


def test_missing_chain_is_a_group(bridge_rows):
    at = ts("2024-01-01")
    rows = bridge_rows([{"created_at": at, "id": "x"}, {"created_at": at, "id": "y", "source_chain": "a"}])
    assert tuples(reports.source_chain_breakdown(rows, *RANGE)) == [(None, 1, 0, None), ("a", 1, 0, None)]


def test_empty_range(bridge_rows):
    rows = bridge_rows([{"created_at": ts("2020-01-01"), "id": "x", "amount_usd": 1.0}])
    assert tuples(reports.period_kpis(rows, *RANGE)) == [(0, 0, None, 0, None, None, None, 0)]
    assert tuples(reports.kpis_7d(rows, "2024-01-30")) == [(0, 0, None)]
    for report in (reports.activity_by_period, reports.user_growth, reports.status_volume_by_period):
        assert report(rows, "month", *RANGE).count() == 0


def test_rounding_and_huge_amounts(spark):
    def total(*values):
        rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
        return rows.agg(usd.sum_rounded(F.col("v"))).first()[0]

    assert total(-2.5) == -3.0
    assert total(0.1, 0.2, 0.2) == 1.0
    assert total(None) is None
    assert total(1e30, 1.0, None) == 1e30
    assert total(5e15, 0.5) == 5e15
    assert total(1e308, 1e308) == float("inf")


def test_large_amounts_cancel_in_any_order(spark):
    def totals(values, partitions):
        rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE").repartition(partitions)
        return rows.agg(usd.sum_rounded(F.col("v")), usd.sum_exact(F.col("v"))).first()

    assert tuple(totals([5e15, -5e15], 1)) == (0.0, 0.0)
    assert {tuple(totals(p, 2)) for p in itertools.permutations([1e31, 1e15, -1e31])} == {(1e15, 1e15)}
    assert tuple(totals([1e200, 5.5, -1e200], 1)) == (6.0, 5.5)
    pick = random.Random(3)
    for _ in range(4):
        values = [pick.choice([-1, 1]) * pick.random() * 2.0 ** pick.randint(-10, 134) for _ in range(60)]
        values += [-v for v in values[:40]] + [0.25]
        found = set()
        for partitions in (1, 3, 7):
            pick.shuffle(values)
            found.add(tuple(totals(values, partitions)))
        assert len(found) == 1
        true = sum(map(Fraction, values))
        assert found.pop()[1] == pytest.approx(float(true), rel=1e-12)


def test_large_amounts_in_the_reports(bridge_rows):
    rows = bridge_rows(
        [{"created_at": ts(f"2024-01-0{d}"), "id": str(d), "amount_usd": v} for d, v in [(1, 5e15), (2, -5e15)]]
    )
    assert reports.period_kpis(rows, *RANGE).first().volume == 0.0
    assert reports.status_volume(rows, *RANGE).agg(F.sum("volume")).first()[0] == 0.0


def test_products_stay_finite_and_labels_take_quotes(spark):
    row = spark.range(1).select(
        numeric.safe_product(F.lit("1e200"), F.lit("1e200")),
        numeric.fee_with_fallback(F.lit("1e200"), F.lit("-1e200"), F.lit("7")),
    )
    assert tuple(row.first()) == (None, 7.0)
    rows = spark.createDataFrame([("it's",), ("other",)], "raw_asset STRING")
    found = with_asset_label(rows, {"it's": "It's \"one\""})
    assert sorted(r.symbol for r in found.collect()) == ["It's \"one\"", "other"]
    assert with_asset_label(rows, {}).count() == 2


def test_totals_stay_true_over_many_small_digits(spark):
    # All of these end in a tie at the sixth decimal; rounding up would add 0.25.
    rows = spark.range(500_000).select((F.col("id") / 1e6 + 5e-7).alias("v"))
    values = [i / 1e6 + 5e-7 for i in range(500_000)]
    assert rows.agg(usd.sum_exact(F.col("v"))).first()[0] == pytest.approx(math.fsum(values), abs=1e-3)


@pytest.mark.parametrize("seed", range(3))
def test_profile_matches_builtin_aggregates(spark, seed):
    pick = random.Random(seed)
    special = [0.0, -0.0, 1.0, 1.0000000001, 5e-324, 1.7e308, -1.7e308, 1e-9, -3.5, None]
    data = []
    for group in ["a", "b", "c", None, "only null", "one"]:
        for _ in range({"one": 1}.get(group, pick.randrange(1, 90))):
            kind = pick.random()
            if group == "only null":
                value = None
            elif kind < 0.3:
                value = 42.42  # a hot value
            elif kind < 0.5:
                value = pick.choice(special)
            else:
                value = pick.lognormvariate(3, 4) * pick.choice([1, 1, 1, -1])
            data.append((group, f"k{pick.randrange(30)}" if kind < 0.9 else None, value))
    rows = spark.createDataFrame(data, "g STRING, k STRING, v DOUBLE")
    builtin = [F.count_distinct("k"), F.max("v"), F.median("v")]
    found = profile(rows, ["g"], {"keys": F.col("k")}, F.col("v"))
    assert by_key(found.select("g", "keys", "maximum", "median")) == by_key(rows.groupBy("g").agg(*builtin))
    found = profile(rows, [], {"keys": F.col("k")}, F.col("v"))
    assert tuples(found.select("keys", "maximum", "median")) == tuples(rows.agg(*builtin))


def test_profile_total_and_average(spark):
    rows = spark.createDataFrame([("k", 1.25), ("k", 2.5), ("j", None), ("j", 2.5)], "k STRING, v DOUBLE")
    found = profile(rows, [], {"keys": F.col("k")}, F.col("v")).first()
    assert (found["keys"], found.total, found.maximum, found.median) == (2, 6.0, 2.5, 2.5)
    assert found.average == pytest.approx(6.25 / 3)


def test_shares(spark):
    rows = spark.createDataFrame(
        [("d1", "n", 1.0), ("d1", "r", 3.0), ("d2", "n", None), ("d3", "n", 0.0)], "d STRING, s STRING, v DOUBLE"
    )
    found = shares.share_within(rows, ["d"], "v")
    assert sorted(map(repr, tuples(found.select("d", "s", "percentage")))) == [
        "('d1', 'n', 25.0)",
        "('d1', 'r', 75.0)",
        "('d2', 'n', None)",
        "('d3', 'n', None)",
    ]
    total = shares.share_of_total(rows, ["v"])
    assert total.agg(F.sum("v_share")).first()[0] == pytest.approx(100)
    wide = shares.widen(rows, "d", "s", {"n": "new", "r": "ret"}, "v")
    assert sorted(map(repr, tuples(wide))) == ["('d1', 1.0, 3.0)", "('d2', None, None)", "('d3', 0.0, None)"]
    summed = shares.total_by(rows.filter("d = 'd2'"), "s", "v")
    assert tuples(summed) == [("n", 0.0)]
