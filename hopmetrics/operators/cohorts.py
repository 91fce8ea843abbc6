"""First activity, user growth, and new/returning status.

Two meanings of "new" are in use, both kept as they are:

* by date (user growth): a user is new in the bucket of their first date;
* by timestamp (status): the relation is left-joined with the users' first
  timestamps *on the timestamp alone*, and a joined row is new when the users
  match too. A row at a timestamp that is first for k users comes out k times,
  at most once as new, so ties inflate the returning side.

The status join is never executed. With k(ts) the number of users whose first
timestamp is ts, it emits a row greatest(k, 1) times, and once as new if the row
is at its own user's first timestamp. Totals per timestamp are therefore
``all * greatest(k, 1) - new``, from two aggregations whose keys are spread by
(wallet, timestamp) and by timestamp. Nothing fans out, and neither a busy wallet
nor a crowded timestamp meets in one task except as one pre-aggregated row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmetrics.functions import usd
from hopmetrics.functions.calendar import as_date, bucket, date_range
from hopmetrics.operators.normalize import lower_chains

NEW, RETURNING = "New Users", "Returning Users"

#: Groups that the rows of one instant, or of one wallet and instant, are dealt to when
#: their status is looked up.
SALTS = 16


def first_activity_ts(bridges: DataFrame) -> DataFrame:
    """(wallet, first_ts) over all time; rows without a wallet form one group."""
    return bridges.groupBy("wallet").agg(F.min("created_at").alias("first_ts"))


def first_activity_date(bridges: DataFrame) -> DataFrame:
    """(wallet, first_date) over all time."""
    return bridges.groupBy("wallet").agg(F.min(F.to_date("created_at")).alias("first_date"))


def users_by_period(bridges: DataFrame, grain: str, start=None, end=None) -> DataFrame:
    """(date, total): distinct wallets per bucket."""
    rows = date_range(bridges, start, end)
    return rows.groupBy(bucket(grain, F.col("created_at")).alias("date")).agg(
        F.count_distinct("wallet").alias("total")
    )


def new_users_by_period(bridges: DataFrame, grain: str, start=None, end=None) -> DataFrame:
    """(date, new): wallets per bucket of their all-time first date.

    Rows after ``end`` cannot move a first date into the range, so only the lower
    bound has to wait until after the aggregation.
    """
    return _new_users(first_activity_date(date_range(bridges, None, end)), grain, start)


def _new_users(firsts: DataFrame, grain: str, start) -> DataFrame:
    if start is not None:
        firsts = firsts.filter(F.col("first_date") >= F.lit(as_date(start)))
    # One row per wallet: a plain count is the distinct count, and the group of
    # rows without a wallet makes a bucket exist without counting in it.
    return firsts.groupBy(bucket(grain, F.col("first_date")).alias("date")).agg(
        F.count("wallet").alias("new")
    )


def user_growth(bridges: DataFrame, grain: str, start=None, end=None) -> DataFrame:
    """(date, total, new, returning, growth), ascending.

    Both sides of the join come from one aggregation by (wallet, bucket). The
    history before ``start`` only matters as "seen before", so all of it shares
    one bucket dated the day before ``start`` and shrinks to one row per wallet
    before the shuffle. A bucket without new users keeps NULL in ``new`` and
    ``returning``.
    """
    rows = date_range(bridges, None, end)
    day = F.to_date("created_at")
    if start is None:
        period, seen = bucket(grain, day), day
    else:
        first_day = F.lit(as_date(start))
        period = F.when(day >= first_day, bucket(grain, day))
        seen = F.greatest(day, F.date_sub(first_day, 1))
    active = rows.groupBy("wallet", period.alias("date")).agg(F.min(seen).alias("first_date"))

    # The history bucket goes out by its (aggregated) date: a filter on "date"
    # would reach the scan and give this side another plan than the other.
    totals = active.groupBy("date").agg(
        F.count("wallet").alias("total"), F.max("first_date").alias("latest")
    )
    if start is not None:
        totals = totals.filter(F.col("latest") >= F.lit(as_date(start)))
    firsts = active.groupBy("wallet").agg(F.min("first_date").alias("first_date"))
    joined = totals.drop("latest").join(_new_users(firsts, grain, start), "date", "left")
    # One row per bucket from here on.
    return joined.select(
        "date",
        "total",
        "new",
        (F.col("total") - F.col("new")).alias("returning"),
        F.sum("new").over(Window.orderBy("date")).alias("growth"),
    ).orderBy("date")


def _clamped(bridges: DataFrame, start, end) -> tuple[DataFrame, Column, Column]:
    """Rows up to ``end``, their timestamp with the history before ``start``
    folded into the last instant before it, and whether a row is in the range.

    Later rows cannot change a first timestamp inside the range. Earlier ones
    only matter as "seen before", which the folded instant says as well.
    """
    rows = date_range(bridges, None, end)
    at = F.col("created_at")
    if start is None:
        return rows, at, F.lit(True)
    midnight = dt.datetime.combine(as_date(start), dt.time())
    last_instant = (midnight - dt.timedelta(microseconds=1)).isoformat(sep=" ")
    before = F.lit(last_instant).cast("timestamp_ntz")
    return rows, F.greatest(at, before), F.to_date("created_at") >= F.lit(as_date(start))


_MEASURES = ("rows", "priced", "exact", "large", "vast_rows", "vast")


def status_totals(bridges: DataFrame, start=None, end=None) -> DataFrame:
    """(at, user_status, rows, priced, exact, large, vast): what the status join emits
    per timestamp and status; USD in the three parts of ``functions.usd``."""
    rows, at, in_range = _clamped(bridges, start, end)
    exact = F.when(in_range, usd.exact_part(F.col("amount_usd")))
    large = F.when(in_range, usd.large_part(F.col("amount_usd")))
    vast = F.when(in_range, usd.vast_part(F.col("amount_usd")))
    by_wallet = rows.groupBy("wallet", at.alias("at")).agg(
        F.count(F.when(in_range, F.lit(1))).alias("rows"),
        F.count(exact).alias("priced"),
        F.coalesce(F.sum(exact), F.lit(0)).cast(usd.SUM_TYPE).alias("exact"),
        F.coalesce(F.sum(large), F.lit(0)).cast(usd.LARGE_TYPE).alias("large"),
        F.count(vast).alias("vast_rows"),
        F.coalesce(F.sum(vast), F.lit(0.0)).alias("vast"),
    )

    # All rows of a timestamp, and per user what happened at the first one.
    everything = by_wallet.select("at", *_MEASURES, F.lit(0).cast("long").alias("firsts"))
    everything = everything.withColumns({f"new_{m}": _zero(m) for m in _MEASURES})
    firsts = by_wallet.groupBy("wallet").agg(
        F.min("at").alias("at"), *(F.min_by(m, "at").alias(f"new_{m}") for m in _MEASURES)
    )
    known = F.col("wallet").isNotNull()
    firsts = firsts.filter(F.col("at").isNotNull()).select(
        "at",
        *(_zero(m).alias(m) for m in _MEASURES),
        F.lit(1).cast("long").alias("firsts"),
        *(F.when(known, F.col(f"new_{m}")).otherwise(_zero(m)).alias(f"new_{m}") for m in _MEASURES),
    )
    sums = [*_MEASURES, "firsts", *(f"new_{m}" for m in _MEASURES)]
    per_instant = everything.unionByName(firsts).groupBy("at").agg(
        *(F.sum(m).alias(m) for m in sums)
    )

    copies = F.greatest(F.col("firsts"), F.lit(1).cast("long"))
    rest = {m: F.col(m) * copies - F.col(f"new_{m}") for m in _MEASURES}
    # A float difference need not cancel; without vast rows there is no vast sum.
    rest["vast"] = F.when(rest["vast_rows"] > 0, rest["vast"]).otherwise(F.lit(0.0))

    def side(status: str, measures: dict[str, Column]) -> Column:
        return F.struct(
            F.lit(status).alias("user_status"),
            measures["rows"].alias("rows"),
            measures["priced"].alias("priced"),
            measures["exact"].cast(usd.SUM_TYPE).alias("exact"),
            measures["large"].cast(usd.LARGE_TYPE).alias("large"),
            F.when(measures["vast_rows"] > 0, measures["vast"]).alias("vast"),
        )

    new = {m: F.col(f"new_{m}") for m in _MEASURES}
    emitted = per_instant.select("at", F.inline(F.array(side(NEW, new), side(RETURNING, rest))))
    # History carries no rows, so this also drops what lies before ``start``.
    return emitted.filter(F.col("rows") > 0)


def _zero(measure: str) -> Column:
    kind = {"exact": usd.SUM_TYPE, "large": usd.LARGE_TYPE, "vast": "double"}.get(measure, "long")
    return F.lit(0).cast(kind)


def status_rows(bridges: DataFrame, start=None, end=None) -> DataFrame:
    """(user_status, rows): rows the status join emits."""
    return status_totals(bridges, start, end).groupBy("user_status").agg(F.sum("rows").alias("rows"))


def status_rows_each(bridges: DataFrame, start=None, end=None) -> DataFrame:
    """The rows of the range with ``is_new`` and ``copies``, chain names in lower case.

    The status join emits a row ``copies`` times, once as new if ``is_new`` and else as
    returning; ``status_of_each`` writes that out. Nothing fans out here: each row is met
    by at most one row of two lookups with unique keys, wallet and first instant, and the
    instants that are first for several users (others make no copies). Both sides carry
    a salt, so that an instant or a wallet's instant with a third of all rows is dealt
    to ``SALTS`` groups. Rows without a wallet are never new, and rows without a time
    are in no range and have one copy. Repeated rows are kept.
    """
    rows, at, in_range = _clamped(lower_chains(bridges), start, end)
    firsts = rows.groupBy("wallet").agg(F.min(at).alias("first_ts")).filter(F.col("first_ts").isNotNull())
    if start is not None:  # what is first before the range meets no row in it
        firsts = firsts.filter(F.to_date("first_ts") >= F.lit(as_date(start)))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    own = firsts.filter(F.col("wallet").isNotNull()).select(
        F.col("wallet").alias("_wallet"), F.col("first_ts").alias("_first"), salts
    )
    ties = firsts.groupBy("first_ts").agg(F.count(F.lit(1)).alias("_firsts")).filter(F.col("_firsts") > 1)
    ties = ties.select(F.col("first_ts").alias("_instant"), "_firsts", salts.alias("_tie_salt"))

    columns = rows.columns
    # By a hash of the whole row, so that a task run again deals its rows as before.
    salted = rows.filter(in_range).withColumn("_deal", F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int"))
    met = salted.join(
        own,
        (salted["wallet"] == own["_wallet"]) & (salted["created_at"] == own["_first"]) & (salted["_deal"] == own["_salt"]),
        "left",
    )
    met = met.join(ties, (met["created_at"] == ties["_instant"]) & (met["_deal"] == ties["_tie_salt"]), "left")
    return met.select(
        *columns,
        F.col("_wallet").isNotNull().alias("is_new"),
        F.coalesce("_firsts", F.lit(1).cast("long")).alias("copies"),
    )


def status_of_each(each: DataFrame) -> DataFrame:
    """``status_rows_each`` with ``user_status`` and how often a row comes out with it, instead of ``is_new``."""
    once = F.col("is_new").cast("long")
    sides = F.array(
        F.struct(F.lit(NEW).alias("user_status"), once.alias("copies")),
        F.struct(F.lit(RETURNING).alias("user_status"), (F.col("copies") - once).alias("copies")),
    )
    columns = [c for c in each.columns if c not in ("is_new", "copies")]
    return each.select(*columns, F.inline(sides)).filter(F.col("copies") > 0)


def status_volume(bridges: DataFrame, start=None, end=None, grain: str | None = None) -> DataFrame:
    """([date,] user_status, volume): USD the status join emits, whole dollars."""
    return status_volume_of(status_totals(bridges, start, end), grain)


def status_volume_of(totals: DataFrame, grain: str | None = None) -> DataFrame:
    """([date,] user_status, volume) from ``status_totals``, which may have been written before."""
    keys = ["user_status"]
    if grain is not None:
        totals = totals.withColumn("date", bucket(grain, F.col("at")))
        keys = ["date", "user_status"]
    volume = usd.join_parts_rounded(F.sum("exact"), F.sum("large"), F.sum("vast"))
    return totals.groupBy(*keys).agg(F.when(F.sum("priced") > 0, volume).alias("volume"))


def status_users_by_chain(
    bridges: DataFrame, start=None, end=None, labels: tuple[str, str] = ("New", "Old")
) -> DataFrame:
    """(source_chain, user_status, users): distinct wallets the status join emits.

    One row per (wallet, chain) carries all that is needed: the first timestamp
    there and the last one in the range. Windows run over a wallet's chains or a
    timestamp's chains, so they stay as small as the list of chains.
    """
    rows, at, in_range = _clamped(lower_chains(bridges), start, end)
    visits = rows.groupBy("wallet", "source_chain").agg(
        F.min(at).alias("first_here"), F.max(F.when(in_range, at)).alias("last_in_range")
    )
    own = Window.partitionBy("wallet").orderBy(F.asc_nulls_last("first_here"), "source_chain")
    visits = visits.withColumns(
        {
            "first": F.first("first_here").over(own),
            # One row per wallet stands for it when first users are counted.
            "stands": (F.row_number().over(own) == 1).cast("int"),
        }
    )
    known = F.col("wallet").isNotNull()
    active = F.col("last_in_range").isNotNull()
    if start is None:
        first_in_range = active
    else:
        first_in_range = F.to_date("first") >= F.lit(as_date(start))
    new_here = known & active & first_in_range & (F.col("first_here") == F.col("first"))
    later = known & active & (F.col("last_in_range") > F.col("first"))

    def how_many(condition: Column) -> Column:
        return F.count(F.when(condition, F.lit(1)))

    per_instant = visits.groupBy("first", "source_chain").agg(
        F.sum("stands").alias("firsts"),
        how_many(new_here).alias("new"),
        how_many(later).alias("later"),
        # New here and nothing else here: seen as returning only through a tie.
        how_many(new_here & ~later).alias("only_first"),
        how_many(~known & active).alias("unknown"),
    )
    tied = F.sum("firsts").over(Window.partitionBy("first")) >= 2
    per_instant = per_instant.withColumn(
        "old", F.col("later") + F.when(tied, F.col("only_first")).otherwise(F.lit(0))
    )
    per_chain = per_instant.groupBy("source_chain").agg(
        *(F.sum(c).alias(c) for c in ("new", "old", "unknown"))
    )
    sides = F.array(
        F.struct(
            F.lit(labels[0]).alias("user_status"), F.col("new").alias("users"), F.col("new").alias("seen")
        ),
        F.struct(
            F.lit(labels[1]).alias("user_status"),
            F.col("old").alias("users"),
            (F.col("old") + F.col("unknown")).alias("seen"),
        ),
    )
    return per_chain.select("source_chain", F.inline(sides)).filter(F.col("seen") > 0).drop("seen")
