"""Exact distinct counts, sum, maximum, average and median from one scan.

``F.median`` keeps every distinct value of a group in one task's memory, and
several distinct counts beside it would each want their own pass. Here a single
aggregation over (group, kind, key, value) serves them all:

* each row is unfolded into one entry per distinct column and one for the value,
  and equal entries are counted map-side, so a hot key costs one entry per task;
* distinct counts, sum, maximum and average are sums over those entries;
* the median is found by narrowing. Values map to cells of a fixed logarithmic
  grid (monotone in the value, so cells are in value order). A histogram of
  coarse cells tells which one holds the middle rank, a histogram of its fine
  cells narrows that down, and only the values of that fine cell are ranked.

Every ranked set is bounded by the grid, not by the data: at most 2^10 coarse
cells per factor of two, 2^20 fine cells in a coarse one, and a fine cell spans
a relative width of 2^-30, which holds under 2^23 different doubles.

The entries' exchange is read twice (summary, value table) and the value table's
three times (the narrowing steps). For that to be one exchange each, all readers
must want the same columns, and no filter may touch a grouping column: it would
be pushed below the aggregation and give each reader its own scan. Filters
therefore use aggregated columns, and join keys are null-safe, which keeps the
optimiser from inferring IS NOT NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hopmetrics.functions import usd

FINE_CELLS_LOG2 = 30  # fine cells per factor of two, as a power of two
COARSE_SHIFT = 20  # fine cells in a coarse cell, as a power of two
# Above the largest magnitude of a double's binary logarithm (-1074 .. 1024), so
# that the shifted logarithm is positive and its sign can carry the value's.
LOG_OFFSET = 1100.0

VALUE_KIND = -1  # distinct columns are kinds 0, 1, ...


def _fine_cell(value: Column) -> Column:
    """Grid cell of a value; ``a <= b`` implies ``cell(a) <= cell(b)``."""
    shifted = F.log2(F.abs(value)) + LOG_OFFSET
    position = F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * shifted)
    return F.floor(position * float(1 << FINE_CELLS_LOG2))


def entries(
    rows: DataFrame, by: Sequence[str], distinct: dict[str, Column], value: Column
) -> DataFrame:
    """(by..., kind, key, value, n): the distinct keys, and the values with counts.

    ``n`` is how often a value occurs, and 0 for a key or a missing value.
    """
    no_key, no_value = F.lit(None).cast("string"), F.lit(None).cast("double")

    def entry(kind: int, key: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))

    unfolded = [entry(kind, key.cast("string"), no_value) for kind, key in enumerate(distinct.values())]
    unfolded.append(entry(VALUE_KIND, no_key, value.cast("double")))
    return (
        rows.select(*by, F.inline(F.array(*unfolded)))
        .groupBy(*by, "kind", "key", "value")
        .agg(F.count("value").alias("n"))
    )


def _holds_middle(upto: str, n: str) -> Column:
    """The ranks (upto - n, upto] contain a middle rank."""
    before = F.col(upto) - F.col(n)
    return ((before <= F.col("low")) & (F.col("low") < F.col(upto))) | (
        (before <= F.col("high")) & (F.col("high") < F.col(upto))
    )


def _renamed(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return cells.withColumnsRenamed({name: f"m_{name}" for name in by})


def medians(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., median) of the value entries; groups without values are absent.

    The broadcast sides hold at most two cells per group, and ``by`` is a
    calendar bucket, which bounds the groups.
    """
    values = (
        counted.filter(F.col("n") > 0)
        .select(*by, "value", "n", _fine_cell(F.col("value")).alias("cell"))
        .repartition(*by, "cell")
    )
    coarse_cell = F.shiftright("cell", COARSE_SHIFT)

    def whole(order: str) -> WindowSpec:
        # Same order as the running sum, so that one sort serves both.
        everything = (Window.unboundedPreceding, Window.unboundedFollowing)
        return Window.partitionBy(*by).orderBy(order).rowsBetween(*everything)

    def running(order: str) -> WindowSpec:
        return Window.partitionBy(*by).orderBy(order)

    # Cells are ranked by their lowest value, which is the order of the cells.
    coarse = (
        values.groupBy(*by, coarse_cell.alias("coarse"))
        .agg(F.sum("n").alias("n"), F.min("value").alias("lowest"))
        .withColumns(
            {
                "total": F.sum("n").over(whole("lowest")),
                "upto": F.sum("n").over(running("lowest")),
            }
        )
        .withColumns({"low": F.expr("(total - 1) div 2"), "high": F.expr("total div 2")})
        .filter(_holds_middle("upto", "n"))
        .select(*by, "coarse", (F.col("upto") - F.col("n")).alias("before"), "low", "high")
    )

    def inside(cells: DataFrame, cell: Column, name: str) -> DataFrame:
        cells = _renamed(cells, by)
        match = cell.eqNullSafe(F.col(name))
        for column in by:
            match = match & F.col(column).eqNullSafe(F.col(f"m_{column}"))
        return values.join(F.broadcast(cells), match)

    def ranked(cells: DataFrame, order: str) -> DataFrame:
        """The entries that hold a middle rank, with the rank each reaches up to.

        Where a group has two cells there is no value between them (the middle
        ranks are neighbours), so one running sum spans both.
        """
        upto = F.min("before").over(whole(order)) + F.sum("n").over(running(order))
        return cells.withColumn("upto", upto).filter(_holds_middle("upto", "n"))

    in_coarse = inside(coarse, coarse_cell, "coarse")
    fine = ranked(
        in_coarse.groupBy(*by, "low", "high", F.col("cell").alias("fine")).agg(
            F.min("before").alias("before"), F.sum("n").alias("n"), F.min("value").alias("lowest")
        ),
        "lowest",
    ).select(*by, "fine", (F.col("upto") - F.col("n")).alias("before"), "low", "high")

    in_fine = ranked(inside(fine, F.col("cell"), "fine"), "value")

    def half(rank: str) -> Column:
        hit = (F.col("upto") - F.col("n") <= F.col(rank)) & (F.col(rank) < F.col("upto"))
        return F.when(hit, F.lit(0.5)).otherwise(F.lit(0.0))

    middle = F.sum(F.col("value") * (half("low") + half("high")))
    return in_fine.groupBy(*by).agg(middle.alias("median"))


def profile(
    rows: DataFrame, by: Sequence[str], distinct: dict[str, Column], value: Column
) -> DataFrame:
    """One row per ``by`` group (one row in all without ``by``).

    Columns: ``by``, one exact distinct count per entry of ``distinct`` (NULLs
    not counted), and ``total`` (rounded), ``maximum``, ``average``, ``median``
    of ``value``. ``average`` is unrounded, NULL without values.
    """
    counted = entries(rows, by, distinct, value)
    n, amount = F.col("n"), F.col("value")
    exact = F.sum(usd.exact_part(amount) * n)
    large = F.sum(usd.large_part(amount) * n)
    vast = F.sum(usd.vast_part(amount) * n)
    priced = F.nullif(F.sum("n"), F.lit(0))
    counts = [
        F.count(F.when((F.col("kind") == kind) & (n == 0), F.col("key"))).alias(name)
        for kind, name in enumerate(distinct)
    ]
    summary = counted.groupBy(*by).agg(
        *counts,
        usd.join_parts_rounded(exact, large, vast).alias("total"),
        F.max("value").alias("maximum"),
        (usd.join_parts(exact, large, vast) / priced).alias("average"),
    )
    middle = medians(counted, by)
    if not by:
        return summary.withColumn("median", middle.select("median").scalar())
    match = F.lit(True)
    for column in by:
        match = match & F.col(column).eqNullSafe(F.col(f"m_{column}"))
    return summary.join(_renamed(middle, by), match, "left").drop(*(f"m_{c}" for c in by))
