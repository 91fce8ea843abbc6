"""USD totals that do not depend on the order of addition.

A sum of doubles changes in its last digits with the partitioning, which moves a
total that ends in .5 by a whole dollar when it is rounded. Amounts are therefore
cut at a power of two, which loses no digit of a double, and summed in parts:

- ``exact``: what lies below 2**73, as a decimal with six places, rounded half to even
  so that the dropped digits do not add up to a bias (headroom: 1e10 rows of 9e21).
  Six is also the scale Spark's decimal arithmetic never cuts below. It is NULL for a
  NULL amount only, so that its count is that of the amounts;
- ``large``: the multiple of 2**73 in an amount, a whole number;
- ``vast``: amounts from 2**135 (4e40) on, whole, as doubles. Only their sum among
  themselves keeps the rounding of doubles; it does not touch the other parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 2**73
VAST = 2.0**135
PLACES = 6
EXACT_TYPE = f"decimal(28,{PLACES})"
SUM_TYPE = f"decimal(38,{PLACES})"
LARGE_TYPE = "decimal(38,0)"
#: So many units fit into a decimal with cents, next to the exact part; and into a whole one.
FEW_UNITS, MANY_UNITS = 10**9, 10**16
#: From here on every double is a whole number.
NO_CENTS = 2**52


def _below_unit(usd: Column) -> Column:
    return usd % F.lit(float(UNIT))


def exact_part(usd: Column) -> Column:
    # The remainder is slow, and few amounts need one.
    below = F.when(F.abs(usd) < float(UNIT), usd).when(F.abs(usd) < VAST, _below_unit(usd)).when(usd.isNotNull(), 0.0)
    return F.bround(below.cast("decimal(32,10)"), PLACES).cast(EXACT_TYPE)


def large_part(usd: Column) -> Column:
    size = F.abs(usd)
    units = (usd - _below_unit(usd)) / F.lit(float(UNIT))
    return F.when((size >= float(UNIT)) & (size < VAST), units.cast("long").cast("decimal(19,0)"))


def vast_part(usd: Column) -> Column:
    return F.when(F.abs(usd) >= VAST, usd)


def _joined(exact: Column, large: Column, vast: Column, rounded: bool) -> Column:
    """One DOUBLE out of the three partial sums; NULL when there is no amount."""
    units = F.coalesce(large.cast(LARGE_TYPE), F.lit(0).cast(LARGE_TYPE))
    unit = F.lit(str(UNIT)).cast("decimal(22,0)")
    cents = exact.cast(SUM_TYPE) + units.cast("decimal(15,0)") * unit
    few = cents.cast("double")
    if rounded:  # as a decimal, before the cast
        few = F.when(F.abs(cents) < NO_CENTS, F.round(cents).cast("double")).otherwise(few)
    many = F.round(exact).cast(LARGE_TYPE) + units.cast("decimal(16,0)") * unit
    most = exact.cast("double") + units.cast("double") * F.lit(float(UNIT))
    size = F.abs(units)
    total = F.when(size < FEW_UNITS, few).when(size < MANY_UNITS, many.cast("double")).otherwise(most)
    return F.when(vast.isNull(), total).otherwise(total + vast)


def join_parts(exact: Column, large: Column, vast: Column) -> Column:
    return _joined(exact, large, vast, rounded=False)


def join_parts_rounded(exact: Column, large: Column, vast: Column) -> Column:
    """Whole dollars, half away from zero; the nearest double where it has no cents."""
    total = _joined(exact, large, vast, rounded=True)
    return F.when(vast.isNull(), total).otherwise(F.round(total))


def _sums(usd: Column) -> list[Column]:
    return [F.sum(part(usd)) for part in (exact_part, large_part, vast_part)]


def sum_rounded(usd: Column) -> Column:
    """Aggregate: ``round(sum(usd))``."""
    return join_parts_rounded(*_sums(usd))


def sum_exact(usd: Column) -> Column:
    """Aggregate: ``sum(usd)``, not rounded to dollars."""
    return join_parts(*_sums(usd))
