"""Size classes of the two distribution reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bound (inclusive) and label of each class, last one open.
AMOUNT_CLASSES = [
    (10, "A: V<=$10"),
    (100, "B: $10<V<=$100"),
    (1_000, "C: $100<V<=$1K"),
    (10_000, "D: $1K<V<=$10K"),
    (100_000, "E: $10K<V<=$100K"),
    (None, "F: V>$100K"),
]
COUNT_CLASSES = [
    (1, "A:1 Txn"),
    (5, "B: 2-5 Txns"),
    (10, "C: 6-10 Txns"),
    (20, "D: 11-20 Txns"),
    (100, "E: 21-100 Txns"),
    (None, "F: >100 Txns"),
]


def _classify(value: Column, classes, label: Column | None = None) -> Column:
    *bounded, (_, last) = classes
    for upper, name in bounded:
        hit = value <= upper
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.when(value.isNotNull(), last)


def amount_bucket(usd: Column) -> Column:
    """Class of one USD amount; negative amounts fall in the first, NULL in none."""
    return _classify(usd, AMOUNT_CLASSES)


def count_bucket(transactions: Column) -> Column:
    """Class of a user's transaction count (>= 1); a zero count has no class."""
    return _classify(F.when(transactions >= 1, transactions), COUNT_CLASSES)
