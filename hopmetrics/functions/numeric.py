"""Turning payload text into numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal or scientific number. Java-only spellings that a Spark cast
# would take ("1d", "0x1p3", "NaN", "Infinity") do not match: one NaN or
# infinity would swallow every sum it enters.
NUMBER_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def clean_double(text: Column) -> Column:
    """Payload text as DOUBLE; arrays, objects, booleans and other junk give NULL.

    Nested JSON values reach a string leaf as JSON text ("[1,2]"), so the type
    test and the parse are one pattern.
    """
    trimmed = F.trim(text)
    number = F.when(trimmed.rlike(NUMBER_TEXT), trimmed).try_cast("double")
    return _finite(number)


def _finite(number: Column) -> Column:
    return F.when(F.abs(number) < F.lit(math.inf), number)


def safe_product(left: Column, right: Column) -> Column:
    """``left * right`` on cleaned text, NULL when either side is bad or the product is too large."""
    return _finite(clean_double(left) * clean_double(right))


def fee_with_fallback(gas_used: Column, token_usd: Column, express_fee: Column) -> Column:
    """Gas cost in USD, else the express fee."""
    return F.coalesce(safe_product(gas_used, token_usd), clean_double(express_fee))
