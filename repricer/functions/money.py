"""Exact money arithmetic on columns.

Money is STRUCT<amount: DECIMAL(18,2), currency: STRING>. Every operation rounds
its own result half up to two decimals, so chains must be built step by step
from these functions instead of one long product.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(18,2)"
FACTOR = "decimal(10,6)"
MONEY = f"struct<amount: {AMOUNT}, currency: string>"
DEFAULT_CURRENCY = "EUR"


def amount(value: Column) -> Column:
    """Rescale to two decimals, half up; doubles go through their shortest text."""
    return value.cast(AMOUNT)


def money(value: Column, currency: Column | str = DEFAULT_CURRENCY) -> Column:
    code = F.lit(currency) if isinstance(currency, str) else currency
    return F.struct(amount(value).alias("amount"), code.alias("currency"))


def add(a: Column, b: Column) -> Column:
    return amount(a + b)


def subtract(a: Column, b: Column) -> Column:
    return amount(a - b)


def multiply(a: Column, factor: Column | float | Decimal) -> Column:
    f = factor.cast(FACTOR) if isinstance(factor, Column) else F.lit(Decimal(str(factor)))
    return amount(a * f)


def divide(a: Column, b: Column) -> Column:
    """Rounded quotient; NULL when the divisor is zero."""
    return amount(F.round(F.try_divide(a, b), 2))


def absolute(a: Column) -> Column:
    return amount(F.abs(a))


def less_than(a: Column, b: Column) -> Column:
    return a < b


def greater_than(a: Column, b: Column) -> Column:
    return a > b


def same_currency(a: Column, b: Column) -> Column:
    """True when two money structs can be combined at all."""
    return a["currency"].eqNullSafe(b["currency"])


def require_same_currency(a: Column, b: Column, result: Column) -> Column:
    """`result`, or a query error when the two structs differ in currency."""
    return F.when(same_currency(a, b), result).otherwise(
        F.raise_error(F.lit("Currency mismatch"))
    )
