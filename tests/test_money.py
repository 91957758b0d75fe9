from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from repricer.functions import money as m
from repricer.functions.pricing import is_jump


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def dec(text):
    return F.lit(Decimal(text)).cast(m.AMOUNT)


@pytest.mark.parametrize("given, expected", [(1.234, "1.23"), (1.235, "1.24"), (2.675, "2.68"), (-0.505, "-0.51")])
def test_rescaled_half_up(spark, given, expected):
    assert value(spark, m.amount(F.lit(given))) == Decimal(expected)


def test_arithmetic_rounds_each_step(spark):
    assert value(spark, m.add(dec("1.10"), dec("2.25"))) == Decimal("3.35")
    assert value(spark, m.subtract(dec("1.10"), dec("2.25"))) == Decimal("-1.15")
    assert value(spark, m.multiply(dec("1.00"), 0.333)) == Decimal("0.33")
    assert value(spark, m.multiply(dec("2.00"), F.lit(1.5))) == Decimal("3.00")
    assert value(spark, m.divide(dec("1.00"), dec("8.00"))) == Decimal("0.13")
    assert value(spark, m.divide(dec("1.00"), dec("0.00"))) is None
    assert value(spark, m.absolute(dec("-1.15"))) == Decimal("1.15")
    assert value(spark, m.less_than(dec("1.00"), dec("1.01"))) is True
    assert value(spark, m.greater_than(dec("1.00"), dec("1.01"))) is False


def test_currencies_must_agree(spark):
    eur, gbp = m.money(dec("1.00"), "EUR"), m.money(dec("1.00"), "GBP")
    both = m.add(eur["amount"], gbp["amount"])
    assert value(spark, m.same_currency(eur, eur)) and not value(spark, m.same_currency(eur, gbp))
    assert value(spark, m.require_same_currency(eur, eur, both)) == Decimal("2.00")
    with pytest.raises(Exception, match="Currency mismatch"):
        value(spark, m.require_same_currency(eur, gbp, both))


@pytest.mark.parametrize(
    "old, new, expected",
    [
        ("100.00", "150.49", False),
        ("100.00", "150.50", True),
        ("100.00", "10.00", False),
        ("0.00", "10.00", False),
        ("-100.00", "-150.50", True),
        ("-100.00", "-150.49", False),
        ("-100.00", "50.00", False),
    ],
)
def test_jump_edges(spark, old, new, expected):
    assert value(spark, is_jump(dec(new), dec(old))) is expected


def test_no_previous_price_is_no_jump(spark):
    assert value(spark, is_jump(dec("1.00"), F.lit(None).cast(m.AMOUNT))) is False
