from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from repricer.functions import money as m
from repricer.functions.pricing import currency_conflict, price_steps
from repricer.operators.pricing import encode_result, format_alert
from repricer.schemas import CONTEXT, PRICING_RESULT

NO_RULE = (None, None)


def context(spark, *, demand=(5.0, 5.0), stock=100, competitor=("1.00", "EUR"), rule=NO_RULE, factor=1.0):
    money = lambda x: x and (Decimal(x[0]), x[1])
    row = ("p", "n", *demand, stock, money(competitor), tuple(map(money, rule)), factor)
    df = spark.createDataFrame([row], CONTEXT)
    return df, F.struct(*df.columns)


def final(spark, ml, **given):
    df, ctx = context(spark, **given)
    return df.select(price_steps(ctx, F.lit(Decimal(ml)).cast(m.AMOUNT))["new_price"].alias("v")).first()["v"]


def eur(low, high):
    return ((low, "EUR"), (high, "EUR"))


def test_plain_blend(spark):
    assert final(spark, "1.12") == Decimal("1.08")


def test_every_adjustment(spark):
    price = final(
        spark, "2.00", demand=(20.0, 10.0), stock=5, factor=1.5, rule=eur("1.00", "3.00")
    )
    assert price == Decimal("2.96")


@pytest.mark.parametrize("stock, expected", [(9, "1.10"), (10, "1.00")])
def test_low_stock_is_strictly_below_ten(spark, stock, expected):
    assert final(spark, "1.00", stock=stock) == Decimal(expected)


def test_demand_equal_to_average_gives_no_uplift(spark):
    assert final(spark, "1.00", demand=(2.0, 2.0)) == Decimal("1.00")
    assert final(spark, "1.00", demand=(2.1, 2.0)) == Decimal("1.05")


def test_factor_up_to_one_is_ignored(spark):
    assert final(spark, "1.00", factor=0.5) == Decimal("1.00")


def test_clamp(spark):
    assert final(spark, "1.00", rule=eur("2.00", "3.00")) == Decimal("2.00")
    assert final(spark, "9.00", rule=eur("2.00", "3.00")) == Decimal("3.00")
    # crossed bounds: the lower one wins only below itself
    assert final(spark, "1.00", rule=eur("5.00", "2.00")) == Decimal("5.00")
    assert final(spark, "9.00", rule=eur("5.00", "2.00")) == Decimal("2.00")


@pytest.mark.parametrize(
    "rule, expected",
    [
        (NO_RULE, False),
        (eur("1.00", "3.00"), False),
        ((("1.00", "USD"), ("3.00", "USD")), True),
        ((("0.50", "EUR"), ("3.00", "USD")), True),
        ((("2.00", "EUR"), ("3.00", "USD")), False),  # below the lower bound the upper is not looked at
    ],
)
def test_currency_conflict(spark, rule, expected):
    df, ctx = context(spark, rule=rule)
    price = price_steps(ctx, F.lit(Decimal("1.00")).cast(m.AMOUNT))["after_surge"]
    assert df.select(currency_conflict(ctx, price).alias("v")).first()["v"] is expected


def test_messages(spark):
    price = (Decimal("12.50"), "EUR")
    df = spark.createDataFrame([("7", None, price, price, None, 3, 0.4)], PRICING_RESULT).withColumn(
        "ts", F.timestamp_millis(F.lit(1735689600123))
    )
    assert encode_result(df).first()["value"] == (
        '{"productId":"7","productName":null,"newPrice":{"amount":12.50,"currency":"EUR"},'
        '"modelPrediction":{"amount":12.50,"currency":"EUR"},"timestamp":1735689600123,'
        '"inventoryLevel":3,"currentDemand":0.4}'
    )
    text = "ALERT: price jump for 7 new=Money(amount=12.50, currency=EUR)"
    assert tuple(format_alert(df).first()) == (text, text)
