"""From the event log to prices and price-jump alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repricer.functions.money import money
from repricer.functions.pricing import (
    DEFAULT_RULES,
    Rules,
    currency_conflict,
    is_jump,
    price_steps,
    rule_currency,
)
from repricer.operators.model import Scorer, score
from repricer.operators.state import DEFAULT_SLICE, EMERGENCY_TTL, ORDER, pricing_context

RESULT = (
    "product_id", "product_name", "new_price", "model_prediction", "ts", "inventory_level", "current_demand",
)


def apply_rules(scored: DataFrame, *, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Add every price step, the result columns and `is_conflict` to scored contexts."""
    ctx = F.struct(*[F.col(name) for name in scored.columns])
    steps = price_steps(ctx, F.col("model_price"), rules)
    currency = rule_currency(ctx)
    return scored.select(
        "*",
        *[step.alias(name) for name, step in steps.items() if name != "new_price"],
        money(steps["new_price"], currency).alias("new_price"),
        money(F.col("model_price"), currency).alias("model_prediction"),
        currency_conflict(ctx, steps["after_surge"]).alias("is_conflict"),
    )


def priced_rows(
    log: DataFrame,
    registry: DataFrame,
    *,
    scorer: str | Scorer = "linear",
    rules: Rules = DEFAULT_RULES,
    ttl: str = EMERGENCY_TTL,
    slice_width: str = DEFAULT_SLICE,
) -> DataFrame:
    """Every trigger that has a model, with context, price steps and conflict flag."""
    context = pricing_context(log, ttl=ttl, slice_width=slice_width)
    return apply_rules(score(context, registry, scorer=scorer), rules=rules)


def price_batch(log: DataFrame, registry: DataFrame, **options) -> DataFrame:
    """The price stream: one result per trigger, conflicting currencies left out."""
    return priced_rows(log, registry, **options).where(~F.col("is_conflict")).select(*RESULT)


def currency_mismatches(log: DataFrame, registry: DataFrame, **options) -> DataFrame:
    """Triggers that cannot be priced because their amounts differ in currency."""
    return (
        priced_rows(log, registry, **options)
        .where(F.col("is_conflict"))
        .select(
            "product_id",
            "ts",
            "seq",
            "metric_type",
            F.col("price_rule.min_price.currency").alias("min_currency"),
            F.col("price_rule.max_price.currency").alias("max_currency"),
            F.col("competitor_price.currency").alias("competitor_currency"),
        )
    )


def with_previous_price(emitted: DataFrame) -> DataFrame:
    """Add `previous_price`, the product's price before this one.

    Inside a time slice this is the row before. The first row of a slice takes it from the
    last row of the product's preceding slice: only those edge rows, two per slice, are
    ordered across the whole product.
    """
    in_slice = Window.partitionBy("product_id", "slice").orderBy(*ORDER)
    whole = Window.partitionBy("product_id").orderBy("slice", *ORDER)
    # both uses below read this shuffle, so nothing before it is computed twice
    placed = emitted.repartition("product_id", "slice")
    framed = (
        placed.withColumn("previous_price", F.lag("new_price.amount").over(in_slice))
        .withColumn("is_last", F.lead("ts").over(in_slice).isNull())
        .withColumn("nth", F.row_number().over(in_slice))
    )
    # not by the price: that of the row before may be NULL
    is_first = F.col("nth") == 1
    inner = framed.where(~is_first)
    edges = (
        framed.where(is_first | F.col("is_last"))
        .withColumn("edge_price", F.lag("new_price.amount").over(whole))
        .where(is_first)
        .withColumn("previous_price", F.col("edge_price"))
        .drop("edge_price")
    )
    return inner.unionByName(edges).drop("is_last", "nth")


def alert_condition(new: Column, previous: Column, metric_type: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """A jump of the price; an inactivity recompute never alerts."""
    return is_jump(new, previous, rules) & (metric_type != "RESET")


def price_alerts(priced: DataFrame, *, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Results whose price jumped, in addition to their place in the price stream.

    Takes the output of `priced_rows`.
    """
    emitted = priced.where(~F.col("is_conflict")).select(*RESULT, "rank", "seq", "metric_type", "slice")
    return (
        with_previous_price(emitted)
        .where(
            alert_condition(
                F.col("new_price.amount"), F.col("previous_price"), F.col("metric_type"), rules
            )
        )
        .select(*RESULT, "previous_price", "seq")
    )


def alert_value() -> Column:
    """The alert message of a result row."""
    return F.concat(
        F.lit("ALERT: price jump for "),
        F.col("product_id"),
        F.lit(" new=Money(amount="),
        F.col("new_price.amount").cast("string"),
        F.lit(", currency="),
        F.col("new_price.currency"),
        F.lit(")"),
    )


def format_alert(alerts: DataFrame) -> DataFrame:
    """Alert messages; the text is key and value at once."""
    return alerts.select(alert_value().alias("key"), alert_value().alias("value"))


def result_value() -> Column:
    """A result row as JSON, fields in record order."""
    record = F.struct(
        F.col("product_id").alias("productId"),
        F.col("product_name").alias("productName"),
        F.col("new_price").alias("newPrice"),
        F.col("model_prediction").alias("modelPrediction"),
        F.unix_millis("ts").alias("timestamp"),
        F.col("inventory_level").alias("inventoryLevel"),
        F.col("current_demand").alias("currentDemand"),
    )
    return F.to_json(record, {"ignoreNullFields": "false"})


def encode_result(results: DataFrame) -> DataFrame:
    """Price messages: key is the product id, value the result as JSON."""
    return results.select(F.col("product_id").alias("key"), result_value().alias("value"))
