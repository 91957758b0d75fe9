"""The pricing rules as column expressions, one rounded step each."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from repricer.functions import money as m


@dataclass(frozen=True)
class Rules:
    """Constants of the pricing rules; the defaults are fixed values."""

    model_weight: Decimal = Decimal("0.7")
    competitor_weight: Decimal = Decimal("0.3")
    demand_factor: Decimal = Decimal("1.05")
    low_stock_factor: Decimal = Decimal("1.1")
    low_stock_below: int = 10
    jump_threshold: Decimal = Decimal("0.5")


DEFAULT_RULES = Rules()


def blend(model_price: Column, competitor: Column, rules: Rules = DEFAULT_RULES) -> Column:
    return m.add(
        m.multiply(model_price, rules.model_weight),
        m.multiply(competitor, rules.competitor_weight),
    )


def _raised(price: Column, applies: Column, factor: Decimal) -> Column:
    # times one is exact, and `price` stays a single reference in a chain of steps
    return m.multiply(price, F.when(applies, F.lit(factor)).otherwise(F.lit(Decimal(1))))


def demand_uplift(price: Column, current: Column, average: Column, rules: Rules = DEFAULT_RULES) -> Column:
    return _raised(price, current > average, rules.demand_factor)


def stock_uplift(price: Column, inventory: Column, rules: Rules = DEFAULT_RULES) -> Column:
    return _raised(price, inventory < rules.low_stock_below, rules.low_stock_factor)


def surge_uplift(price: Column, factor: Column) -> Column:
    return m.multiply(price, F.greatest(factor, F.lit(1.0)))


def clamp(price: Column, lowest: Column, highest: Column) -> Column:
    """The lower bound is tried first; a NULL bound is no bound."""
    return F.when(price < lowest, lowest).when(price > highest, highest).otherwise(price)


def linear_price(ctx: Column, model: Column) -> Column:
    """Price of a linear model over (inventory, current demand, competitor price)."""
    return m.amount(
        F.round(
            model["bias"]
            + model["w_inventory"] * ctx["inventory_level"].cast("decimal(10,0)")
            + model["w_demand"] * ctx["current_demand"].cast("decimal(18,4)")
            + model["w_competitor"] * ctx["competitor_price"]["amount"],
            2,
        )
    )


def price_steps(ctx: Column, model_price: Column, rules: Rules = DEFAULT_RULES) -> dict[str, Column]:
    """Every intermediate price of one context struct, in rule order."""
    blended = blend(model_price, ctx["competitor_price"]["amount"], rules)
    after_demand = demand_uplift(blended, ctx["current_demand"], ctx["historical_average"], rules)
    after_stock = stock_uplift(after_demand, ctx["inventory_level"], rules)
    after_surge = surge_uplift(after_stock, ctx["adjustment_factor"])
    bounds = ctx["price_rule"]
    final = clamp(after_surge, bounds["min_price"]["amount"], bounds["max_price"]["amount"])
    return {
        "blended": blended,
        "after_demand": after_demand,
        "after_stock": after_stock,
        "after_surge": after_surge,
        "new_price": final,
    }


def rule_currency(ctx: Column) -> Column:
    """Model prices are in the currency of the lower bound, or the default one."""
    return F.coalesce(ctx["price_rule"]["min_price"]["currency"], F.lit(m.DEFAULT_CURRENCY))


def currency_conflict(ctx: Column, unclamped: Column) -> Column:
    """True when pricing this context would have to combine two currencies.

    The upper bound only matters when the price is not below the lower one.
    """
    low, high = ctx["price_rule"]["min_price"], ctx["price_rule"]["max_price"]
    blend_conflict = ~rule_currency(ctx).eqNullSafe(ctx["competitor_price"]["currency"])
    bound_conflict = (
        high["amount"].isNotNull()
        & ~(unclamped < low["amount"])
        & ~high["currency"].eqNullSafe(low["currency"])
    )
    return blend_conflict | F.coalesce(bound_conflict, F.lit(False))


def is_jump(new: Column, previous: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """round((new - previous) / previous, 2) > threshold without dividing.

    A quotient rounded half up to two decimals exceeds the threshold exactly
    when it reaches the threshold plus half a cent of a unit.
    """
    edge = F.lit(rules.jump_threshold + Decimal("0.005")) * previous
    change = (new - previous).cast("decimal(20,2)")
    return F.coalesce(
        ((previous > 0) & (change >= edge)) | ((previous < 0) & (change <= edge)), F.lit(False)
    )
