"""Fixed schemas: the JSON messages, the event log and the model registry."""

from __future__ import annotations

from repricer.functions.money import MONEY

# Payload columns of the event log; each update fills one of them.
RULE = f"struct<min_price: {MONEY}, max_price: {MONEY}>"
DEMAND = "struct<current_demand: double, historical_average: double>"
EMERGENCY = "struct<factor: double, written_at: timestamp>"
PAYLOADS = {
    "demand": DEMAND,
    "quantity": "int",
    "competitor": MONEY,
    "rule": RULE,
    "emergency": EMERGENCY,
}

EVENT_LOG = (
    "product_id string, ts timestamp, rank int, seq bigint, metric_type string, product_name string, "
    + ", ".join(f"{name} {kind}" for name, kind in PAYLOADS.items())
)

# Order of a product's rows that share one instant.
RANK = {
    "SALE": -1,
    "DEMAND": 0,
    "INVENTORY": 1,
    "RULE": 1,
    "EMERGENCY": 1,
    "COMPETITOR": 1,
    "CLICK": 2,
    "LOOKUP": 3,
    "RESET": 4,
}
TRIGGERS = ("CLICK", "INVENTORY", "RULE", "EMERGENCY", "RESET")

MODEL_FIELDS = (
    "model_id", "effective_ts", "kind", "bias", "w_inventory", "w_demand", "w_competitor", "artifact_uri",
)
MODEL = (
    "model_id string, effective_ts timestamp, kind string, bias decimal(18,4), "
    "w_inventory decimal(10,4), w_demand decimal(10,4), w_competitor decimal(10,4), artifact_uri string"
)

CONTEXT = (
    "product_id string, product_name string, current_demand double, historical_average double, "
    f"inventory_level int, competitor_price {MONEY}, price_rule {RULE}, adjustment_factor double"
)

PRICING_RESULT = (
    f"product_id string, product_name string, new_price {MONEY}, model_prediction {MONEY}, "
    "ts timestamp, inventory_level int, current_demand double"
)
