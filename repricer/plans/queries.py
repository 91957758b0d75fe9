"""The registered queries: each operator over the whole sample tables.

Results are flattened for comparison: struct fields become columns, amounts become
doubles and instants become timestamps without zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repricer.functions import money as m
from repricer.operators import demand, eventlog, lookup, model, pricing, state, surge, training
from repricer.plans import feeds
from repricer.sources import ingest
from repricer.sources.tables import Sample

Query = Callable[[SparkSession, str], DataFrame]


def flat(df: DataFrame) -> DataFrame:
    def leaves(column: Column, dtype: T.DataType, name: str) -> list[Column]:
        if isinstance(dtype, T.StructType):
            parts = [leaves(column[f.name], f.dataType, f"{name}_{f.name}") for f in dtype]
            return [leaf for part in parts for leaf in part]
        if isinstance(dtype, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(dtype, T.DecimalType):
            column = column.cast("double")
        return [column.alias(name)]

    return df.select(*[c for f in df.schema for c in leaves(F.col(f.name), f.dataType, f.name)])


def decoded(kind: str) -> Callable[[Sample], DataFrame]:
    def run(sample: Sample) -> DataFrame:
        good, _ = ingest.decode_json(sample.messages(kind), kind)
        return flat(good)

    return run


def damaged_messages(sample: Sample) -> DataFrame:
    """All events as order messages, damaged in a way that depends on their type."""
    rows = sample.events()
    order = F.struct(
        F.col("seq").cast("string").alias("orderId"),
        F.col("product_id").alias("productId"),
        F.col("product_name").alias("productName"),
        F.floor("value").cast("int").alias("quantity"),
        F.unix_millis("ts").alias("timestamp"),
    )
    whole = F.to_json(order)
    kind = F.col("event_type")
    value = (
        F.when(kind == "click", F.expr("substr(whole, 1, length(whole) - 1)"))
        .when(kind == "view", F.to_json(F.struct(F.lit("x").alias("colour"), order["orderId"].alias("orderId"))))
        .when(kind == "error", F.to_json(F.struct(order["orderId"].alias("orderId"), F.lit("many").alias("quantity"))))
        .when(kind == "signup", F.to_json(F.struct(order["orderId"].alias("orderId"), order["productId"].alias("productId"))))
        .otherwise(F.col("whole"))
    )
    return rows.withColumn("whole", whole).select(value.alias("value"), F.col("ts").alias("timestamp"))


def decode_quarantine(sample: Sample) -> DataFrame:
    """Both outputs of decoding damaged orders, counted per reason and accepted content."""
    good, bad = ingest.decode_json(damaged_messages(sample), "order")
    accepted = good.select(
        F.lit("accepted").alias("reason"),
        F.col("product_name").isNull().alias("without_name"),
        F.col("quantity").cast("bigint").alias("quantity"),
    )
    refused = bad.select("reason", F.lit(None).cast("boolean").alias("without_name"), F.lit(0).cast("bigint").alias("quantity"))
    return accepted.unionByName(refused).groupBy("reason", "without_name").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("quantity").alias("quantity")
    )


def demand_short(sample: Sample) -> DataFrame:
    return flat(demand.sliding_rate(sample.clicks(), size="5 minutes", slide="1 minute"))


def demand_long(sample: Sample) -> DataFrame:
    return flat(demand.sliding_rate(sample.clicks(), size="1 hour", slide="5 minutes"))


def demand_metrics(sample: Sample) -> DataFrame:
    return flat(demand.demand_metrics(sample.clicks()).drop("seq"))


def surge_runs(sample: Sample) -> DataFrame:
    return flat(surge.surge_runs(sample.orders(), **feeds.SURGE, slice_width=sample.slice_width()))


def surge_runs_lines(sample: Sample) -> DataFrame:
    return flat(surge.surge_runs(sample.line_orders(), **feeds.LINE_SURGE).drop("product_name"))


def surge_adjustments(sample: Sample) -> DataFrame:
    return flat(surge.surge_adjustments(surge.surge_runs(sample.orders(), **feeds.SURGE, slice_width=sample.slice_width())))


def competitor_lookup(sample: Sample) -> DataFrame:
    clicks = sample.clicks()
    return flat(lookup.lookup_competitor_table(clicks, sample.competitor_answers()))


def competitor_parse(sample: Sample) -> DataFrame:
    kind = F.col("event_type")
    priced = F.to_json(F.struct(F.col("value").alias("price")))
    responses = sample.events().select(
        "seq",
        "product_id",
        F.when(kind == "view", 404).when(kind == "error", 500).when(kind != "purchase", 200).alias("status"),
        F.when(kind == "signup", F.lit('{"cost": 1.5}')).when(kind != "view", priced).alias("body"),
    )
    parsed = lookup.parse_competitor_response(responses)
    return flat(parsed.select("seq", "product_id", "price", "is_error"))


def metric_union(sample: Sample) -> DataFrame:
    return flat(feeds.updates(sample))


def event_log(sample: Sample) -> DataFrame:
    return flat(feeds.united_log(sample))


def price_triggers(sample: Sample) -> DataFrame:
    rows = eventlog.triggers(feeds.log(sample))
    return flat(rows.select("product_id", "ts", "rank", "seq", "metric_type", "product_name"))


def inactivity_resets(sample: Sample) -> DataFrame:
    clicks = sample.clicks()
    return flat(state.inactivity_resets(clicks, gap=feeds.GAP, slice_width=sample.slice_width()))


def inactivity_resets_tail(sample: Sample) -> DataFrame:
    """The default gap, with the reset after a product's last click."""
    clicks = sample.clicks()
    return flat(state.inactivity_resets(clicks, close_tail=True, slice_width=sample.slice_width()))


def state_asof(sample: Sample) -> DataFrame:
    return flat(state.state_asof(feeds.log(sample), slice_width=sample.slice_width()).drop("slice"))


def _context(sample: Sample) -> DataFrame:
    return state.pricing_context(feeds.log(sample), ttl=feeds.TTL, slice_width=sample.slice_width())


def emergency_ttl(sample: Sample) -> DataFrame:
    return flat(_context(sample).select("product_id", "ts", "rank", "seq", "adjustment_factor"))


def pricing_context(sample: Sample) -> DataFrame:
    return flat(_context(sample).drop("slice"))


def model_asof(sample: Sample) -> DataFrame:
    attached = model.attach_model(
        sample.events().select("seq", "ts", "product_id"), sample.registry()
    )
    return flat(
        attached.select(
            "seq",
            "ts",
            "product_id",
            F.col("model.model_id").alias("model_id"),
            F.col("model.effective_ts").alias("effective_ts"),
            F.col("model.bias").alias("bias"),
        )
    )


def model_score(sample: Sample) -> DataFrame:
    scored = model.score(_context(sample), sample.registry())
    return flat(
        scored.select("product_id", "ts", "rank", "seq", F.col("model.model_id").alias("model_id"), "model_price")
    )


def price_steps(sample: Sample) -> DataFrame:
    return flat(
        feeds.priced(sample).select(
            "product_id",
            "ts",
            "rank",
            "seq",
            "model_price",
            "blended",
            "after_demand",
            "after_stock",
            "after_surge",
            F.col("new_price.amount").alias("new_price"),
        )
    )


def reprice(sample: Sample) -> DataFrame:
    """The flagship: all inputs to the price stream."""
    rows = feeds.priced(sample).where(~F.col("is_conflict"))
    return flat(rows.select(*pricing.RESULT))


def reprice_from_messages(sample: Sample) -> DataFrame:
    """The same from JSON messages, decoded and run through every operator."""
    log = feeds.message_log(sample)
    return flat(pricing.price_batch(log, sample.registry(), ttl=feeds.TTL, slice_width=sample.slice_width()))


def training_set(sample: Sample) -> DataFrame:
    return flat(feeds.examples(sample).drop("slice", "rank", "metric_type", "product_name"))


def model_eval(sample: Sample) -> DataFrame:
    return training.model_errors(feeds.examples(sample), sample.registry())


def product_effects(sample: Sample) -> DataFrame:
    return flat(training.product_effects(feeds.examples(sample), sample.registry()))


def _alerts(sample: Sample) -> DataFrame:
    return pricing.price_alerts(feeds.priced(sample))


def price_alerts(sample: Sample) -> DataFrame:
    return flat(_alerts(sample))


def alert_text(sample: Sample) -> DataFrame:
    return pricing.format_alert(_alerts(sample))


def encode_result(sample: Sample) -> DataFrame:
    results = feeds.priced(sample).where(~F.col("is_conflict"))
    return pricing.encode_result(results)


def currency_mismatch(sample: Sample) -> DataFrame:
    log = feeds.log(sample, mixed_currencies=True)
    return flat(
        pricing.currency_mismatches(
            log, sample.registry(), ttl=feeds.TTL, slice_width=sample.slice_width()
        )
    )


def money_ops(sample: Sample) -> DataFrame:
    """Every money function over the order lines."""
    a, b = m.amount(F.col("l_extendedprice")), m.amount(F.col("l_quantity"))
    lines = sample.table("lineitem")
    return flat(
        lines.select(
            "l_orderkey",
            "l_linenumber",
            a.alias("amount"),
            m.add(a, b).alias("added"),
            m.subtract(b, a).alias("subtracted"),
            m.divide(a, b).alias("divided"),
            m.absolute(m.subtract(b, a)).alias("absolute"),
            m.multiply(a, F.col("l_tax")).alias("multiplied"),
            m.less_than(a, b).alias("is_less"),
            m.greater_than(a, b).alias("is_greater"),
        )
    )


def _over_tables(query: Callable[[Sample], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(Sample(spark, sf_dir))


_REGISTERED: dict[str, Callable[[Sample], DataFrame]] = {
    "decode_clicks": decoded("click"),
    "decode_orders": decoded("order"),
    "decode_inventory": decoded("inventory"),
    "decode_rules": decoded("rule"),
    "decode_quarantine": decode_quarantine,
    "demand_short": demand_short,
    "demand_long": demand_long,
    "demand_metrics": demand_metrics,
    "surge_runs": surge_runs,
    "surge_runs_lines": surge_runs_lines,
    "surge_adjustments": surge_adjustments,
    "competitor_lookup": competitor_lookup,
    "competitor_parse": competitor_parse,
    "metric_union": metric_union,
    "event_log": event_log,
    "price_triggers": price_triggers,
    "inactivity_resets": inactivity_resets,
    "inactivity_resets_tail": inactivity_resets_tail,
    "state_asof": state_asof,
    "emergency_ttl": emergency_ttl,
    "pricing_context": pricing_context,
    "model_asof": model_asof,
    "model_score": model_score,
    "price_steps": price_steps,
    "reprice": reprice,
    "reprice_from_messages": reprice_from_messages,
    "training_set": training_set,
    "model_eval": model_eval,
    "product_effects": product_effects,
    "price_alerts": price_alerts,
    "alert_text": alert_text,
    "encode_result": encode_result,
    "currency_mismatch": currency_mismatch,
    "money_ops": money_ops,
}
QUERIES: dict[str, Query] = {name: _over_tables(query) for name, query in _REGISTERED.items()}
