"""The sample tables assembled into the engine's event log.

The sample streams are sparse (a few events per product and day), so the time constants
of the surge, the surge factor's life and the inactivity gap are stretched for them; the
demand windows and the pricing rules keep their defaults. Time slices are as wide as the busiest product allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repricer.operators.demand import demand_metrics
from repricer.operators.eventlog import as_update, event_log, metric_union, tag
from repricer.operators.lookup import lookup_competitor_table
from repricer.operators.pricing import priced_rows
from repricer.operators.state import inactivity_resets
from repricer.operators.surge import surge_adjustments, surge_runs
from repricer.operators.training import training_set
from repricer.schemas import RANK
from repricer.sources.ingest import decode_json
from repricer.sources.tables import STREAMS, Sample, competitor_price, quantity, rule_bounds

SURGE = {"n": 3, "within": "24 hours"}
LINE_SURGE = {"n": 3, "within": "90 days", "slice_width": "30 days"}
GAP = "1 day"
TTL = "12 hours"


def updates(sample: Sample) -> DataFrame:
    """The five update streams united."""
    surges = surge_adjustments(surge_runs(sample.orders(), **SURGE, slice_width=sample.slice_width()))
    return metric_union(
        as_update(demand_metrics(sample.clicks()), "DEMAND"),
        as_update(sample.inventory(), "INVENTORY"),
        as_update(sample.competitor_prices(), "COMPETITOR"),
        as_update(sample.rules(), "RULE"),
        as_update(surges, "EMERGENCY"),
    )


def united_log(sample: Sample) -> DataFrame:
    """The log as the union of separate streams, as it is built from separate topics."""
    resets = as_update(inactivity_resets(sample.clicks(), gap=GAP, slice_width=sample.slice_width()), "RESET")
    return event_log(sample.clicks(), metric_union(updates(sample), resets))


def _direct(sample: Sample, *, mixed_currencies: bool) -> DataFrame:
    """Clicks, inventory, rules and competitor prices, read in one pass: they share a table."""
    kind = F.col("event_type")
    names = {"CLICK": "click", "INVENTORY": "inventory", "RULE": "rule", "COMPETITOR": "competitor"}
    tagged, rank = F.lit(None), F.lit(None)
    for name, stream in names.items():
        tagged = F.when(kind == STREAMS[stream], name).otherwise(tagged)
        rank = F.when(kind == STREAMS[stream], RANK[name]).otherwise(rank)
    payloads = {
        "quantity": F.when(kind == STREAMS["inventory"], quantity()),
        "competitor": F.when(kind == STREAMS["competitor"], competitor_price()),
        "rule": F.when(kind == STREAMS["rule"], F.struct(*rule_bounds(mixed_currencies))),
    }
    return tag(sample.events(*names.values()), tagged, rank, payloads)


def log(sample: Sample, *, mixed_currencies: bool = False) -> DataFrame:
    """Clicks, all updates and the inactivity resets."""
    clicks = sample.clicks()
    return metric_union(
        _direct(sample, mixed_currencies=mixed_currencies),
        as_update(demand_metrics(clicks), "DEMAND"),
        as_update(surge_adjustments(surge_runs(sample.orders(), **SURGE, slice_width=sample.slice_width())), "EMERGENCY"),
        as_update(inactivity_resets(clicks, gap=GAP, slice_width=sample.slice_width()), "RESET"),
    )


def message_log(sample: Sample) -> DataFrame:
    """The log from JSON messages of all kinds; competitor prices are looked up for each click."""
    clicks, orders, inventory, rules = (
        decode_json(sample.messages(kind), kind)[0] for kind in ("click", "order", "inventory", "rule")
    )
    return metric_union(
        as_update(clicks, "CLICK"),
        as_update(inventory, "INVENTORY"),
        as_update(rules, "RULE"),
        as_update(lookup_competitor_table(clicks, sample.competitor_answers()), "LOOKUP"),
        as_update(demand_metrics(clicks), "DEMAND"),
        as_update(surge_adjustments(surge_runs(orders, **SURGE, slice_width=sample.slice_width())), "EMERGENCY"),
        as_update(inactivity_resets(clicks, gap=GAP, slice_width=sample.slice_width()), "RESET"),
    )


def examples(sample: Sample) -> DataFrame:
    return training_set(log(sample), sample.sales(), ttl=TTL, slice_width=sample.slice_width())


def priced(sample: Sample) -> DataFrame:
    return priced_rows(log(sample), sample.registry(), ttl=TTL, slice_width=sample.slice_width())
