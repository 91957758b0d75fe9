"""Last known values per product, as of each row of the event log.

A product can hold most of the log, so its history is never sorted as one group. It is cut
into time slices: the running window over the log stays inside (product, slice), each slice
is also summed up to its last values, and a running window over those few summary rows
gives what a slice inherits from all earlier ones. The log is shuffled once; both uses
read that shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repricer.functions.intervals import micros, slice_start
from repricer.functions.money import money
from repricer.operators.eventlog import triggers
from repricer.schemas import PAYLOADS

DEFAULT_SLICE = "1 hour"
EMERGENCY_TTL = "10 minutes"
# The total order of a product's rows. Kind and name only settle rows that are equal
# otherwise, and make every use of the log need the same columns of its shuffle.
ORDER = ("ts", "rank", "seq", "metric_type", "product_name")


def _inherited(in_slice: DataFrame, payloads: Sequence[str]) -> DataFrame:
    """For each (product, slice) the last values of all earlier slices, as column `before`.

    A slice's last row holds the last values of the slice already.
    """
    earlier = (
        Window.partitionBy("product_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = [F.last(name, ignorenulls=True).over(earlier).alias(name) for name in payloads]
    return in_slice.where("is_last").select("product_id", "slice", F.struct(*before).alias("before"))


def state_asof(log: DataFrame, *, slice_width: str = DEFAULT_SLICE, payloads: Sequence[str] = tuple(PAYLOADS)) -> DataFrame:
    """Each log row with the latest value of every payload up to and including itself.

    The output keeps `slice`; it is partitioned by (product_id, slice). `payloads` may name further columns of the log.
    """
    # rows without product or time belong to no state; ruling them out here, for both uses
    # of the shuffle, also keeps the join from filtering one of the two differently
    sliced = (
        log.where(F.col("product_id").isNotNull() & F.col("ts").isNotNull())
        .withColumn("slice", slice_start(F.col("ts"), micros(slice_width)))
        .where(F.col("slice").isNotNull())
        .repartition("product_id", "slice")
    )
    so_far = (
        Window.partitionBy("product_id", "slice")
        .orderBy(*ORDER)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    held = [F.last(name, ignorenulls=True).over(so_far).alias(name) for name in payloads]
    is_last = F.lead(F.lit(1)).over(Window.partitionBy("product_id", "slice").orderBy(*ORDER)).isNull()
    in_slice = sliced.select("product_id", "slice", *ORDER, *held, is_last.alias("is_last"))
    known = [F.coalesce(F.col(name), F.col(f"before.{name}")).alias(name) for name in payloads]
    return in_slice.join(_inherited(in_slice, payloads), ["product_id", "slice"], "left").select(
        "product_id", *ORDER, "slice", *known
    )


def with_defaults(state: DataFrame, *, ttl: str = EMERGENCY_TTL, keep: Sequence[str] = ()) -> DataFrame:
    """Values used when nothing is known yet; an expired surge factor counts as unknown. `keep` names columns to pass on."""
    alive = F.unix_micros("ts") < F.unix_micros(F.col("emergency.written_at")) + micros(ttl)
    bounds = F.col("rule")
    return state.select(
        "product_id",
        *ORDER,
        "slice",
        F.coalesce("demand.current_demand", F.lit(0.0)).alias("current_demand"),
        F.coalesce("demand.historical_average", F.lit(0.0)).alias("historical_average"),
        F.coalesce("quantity", F.lit(0)).alias("inventory_level"),
        F.coalesce("competitor", money(F.lit("0.00"))).alias("competitor_price"),
        bounds.alias("price_rule"),
        F.coalesce(F.when(alive, F.col("emergency.factor")), F.lit(1.0)).alias("adjustment_factor"),
        *keep,
    )


def pricing_context(
    log: DataFrame, *, ttl: str = EMERGENCY_TTL, slice_width: str = DEFAULT_SLICE
) -> DataFrame:
    """The facts one price is computed from, for every trigger in the log."""
    return with_defaults(triggers(state_asof(log, slice_width=slice_width)), ttl=ttl)


def inactivity_resets(
    clicks: DataFrame,
    *,
    gap: str = "5 minutes",
    close_tail: bool = True,
    slice_width: str = DEFAULT_SLICE,
) -> DataFrame:
    """An instant `gap` after each click that saw no newer click until later than that.

    The next click is looked up inside a time slice. A slice's last click takes it from the
    first one of the product's next slice: only those edge rows, two per slice, are ordered
    across the whole product. A product's last click is followed by a reset too, as its
    timer needs no later click; without `close_tail` it is left out, for a log that goes on.
    """
    gap_us, width = micros(gap), micros(slice_width)
    in_slice = Window.partitionBy("product_id", "slice").orderBy("ts", "seq")
    whole = Window.partitionBy("product_id").orderBy("ts", "seq")
    framed = (
        clicks.select("product_id", "product_name", "ts", "seq")
        .withColumn("slice", slice_start(F.col("ts"), width))
        .repartition("product_id", "slice")
        .withColumn("next_ts", F.lead("ts").over(in_slice))
        .withColumn("is_first", F.lag("ts").over(in_slice).isNull())
    )
    is_last = F.col("next_ts").isNull()
    edges = (
        framed.where(F.col("is_first") | is_last)
        .withColumn("edge_ts", F.lead("ts").over(whole))
        .where(is_last)
        .withColumn("next_ts", F.col("edge_ts"))
        .drop("edge_ts")
    )
    quiet = F.unix_micros("next_ts") > F.unix_micros("ts") + gap_us
    if close_tail:
        quiet = quiet | F.col("next_ts").isNull()
    return (
        framed.where(~is_last)
        .unionByName(edges)
        .where(quiet)
        .select(
            "product_id",
            "product_name",
            F.timestamp_micros(F.unix_micros("ts") + gap_us).alias("ts"),
            "seq",
            F.col("ts").alias("last_click_ts"),
        )
    )
