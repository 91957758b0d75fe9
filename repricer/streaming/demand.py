"""Demand rates on a click stream.

Late clicks are dropped: a window is final once the watermark has passed its end. Clicks are
counted in cells first, one per slide, and the sliding windows are added up from finished cells: a click touches one
cell of the state, not every window it lies in. The cells are counted inside the map tasks first, so a hot product
sends one partial count per cell and task. The join keeps its range predicate on the window times, which is what lets
Spark drop finished windows from the join state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repricer.functions.intervals import micros

CLICK_WATERMARK = "30 seconds"


def sliding_rate(
    clicks: DataFrame,
    *,
    size: str = "5 minutes",
    slide: str = "1 minute",
    watermark: str | None = CLICK_WATERMARK,
) -> DataFrame:
    """Clicks per minute of each sliding window, with `at`, the window's event time."""
    if micros(size) % micros(slide):
        raise ValueError("window size must be a multiple of its slide")
    timed = clicks.withWatermark("ts", watermark) if watermark else clicks
    cells = (
        timed.groupBy("product_id", F.window("ts", slide).alias("cell"))
        .agg(F.count(F.lit(1)).alias("clicks"), F.min(F.struct("ts", "product_name")).alias("first"))
        .select("product_id", F.window_time("cell").alias("cell_at"), "clicks", "first")
    )
    return (
        cells.groupBy("product_id", F.window("cell_at", size, slide).alias("window"))
        .agg(F.sum("clicks").alias("clicks"), F.min("first").alias("first"))
        .select(
            "product_id",
            F.coalesce("first.product_name", F.lit("")).alias("product_name"),
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "clicks",
            (F.col("clicks") / F.lit(micros(size) / micros("1 minute"))).alias("rate"),
            F.window_time("window").alias("at"),
        )
    )


def demand_metrics(
    clicks: DataFrame,
    *,
    short: tuple[str, str] = ("5 minutes", "1 minute"),
    long: tuple[str, str] = ("1 hour", "5 minutes"),
    tolerance: str = "150 seconds",
    watermark: str = CLICK_WATERMARK,
) -> DataFrame:
    """Short-window rates joined with the long-window rates ending within the tolerance."""
    timed = clicks.withWatermark("ts", watermark)
    current = sliding_rate(timed, size=short[0], slide=short[1], watermark=None).alias("s")
    average = sliding_rate(timed, size=long[0], slide=long[1], watermark=None).alias("l")
    near = F.expr(
        "s.product_id = l.product_id"
        f" AND l.at >= s.at - INTERVAL {tolerance} AND l.at <= s.at + INTERVAL {tolerance}"
    )
    return current.join(average, near).select(
        F.col("s.product_id").alias("product_id"),
        F.col("s.product_name").alias("product_name"),
        F.col("s.window_end").alias("short_end"),
        F.col("l.window_end").alias("long_end"),
        F.col("s.rate").alias("current_demand"),
        F.col("l.rate").alias("historical_average"),
        F.greatest("s.window_end", "l.window_end").alias("ts"),
        F.unix_micros("s.window_end").alias("seq"),
    )
