"""Sliding-window click rates and the demand pair joined from two horizons.

Clicks are counted once per product and grid cell before any window is built,
so a window copies cells, not clicks, and a product with most of the clicks
shrinks to one row per cell inside the map tasks. The cells are then placed once
by (product, time slice); every window and the interval join is evaluated inside
its slice without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repricer.functions.intervals import ceil_to, floor_to, micros

DEFAULT_SLICE = "1 day"


def _cells(clicks: DataFrame, width: int, first_end: int, last_end: int, slice_width: int) -> DataFrame:
    """Click counts per product and cell, copied to each slice whose window ends need them.

    A cell starting at `c` feeds window ends from `c + first_end` to `c + last_end`;
    with slices much longer than the windows nearly every cell has one copy.
    """
    counted = (
        clicks.select("product_id", "product_name", F.unix_micros("ts").alias("at"))
        .groupBy("product_id", floor_to(F.col("at"), width).alias("cell"), "product_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    )
    slices = F.sequence(
        floor_to(F.col("cell") + first_end, slice_width),
        floor_to(F.col("cell") + last_end, slice_width),
        F.lit(slice_width),
    )
    # a fixed number of partitions: adaptive merging would go by the size of the cells, but
    # each of them is about to be copied to every window it counts in
    partitions = int(clicks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.withColumn("slice", F.explode(slices)).repartition(partitions, "product_id", "slice")


def _window_of(long_end: Column, short_end: Column) -> Column:
    return F.struct(long_end.alias("end"), short_end.cast("bigint").alias("short_end"))


def sliding_rate(
    clicks: DataFrame,
    *,
    size: str = "5 minutes",
    slide: str = "1 minute",
    per_minutes: float | None = None,
    slice_width: str = DEFAULT_SLICE,
) -> DataFrame:
    """Clicks per minute in epoch-aligned sliding windows; empty windows give no row."""
    size_us, slide_us, slice_us = micros(size), micros(slide), micros(slice_width)
    if size_us % slide_us:
        raise ValueError("window size must be a multiple of its slide")
    minutes = per_minutes or size_us / micros("1 minute")
    ends = F.sequence(F.col("cell") + slide_us, F.col("cell") + size_us, F.lit(slide_us))
    # the name is that of the earliest click, equal instants settled by the name itself; counted per
    # name on fixed-width values, which hash aggregation can hold
    of_window = Window.partitionBy("product_id", "slice", "end").orderBy("first_at", "product_name")
    whole = of_window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        _cells(clicks, slide_us, slide_us, size_us, slice_us)
        .withColumn("end", F.explode(ends))
        .where(floor_to(F.col("end"), slice_us) == F.col("slice"))
        .groupBy("product_id", "slice", "end", "product_name")
        .agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"))
        .withColumn("clicks", F.sum("n").over(whole))
        .withColumn("nth_name", F.row_number().over(of_window))
        .where(F.col("nth_name") == 1)
        .select(
            "product_id",
            F.coalesce("product_name", F.lit("")).alias("product_name"),
            F.timestamp_micros(F.col("end") - size_us).alias("window_start"),
            F.timestamp_micros("end").alias("window_end"),
            "clicks",
            (F.col("clicks") / F.lit(float(minutes))).alias("rate"),
        )
    )


def demand_metrics(
    clicks: DataFrame,
    *,
    short: tuple[str, str] = ("5 minutes", "1 minute"),
    long: tuple[str, str] = ("1 hour", "5 minutes"),
    tolerance: str = "150 seconds",
    availability_delay: str = "0 seconds",
    slice_width: str = DEFAULT_SLICE,
) -> DataFrame:
    """Short-window rate paired with each long-window rate ending within the tolerance.

    Both kinds of window end on the short grid, so a cell knows all the windows it counts in
    and all the pairs those windows form. It contributes one row per pair and one per long
    window, both keyed by the long end; after counting, the pairs of a long end lie next to
    its count, and the join is a window function over rows already in place.
    """
    short_size, short_slide = map(micros, short)
    long_size, long_slide = map(micros, long)
    reach, slice_us = micros(tolerance), micros(slice_width)
    if long_slide % short_slide or short_size % short_slide or long_size % short_slide:
        raise ValueError("sizes and the long slide must be multiples of the short slide")

    cell, end = F.col("cell"), F.col("end")

    def pairs_of(short_end: Column) -> Column:
        near = F.sequence(
            floor_to(short_end - reach, long_slide), ceil_to(short_end + reach, long_slide), F.lit(long_slide)
        )
        joined = F.filter(near, lambda long_end: F.abs(long_end - short_end) <= reach)
        return F.transform(joined, lambda long_end: _window_of(long_end, short_end))

    shorts = F.sequence(cell + short_slide, cell + short_size, F.lit(short_slide))
    longs = F.filter(
        F.sequence(floor_to(cell, long_slide), cell + long_size, F.lit(long_slide)),
        lambda long_end: long_end >= cell + short_slide,
    )
    counted_in = F.concat(
        F.flatten(F.transform(shorts, pairs_of)),
        F.transform(longs, lambda long_end: _window_of(long_end, F.lit(None))),
    )
    of_long_end = Window.partitionBy("product_id", "slice", "end")
    of_pair = Window.partitionBy("product_id", "slice", "end", "short_end").orderBy("first_at", "product_name")
    whole_pair = of_pair.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_pair = F.col("short_end").isNotNull()
    # counted per name on fixed-width values, which hash aggregation can hold; a product
    # has one name almost always, so the windows that settle the name see one row per pair
    joined = (
        _cells(clicks, short_slide, short_slide - reach, max(long_size, short_size + reach), slice_us)
        .select("*", F.inline(counted_in))
        .where(floor_to(end, slice_us) == F.col("slice"))
        .groupBy("product_id", "slice", "end", "short_end", "product_name")
        .agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"))
        .withColumn("clicks", F.sum("n").over(whole_pair))
        .withColumn("nth_name", F.row_number().over(of_pair))
        .withColumn("long_clicks", F.sum(F.when(~is_pair, F.col("n"))).over(of_long_end))
        .where(is_pair & (F.col("nth_name") == 1) & F.col("long_clicks").isNotNull())
    )
    short_end = F.col("short_end")
    return joined.select(
        "product_id",
        F.coalesce("product_name", F.lit("")).alias("product_name"),
        F.timestamp_micros(short_end).alias("short_end"),
        F.timestamp_micros(end).alias("long_end"),
        (F.col("clicks") / F.lit(short_size / micros("1 minute"))).alias("current_demand"),
        (F.col("long_clicks") / F.lit(long_size / micros("1 minute"))).alias("historical_average"),
        F.timestamp_micros(F.greatest(short_end, end) + micros(availability_delay)).alias("ts"),
        short_end.alias("seq"),
    )
