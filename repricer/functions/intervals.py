"""Durations given as text ("5 minutes") and the epoch-aligned grids built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MICROS = {
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def micros(duration: str) -> int:
    """Length of a duration such as "150 seconds" in microseconds."""
    number, unit = duration.split()
    return int(number) * _MICROS[unit.rstrip("s")]


def floor_to(value: Column, width: int) -> Column:
    """Largest multiple of `width` not above an epoch-microsecond value."""
    return value - F.pmod(value, F.lit(width))


def ceil_to(value: Column, width: int) -> Column:
    """Smallest multiple of `width` not below an epoch-microsecond value."""
    return value + F.pmod(-value, F.lit(width))


def slice_start(ts: Column, width: int) -> Column:
    """Start, in epoch microseconds, of the time slice that holds `ts`."""
    return floor_to(F.unix_micros(ts), width)


#: Slice widths to choose from.
WIDTHS = ("1 minute", "5 minutes", "15 minutes", "1 hour", "6 hours", "1 day", "7 days", "30 days")


def slice_width_for(rows: DataFrame, *, most: int = 50_000) -> str:
    """The widest slice that holds about `most` rows of any product, by each product's rows over the time that they span.

    Takes one job over `product_id` and `ts` that adds up in the map tasks and gives one row. Products with no more than `most` rows
    fit whatever the width. Wide slices mean few summary rows; no result depends on them.
    """
    at = F.unix_micros("ts")
    spans = rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), (F.max(at) - F.min(at)).alias("span"))
    least = spans.where(F.col("n") > most).agg(F.min(F.col("span") * (most / F.col("n"))).alias("width")).first()["width"]
    if least is None:
        return WIDTHS[-1]
    return max((w for w in WIDTHS if micros(w) <= least), key=micros, default=WIDTHS[0])
