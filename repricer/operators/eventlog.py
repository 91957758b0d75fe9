"""The event log: every input tagged, given one shape and united."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repricer.schemas import PAYLOADS, RANK, TRIGGERS


def _payload(kind: str) -> tuple[str, Column]:
    c = F.col
    return {
        "DEMAND": lambda: (
            "demand",
            F.struct(c("current_demand"), c("historical_average")),
        ),
        "RESET": lambda: (
            "demand",
            F.struct(F.lit(0.0).alias("current_demand"), F.lit(0.0).alias("historical_average")),
        ),
        "INVENTORY": lambda: ("quantity", c("quantity")),
        "COMPETITOR": lambda: ("competitor", c("price")),
        "LOOKUP": lambda: ("competitor", c("price")),
        "RULE": lambda: ("rule", F.struct(c("min_price"), c("max_price"))),
        "EMERGENCY": lambda: (
            "emergency",
            F.struct(c("adjustment_factor").alias("factor"), c("ts").alias("written_at")),
        ),
    }[kind]()


def tag(df: DataFrame, kind: Column, rank: Column, payloads: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of an input that carries several kinds already, in the shape of the log and with further columns to keep, in one pass."""
    seq = F.col("seq") if "seq" in df.columns else F.unix_micros("ts")
    return df.select(
        "product_id",
        "ts",
        rank.cast("int").alias("rank"),
        seq.cast("bigint").alias("seq"),
        kind.alias("metric_type"),
        "product_name",
        *[payloads.get(name, F.lit(None)).cast(dtype).alias(name) for name, dtype in PAYLOADS.items()],
        *keep,
    )


def as_update(df: DataFrame, kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """Tag the rows of one input and move their values to the payload column of its kind.

    LOOKUP is a competitor price fetched for a click: the same update as COMPETITOR,
    ordered after the click that asked for it.
    """
    payloads = {} if kind in ("CLICK", "SALE") else dict([_payload(kind)])
    metric_type = F.lit("COMPETITOR" if kind == "LOOKUP" else kind)
    return tag(df, metric_type, F.lit(RANK[kind]), payloads, keep)


def metric_union(*updates: DataFrame) -> DataFrame:
    """All updates as one stream, duplicates kept."""
    return reduce(DataFrame.unionByName, updates)


def event_log(clicks: DataFrame, updates: DataFrame) -> DataFrame:
    """Clicks and updates as one stream."""
    return as_update(clicks, "CLICK").unionByName(updates)


def triggers(log: DataFrame) -> DataFrame:
    """Rows that lead to a price; DEMAND and COMPETITOR only change state."""
    return log.where(F.col("metric_type").isin(*TRIGGERS))
