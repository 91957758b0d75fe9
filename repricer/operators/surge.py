"""Order surges: runs of n adjacent orders of one product inside a time limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repricer.functions.intervals import micros, slice_start


def surge_runs(
    orders: DataFrame,
    *,
    n: int = 10,
    within: str = "1 minute",
    slice_width: str = "1 hour",
) -> DataFrame:
    """One row per run of `n` consecutive orders spanning strictly less than `within`.

    Runs may overlap: k orders close together give k - n + 1 rows, each at its last order.
    The product is cut into time slices, so a product with most of the orders is spread over
    many tasks. Inside a slice a run's first order is found where it is; the first n - 1
    orders of a slice find it among the last n - 1 of the slices before, and only these edge
    rows are ordered across the whole product. The width of a slice does not depend on `within`.
    """
    within_us = micros(within)
    in_slice = Window.partitionBy("product_id", "slice").orderBy("ts", "seq")
    whole = Window.partitionBy("product_id").orderBy("ts", "seq")

    def first_of_run(rows: DataFrame, window) -> DataFrame:
        return rows.withColumn("first_ts", F.lag("ts", n - 1).over(window)).withColumn(
            "first_name", F.lag("product_name", n - 1).over(window)
        )

    sliced = (
        orders.select("product_id", "product_name", "ts", "seq")
        .withColumn("slice", slice_start(F.col("ts"), micros(slice_width)))
        .repartition("product_id", "slice")
    )
    placed = sliced.withColumn("nth", F.row_number().over(in_slice))
    inner = first_of_run(placed, in_slice).where(F.col("nth") >= n)
    early = F.col("nth") < n
    edges = (
        placed.withColumn("is_late", F.lead("ts", n - 1).over(in_slice).isNull())
        .where(early | F.col("is_late"))
        .drop("is_late")
    )
    return (
        inner.unionByName(first_of_run(edges, whole).where(early))
        .where(F.unix_micros("ts") - F.unix_micros("first_ts") < within_us)
        .select("product_id", F.col("first_name").alias("product_name"), "first_ts", "ts", "seq")
    )


def surge_adjustments(runs: DataFrame, *, factor: float = 1.2) -> DataFrame:
    """The price adjustment raised by each run, named after the run's first order."""
    return runs.select(
        "product_id", "product_name", F.lit(factor).alias("adjustment_factor"), "ts", "seq"
    )
