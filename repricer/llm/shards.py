"""Contiguous shards of near equal byte size, by global prefix sums.

Documents are range-partitioned by doc_id, so each partition is one run of the global order.
Partition totals give each partition its offset, sums inside the partition do the rest, and a
document belongs to the shard in which the middle of its bytes falls. A shard's size therefore
differs from its target by half a document at each end at most.

Null texts have size 1 like empty ones. Null doc_ids come first. Rows with equal doc_id are
ordered by checksum and size; fully equal rows may swap. Equal texts are not kept together: a
group of copies may be larger than a shard, and equal bytes is the law kept. An empty table
gives no rows. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repricer.llm.common import text_of, written

SHARDS = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Columns doc_id, size, text_crc32, shard and slot, in contiguous doc_id ranges of equal bytes."""
    text = text_of("text")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # the partition number is written down: whatever is computed again later, the runs stay as they are
    runs = written(
        sized.repartitionByRange(partitions, "doc_id", "text_crc32", "size").withColumn(
            "run", F.spark_partition_id()
        ),
        "runs",
    )
    # one row per partition
    totals = runs.groupBy("run").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "run",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("run").orderBy("doc_id", "text_crc32", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    middle = F.col("bytes_before") + F.sum("size").over(inside) - F.col("size") / 2
    placed = runs.join(offsets, "run").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place"),
        F.least(F.floor(middle * shards / F.col("total")), F.lit(shards - 1)).cast("int").alias("shard"),
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(first), "shard").select(  # at most one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot")
    )
