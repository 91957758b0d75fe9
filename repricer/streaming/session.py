"""Session settings the stateful streams need."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Keep keyed state in RocksDB, with changelog checkpoints, as custom state requires."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


@contextmanager
def ends_with_its_data(spark: SparkSession) -> Iterator[None]:
    """A query started inside runs no batch without new data.

    A bounded run over processing-time timers would otherwise wait for them without end;
    they stay in the checkpoint for the next run.
    """
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
