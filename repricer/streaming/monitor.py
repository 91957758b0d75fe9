"""Counts per micro-batch: rows read, late rows dropped, messages refused, triggers without a price, alerts.

Late rows are dropped inside Spark's operators, which report their number (a task's late clicks of one product and cell have been added up
by then and count as one); the others are counted on the way by
`counted`. A `Counts` listener takes both from the progress of every query and gives them as a table.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

COUNTS = (
    "query string, run_id string, batch_id bigint, at timestamp, rows_read bigint, dropped_late bigint, "
    "refused bigint, conflicts bigint, alerts bigint"
)
_COUNTED = ("refused", "conflicts", "alerts")


def counted(rows: DataFrame, name: str, **conditions: str | Column) -> DataFrame:
    """The same rows; those that fulfil a condition are counted under its name (refused, conflicts or alerts)."""
    if unknown := set(conditions) - set(_COUNTED):
        raise ValueError(f"unknown counts: {sorted(unknown)}")
    tests = {key: F.expr(test) if isinstance(test, str) else test for key, test in conditions.items()}
    return rows.observe(name, *[F.count(F.when(test, 1)).alias(key) for key, test in tests.items()])


class Counts(StreamingQueryListener):
    """Collects a row per query and micro-batch; add it with `spark.streams.addListener`."""

    def __init__(self):
        self._rows, self._lock = [], threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        observed = dict.fromkeys(_COUNTED, 0)
        for row in (progress.observedMetrics or {}).values():
            for key, value in row.asDict().items():
                if key in observed:
                    observed[key] += value
        own = (progress.name, str(progress.runId), progress.batchId, progress.timestamp, progress.numInputRows, late, *observed.values())
        with self._lock:
            self._rows.append(own)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """What has been counted so far, a row per query and micro-batch."""
        with self._lock:
            rows = list(self._rows)
        text = COUNTS.replace("at timestamp", "at string")
        return spark.createDataFrame(rows, text).withColumn("at", F.col("at").cast("timestamp"))

    def write(self, spark: SparkSession, path: str) -> None:
        """Appends what has been counted since the last call to a table."""
        with self._lock:
            rows, self._rows = self._rows, []
        text = COUNTS.replace("at timestamp", "at string")
        if rows:
            spark.createDataFrame(rows, text).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
