"""Delivering prices and alerts.

They travel as (topic, key, value) messages of one stream, so a price and its alert are
written together and the stateful query runs once. Each message has a `message_id`, made of its topic and of the event
that it answers, and so the same whenever it is sent again. Files are written exactly once. The Kafka writer is
at-least-once: a message can repeat after a failure, with its id among the headers. `write_batches` writes a folder per
micro-batch, which a repeated micro-batch replaces. `deduplicated` drops what comes twice on the receiving side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repricer.operators.pricing import alert_value, result_value
from repricer.streaming.session import ends_with_its_data

PRICES, ALERTS, CONFLICTS = "prices", "alerts", "conflicts"


def messages(
    priced: DataFrame, *, prices: str = PRICES, alerts: str = ALERTS, conflicts: str = CONFLICTS
) -> DataFrame:
    """Every price as a message for one topic, and again for the alert topic when it jumped.

    A trigger without a price, as its amounts differ in currency, is a message for a topic of its own.
    """

    def message(topic: str, key: Column, value: Column) -> Column:
        return _message(topic, key, value)

    price = message(prices, F.col("product_id"), result_value())
    alert = message(alerts, alert_value(), alert_value())
    differing = F.to_json(F.struct("metric_type", F.unix_millis("ts").alias("timestamp"), "currencies"))
    refused = message(conflicts, F.col("product_id"), differing)
    both = (
        F.when(F.col("is_conflict"), F.array(refused))
        .when(F.col("is_alert"), F.array(price, alert))
        .otherwise(F.array(price))
    )
    return priced.select(F.inline(both))


def _message(topic: str, key: Column, value: Column) -> Column:
    message_id = F.concat(F.lit(f"{topic}:"), F.col("event_id"))
    return F.struct(F.lit(topic).alias("topic"), key.alias("key"), value.alias("value"), message_id.alias("message_id"))


def with_headers(out: DataFrame) -> DataFrame:
    """Messages as the Kafka writer takes them, the id as a header."""
    header = F.struct(F.lit("message_id").alias("key"), F.col("message_id").cast("binary").alias("value"))
    return out.select("topic", "key", "value", F.array(header).alias("headers"))


def received(records: DataFrame) -> DataFrame:
    """Kafka records, read with `includeHeaders`, as messages with their id and the broker's time `sent_at`."""
    ids = F.filter("headers", lambda header: header["key"] == "message_id")
    texts = [F.col(name).cast("string").alias(name) for name in ("topic", "key", "value")]
    return records.select(*texts, F.get(ids, 0)["value"].cast("string").alias("message_id"), F.col("timestamp").alias("sent_at"))


def deduplicated(messages: DataFrame, *, within: str = "1 hour", time: str = "sent_at") -> DataFrame:
    """Each message once: repeats up to `within` after the first are dropped, and no id is kept longer."""
    if not messages.isStreaming:
        return messages.dropDuplicates(["message_id"])
    return messages.withWatermark(time, within).dropDuplicatesWithinWatermark(["message_id"])


def write_batches(
    priced: DataFrame, path: str, *, checkpoint: str, prices: str = PRICES, alerts: str = ALERTS, once: bool = False
) -> StreamingQuery:
    """Start delivering to a folder per micro-batch and topic, for readers that take whole batches.

    A micro-batch that runs again after a failure replaces what it wrote before.
    """
    out = messages(priced, prices=prices, alerts=alerts)
    writer = out.writeStream.foreachBatch(batch_writer(path)).option("checkpointLocation", checkpoint)
    if not once:
        return writer.start()
    with ends_with_its_data(out.sparkSession):
        return writer.trigger(availableNow=True).start()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch to a folder of its own, in place of what is there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("topic").parquet(f"{path}/batch={batch_id}")

    return write


def _write(out: DataFrame, sink: str, checkpoint: str, path: str | None, brokers: str | None, once: bool, name: str | None = None) -> StreamingQuery:
    writer = (with_headers(out) if sink == "kafka" else out).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if sink == "kafka":
        writer = writer.format("kafka").option("kafka.bootstrap.servers", brokers)
    else:
        writer = writer.format(sink).partitionBy("topic").option("path", path)
    writer = writer.queryName(name) if name else writer
    if not once:
        return writer.start()
    with ends_with_its_data(out.sparkSession):
        return writer.trigger(availableNow=True).start()


def write_messages(
    priced: DataFrame,
    *,
    checkpoint: str,
    sink: str = "parquet",
    path: str | None = None,
    brokers: str | None = None,
    prices: str = PRICES,
    alerts: str = ALERTS,
    once: bool = False,
    name: str | None = None,
) -> StreamingQuery:
    """Start delivering prices and alerts to Kafka topics or to a folder per topic.

    `once` delivers what there is now and ends.
    """
    return _write(messages(priced, prices=prices, alerts=alerts), sink, checkpoint, path, brokers, once, name)


def write_prices(priced: DataFrame, *, topic: str = PRICES, **target) -> StreamingQuery:
    """Start delivering only the price stream."""
    out = priced.where("NOT is_conflict").select(_message(topic, F.col("product_id"), result_value()).alias("m")).select("m.*")
    return _write(out, **_target(target))


def write_alerts(priced: DataFrame, *, topic: str = ALERTS, **target) -> StreamingQuery:
    """Start delivering only the alerts."""
    out = priced.where("is_alert").select(_message(topic, alert_value(), alert_value()).alias("m")).select("m.*")
    return _write(out, **_target(target))


def _target(given: dict) -> dict:
    return {"sink": "parquet", "path": None, "brokers": None, "once": False} | given
