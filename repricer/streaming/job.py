"""The whole engine on streams: messages in, updates handed over, prices, alerts and refused messages out.

Demand and surges run in event time and pricing in processing time, so they are separate queries. They
hand their updates over through folders, which pricing reads like any other source; each query has a
checkpoint of its own, so a restart continues where it was and delivers nothing twice.
"""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repricer.operators.eventlog import as_update, metric_union
from repricer.operators.lookup import Fetch, lookup_competitor
from repricer.operators.surge import surge_adjustments
from repricer.schemas import EVENT_LOG
from repricer.sources.ingest import read_events, read_models
from repricer.streaming.demand import demand_metrics
from repricer.streaming.monitor import Counts, counted
from repricer.streaming.pricing import price_stream
from repricer.streaming.session import ends_with_its_data
from repricer.streaming.sinks import write_messages
from repricer.streaming.surge import surge_runs

KINDS = ("click", "order", "inventory", "rule")


def write_updates(
    updates: DataFrame, path: str, *, checkpoint: str, once: bool = False, name: str | None = None
) -> StreamingQuery:
    """Start appending rows in the shape of the event log, or any others, to a folder."""
    stream = updates.writeStream.queryName(name) if name else updates.writeStream
    writer = stream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    with ends_with_its_data(updates.sparkSession) if once else nullcontext():
        return writer.trigger(availableNow=True).start() if once else writer.start()


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """Updates as they were handed over; of a folder written by a stream, the committed files only."""
    return spark.readStream.schema(EVENT_LOG).parquet(path)


def start(
    spark: SparkSession,
    inputs: Mapping[str, Mapping],
    out: str,
    *,
    fetch: Fetch,
    once: bool = False,
    surge: Mapping | None = None,
    counts: Counts | None = None,
    **pricing,
) -> dict[str, StreamingQuery]:
    """Start every query of the engine; `inputs` has the arguments of `read_events` for each kind of message, and
    under "model" those of `read_models`.

    Below the shared folder `out` come `updates` and `checkpoints` of the queries, `quarantine` with refused messages and
    `delivered` with prices and alerts. `once` works off what there is and ends; the other queries are then
    finished before pricing starts. `counts` is told how many rows each micro-batch read, dropped as late, refused or could not
    price.
    """
    if counts is not None:
        spark.streams.addListener(counts)
    read = {kind: read_events(spark, bounded=False, kind=kind, **inputs[kind]) for kind in KINDS}
    good = {kind: pair[0] for kind, pair in read.items()}
    refused = [bad.select("value", "timestamp", "reason").withColumn("kind", F.lit(kind)) for kind, (_, bad) in read.items()]
    models, bad_models = read_models(spark, bounded=False, **inputs["model"])
    if inputs["model"].get("fmt", "registry") != "registry":
        refused.append(bad_models.withColumn("kind", F.lit("model")))
    handed = {
        "demand": as_update(demand_metrics(good["click"]), "DEMAND"),
        "surge": as_update(surge_adjustments(surge_runs(good["order"], **(surge or {}))), "EMERGENCY"),
        "lookup": as_update(lookup_competitor(good["click"], fetch), "LOOKUP"),
    }
    queries = {
        name: write_updates(rows, f"{out}/updates/{name}", checkpoint=f"{out}/checkpoints/{name}", once=once, name=name)
        for name, rows in handed.items()
    }
    queries["quarantine"] = write_updates(
        counted(metric_union(*refused), "refused", refused="true"),
        f"{out}/quarantine",
        checkpoint=f"{out}/checkpoints/quarantine",
        once=once,
        name="quarantine",
    )
    if once:
        for query in queries.values():
            query.awaitTermination()
    log = metric_union(
        as_update(good["click"], "CLICK"),
        as_update(good["inventory"], "INVENTORY"),
        as_update(good["rule"], "RULE"),
        *[read_updates(spark, f"{out}/updates/{name}") for name in handed],
    )
    priced = counted(price_stream(log, models, **pricing), "priced", conflicts="is_conflict", alerts="is_alert")
    queries["pricing"] = write_messages(
        priced, path=f"{out}/delivered", checkpoint=f"{out}/checkpoints/pricing", once=once, name="pricing"
    )
    return queries
