"""Competitor prices looked up per click, from a service or from a table."""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from threading import Condition, Thread

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repricer.functions.money import AMOUNT, money

# product id -> (HTTP status, body); may raise
Fetch = Callable[[str], tuple[int, str | None]]


def parse_competitor_response(responses: DataFrame) -> DataFrame:
    """Add `price` and `is_error` to rows holding `status` and `body`.

    404 or an absent body is a known zero. Any other status outside 200-299, a missing
    status (the call failed or timed out) or an unusable body is an error, priced zero too.
    A price that is present but not a number counts as zero, true and false as 1 and 0.
    """
    text = F.get_json_object("body", "$.price")
    number = (
        F.when(F.lower(text) == "true", F.lit(1.0))
        .when(F.lower(text) == "false", F.lit(0.0))
        .otherwise(F.coalesce(text.try_cast("double"), F.lit(0.0)))
    )
    read = F.when(text.isNotNull(), number.try_cast(AMOUNT))
    absent = F.coalesce(
        (F.col("status") == 404) | (F.col("status").between(200, 299) & F.col("body").isNull()), F.lit(False)
    )
    value = F.when(absent, F.lit(0).cast(AMOUNT)).when(F.col("status").between(200, 299), read)
    return responses.withColumn("price", money(F.coalesce(value, F.lit(0).cast(AMOUNT)))).withColumn(
        "is_error", value.isNull()
    )


class _Places:
    """Room for the calls of one lookup in a worker process; a call keeps its place until it has really ended."""

    def __init__(self, capacity: int):
        self.capacity, self.alive = capacity, 0
        self.changed = Condition()
        #: All places were found held by late calls, and none has ended since.
        self.is_hung = False


#: By lookup: late calls outlive their batch and task, so their places do too.
_places: dict[str, _Places] = {}


def _fetch_all(ids: list[str], fetch: Fetch, timeout: float, places: _Places) -> dict:
    """Fetch each id once, with no more calls alive than there are places; a failed or late call gives no status.

    The time of a call runs from its start. A late one is given up but keeps its place. When late calls hold all
    places, the ids that wait get `timeout` for one to end; after that they are answered without a call, and so are all
    others, at once, until a call ends.
    """
    waiting, answers = deque(ids), {}
    running: dict[str, float] = {}
    done: dict[str, tuple[int | None, str | None]] = {}
    patience = None

    def call(product: str) -> None:
        try:
            answer = fetch(product)
        except Exception:  # a refused or broken answer is an error row, never a failed task
            answer = (None, None)
        with places.changed:
            done[product] = answer
            places.alive -= 1
            places.is_hung = False
            places.changed.notify_all()

    with places.changed:
        while True:
            now = time.monotonic()
            for product in [p for p, deadline in running.items() if p in done or deadline <= now]:
                answers[product] = done.get(product, (None, None))
                del running[product]
            while waiting and places.alive < places.capacity:
                product, patience = waiting.popleft(), None
                running[product] = now + timeout
                places.alive += 1
                Thread(target=call, args=(product,), daemon=True).start()
            if not waiting and not running:
                return answers
            until = min(running.values(), default=now)
            if not running:
                patience = now + timeout if patience is None else patience
                if places.is_hung or patience <= now:
                    places.is_hung = True
                    return answers | dict.fromkeys(waiting, (None, None))
                until = patience
            places.changed.wait(max(0.0, until - now))


def _responses(rows: DataFrame, fetch: Fetch, timeout_ms: int, capacity: int) -> DataFrame:
    """Rows with the status and body of their product; one call per product and Arrow batch."""

    lookup = uuid.uuid4().hex

    def call_service(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = _places.setdefault(lookup, _Places(capacity))
        for batch in batches:
            ids = batch["product_id"].dropna().unique().tolist()
            answers = _fetch_all(ids, fetch, timeout_ms / 1000, places)
            pairs = [answers.get(product, (None, None)) for product in batch["product_id"]]
            batch["status"] = pd.array([status for status, _ in pairs], dtype="Int32")
            batch["body"] = [body for _, body in pairs]
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(call_service, f"{fields}, status int, body string")


def _as_updates(answered: DataFrame, on_error: str) -> DataFrame:
    parsed = parse_competitor_response(answered)
    if on_error == "keep_last":
        parsed = parsed.where(~F.col("is_error"))
    elif on_error != "zero":
        raise ValueError(f"unknown on_error: {on_error}")
    return parsed.select("product_id", F.lit("").alias("product_name"), "ts", "seq", "price", "is_error")


def lookup_competitor(
    clicks: DataFrame,
    fetch: Fetch,
    *,
    timeout_ms: int = 2000,
    capacity: int = 50,
    dedupe: bool = True,
    on_error: str = "zero",
    tasks: int | None = None,
) -> DataFrame:
    """One competitor price per click, fetched by an injected callable inside the tasks.

    At most `capacity` calls are alive in a worker process (one per task slot), late ones included; while a service
    hangs so that they are all late, clicks are answered with an error at once.

    With `dedupe` a batch asks for each distinct product once, spread over `tasks`
    partitions, and joins the answers back; a stream asks once per product and Arrow batch.
    """
    wanted = clicks.select("product_id", "ts", "seq")
    if clicks.isStreaming or not dedupe:
        return _as_updates(_responses(wanted, fetch, timeout_ms, capacity), on_error)
    spread = tasks or clicks.sparkSession.sparkContext.defaultParallelism
    products = wanted.select("product_id").where(F.col("product_id").isNotNull()).distinct()
    answers = _responses(products.repartition(spread, "product_id"), fetch, timeout_ms, capacity)
    return _as_updates(wanted.join(answers, "product_id", "left"), on_error)


def lookup_competitor_table(clicks: DataFrame, responses: DataFrame, *, on_error: str = "zero") -> DataFrame:
    """The same from a table of answers; a product not listed is unknown (404).

    Of several answers for a product the newest counts (by `ts` where the table has it), so that a
    click gets one price; equally new ones are settled by status and body.
    """
    order = ["ts", "status", "body"] if "ts" in responses.columns else ["status", "body"]
    newest = responses.groupBy("product_id").agg(F.max(F.struct(*order)).alias("answer"))
    listed = newest.select("product_id", "answer.status", "answer.body", F.lit(True).alias("is_listed"))
    answered = clicks.select("product_id", "ts", "seq").join(listed, "product_id", "left")
    return _as_updates(
        answered.withColumn("status", F.when(F.col("is_listed"), F.col("status")).otherwise(404)), on_error
    )
