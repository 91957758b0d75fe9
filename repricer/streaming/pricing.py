"""Keyed pricing state on the event stream.

Two stateful steps with the scoring between them:

1. Facts. Products are dealt to a fixed number of buckets. A bucket keeps the latest facts of its products, the newest model
   version and the deadlines of inactivity, and emits the facts of every trigger. A hot product is dealt to
   several buckets: its clicks go to one of them each, its updates (few, next to clicks) to all, so every
   bucket knows the same facts. Model versions are rows of a stream and go to every bucket.
2. Scoring and pricing, by the same column expressions as in batch; every trigger is scored once.
3. Previous prices. A bucket knows when nothing has changed since it last emitted a price of the product: the price
   before is then the same one. Only the first trigger of each bucket after a change goes to the product's
   own place, which keeps the price that was emitted; a change of scorer or model leaves it alone.

So the one place of a hot product sees a few rows per change, not per click. Inactivity is a matter of the whole
product, so each task tells all buckets of a hot product of the last click it has read (one mark per Arrow batch).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Collection, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from repricer.functions.intervals import micros
from repricer.functions.money import DEFAULT_CURRENCY, money
from repricer.functions.pricing import DEFAULT_RULES, Rules, price_steps, rule_currency
from repricer.operators.model import Scorer, model_price
from repricer.operators.pricing import alert_condition
from repricer.schemas import RANK, TRIGGERS

BUCKETS = 64

# What one price is computed from: the product's state and the model.
_FACTS = {
    "current_demand": "double",
    "historical_average": "double",
    "inventory_level": "int",
    "competitor_amount": "decimal(18,2)",
    "competitor_currency": "string",
    "min_amount": "decimal(18,2)",
    "min_currency": "string",
    "max_amount": "decimal(18,2)",
    "max_currency": "string",
    "adjustment_factor": "double",
}
_MODEL = {
    "model_id": "string",
    "kind": "string",
    "bias": "decimal(18,4)",
    "w_inventory": "decimal(10,4)",
    "w_demand": "decimal(10,4)",
    "w_competitor": "decimal(10,4)",
    "artifact_uri": "string",
}
# where a trigger stands among those of its product in a micro-batch
_PLACE = {"at_us": "bigint", "rank": "int", "seq": "bigint"}
_PRICED = {
    "product_id": "string",
    "lane": "int",
    **_PLACE,
    "product_name": "string",
    "metric_type": "string",
    "priced_at_ms": "bigint",
    "is_conflict": "boolean",
    **_FACTS,
    **_MODEL,
}
# what a bucket remembers of a product; `fresh` until a price is emitted with the facts as they are
_HELD = {
    "has_demand": "boolean",
    **{name: kind for name, kind in _FACTS.items() if name != "adjustment_factor"},
    "fresh": "boolean",
    "seen_factor": "double",
    "seen_model": "string",
    "seen_run": "string",
    "deadline_ms": "bigint",
    "click_name": "string",
    "shard": "int",
}
_UNKNOWN = dict.fromkeys(_HELD) | {
    "has_demand": False,
    "current_demand": 0.0,
    "historical_average": 0.0,
    "inventory_level": 0,
    "competitor_amount": Decimal("0.00"),
    "competitor_currency": DEFAULT_CURRENCY,
    "fresh": True,
    "shard": 0,
}
#: A mark of the last click that a task has read of a product, for all of its buckets.
_SEEN = "SEEN"
_VERSION = "MODEL"
#: Lane of the rows that meet in the product's own place.
_FIRSTS = 0


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {dtype}" for name, dtype in fields.items())


class _FactKeeper(StatefulProcessor):
    """The facts of the products of one bucket."""

    def __init__(self, ttl_ms: int, gap_ms: int, run: str):
        self._ttl_ms, self._gap_ms, self._run = ttl_ms, gap_ms, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._products = handle.getMapState("products", "product_id string", _ddl(_HELD))
        self._factors = handle.getMapState("factors", "product_id string", "factor double", self._ttl_ms)
        self._due = handle.getMapState("due", "at_ms bigint", "products array<string>")
        self._newest = handle.getValueState("newest", _ddl({"effective_us": "bigint", **_MODEL}))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Each product's state is read once, its rows are applied in order, and what changed is written once."""
        now = timerValues.getCurrentProcessingTimeInMs()
        versions, by_product = [], defaultdict(list)
        # one bucket's share of one micro-batch, bounded by the source's per-trigger limits
        for row in rows:
            if row.metric_type == _VERSION:
                versions.append(row)
            else:
                by_product[row.product_id].append(row)
        models, clicked = self._models(versions), []
        for product, own in by_product.items():
            held, factor = self._known(product)
            before, factor_before = dict(held), factor
            own.sort(key=lambda r: (r.at_us, r.rank, r.seq))
            for row in own:
                if row.factor is not None:
                    factor = row.factor
                held["fresh"] |= _apply(held, row) or row.factor is not None
                if row.metric_type in ("CLICK", _SEEN):
                    held |= {"click_name": row.product_name, "deadline_ms": now + self._gap_ms, "shard": row.shard}
                if row.metric_type == "CLICK" or row.metric_type in TRIGGERS and row.shard == 0:
                    model = _in_force(models, row.at_us)
                    place = (row.at_us, row.rank, row.seq)
                    yield from self._priced(key[0], product, row.product_name, row.metric_type, place, now, held, factor, model)
            if held["deadline_ms"] != before["deadline_ms"]:
                clicked.append(product)
            if held != before:
                self._products.updateValue((product,), tuple(held.values()))
            if factor != factor_before or any(row.factor is not None for row in own):
                self._factors.updateValue((product,), (factor,))
        if clicked:
            self._wake(now + self._gap_ms, clicked)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs()
        if not self._due.containsKey((due,)):
            return
        models = self._models([])
        for product in self._due.getValue((due,))[0]:
            held, factor = self._known(product)
            if held["deadline_ms"] != due:
                continue  # clicked since then
            name = held["click_name"]
            held |= {"click_name": None, "deadline_ms": None, "current_demand": 0.0, "historical_average": 0.0}
            held |= {"fresh": held["fresh"] or held["has_demand"], "has_demand": False}
            if held["shard"] == 0:
                place = (1000 * due, RANK["RESET"], 0)
                yield from self._priced(key[0], product, name, "RESET", place, now, held, factor, models[-1] if models else None)
            self._products.updateValue((product,), tuple(held.values()))
        self._due.removeKey((due,))

    def close(self) -> None:
        pass

    def _known(self, product: str) -> tuple[dict, float]:
        known = self._products.getValue((product,)) if self._products.containsKey((product,)) else None
        factor = self._factors.getValue((product,))[0] if self._factors.containsKey((product,)) else 1.0
        return dict(zip(_HELD, known, strict=True)) if known else dict(_UNKNOWN), factor

    def _models(self, versions: list[Row]) -> list[dict]:
        """The version held and the newer ones that have come, oldest first; the newest is kept."""
        known = self._newest.get() if self._newest.exists() else None
        models = [dict(zip(("effective_us", *_MODEL), known, strict=True))] if known else []
        for row in sorted(versions, key=lambda r: (r.at_us, r.model_id)):
            version = {"effective_us": row.at_us, **{name: row[name] for name in _MODEL}}
            if not models or _age(version) > _age(models[-1]):
                models.append(version)
        if models and len(models) > bool(known):
            self._newest.update(tuple(models[-1].values()))
        if known:
            models[0] = models[0] | {"effective_us": None}  # in force for whatever comes
        return models

    def _wake(self, at_ms: int, products: list[str]) -> None:
        waiting = self._due.getValue((at_ms,))[0] if self._due.containsKey((at_ms,)) else []
        if not waiting:
            self._handle.registerTimer(at_ms)
        self._due.updateValue((at_ms,), ([*waiting, *products],))

    def _priced(self, bucket, product, name, metric_type, place, now, held, factor, model) -> Iterator[Row]:
        """The facts of a trigger; nothing without a model. Notes in `held` what was emitted."""
        if model is None:
            return
        facts = [factor if fact == "adjustment_factor" else held[fact] for fact in _FACTS]
        conflict = not _same_currency(held)
        seen = {"seen_factor": factor, "seen_model": model["model_id"], "seen_run": self._run}
        first = held["fresh"] or any(held[k] != v for k, v in seen.items())
        if not conflict:
            held |= seen | {"fresh": False}
        lane = _FIRSTS if first and not conflict else 1 + bucket
        yield Row(*_PRICED)(product, lane, *place, name, metric_type, now, conflict, *facts, *[model[k] for k in _MODEL])


def _age(model: dict) -> tuple:
    return model["effective_us"], model["model_id"]


def _in_force(models: list[dict], at_us: int) -> dict | None:
    """The newest version at an instant, of those that a micro-batch knows."""
    for model in reversed(models):
        if model["effective_us"] is None or model["effective_us"] <= at_us:
            return model
    return None


def _apply(held: dict, row: Row) -> bool:
    """Takes over the facts that a row brings; whether any differs from what was known."""
    news = {}
    if row.has_demand:
        news |= {"has_demand": True, "current_demand": row.current_demand, "historical_average": row.historical_average}
    if row.quantity is not None:
        news["inventory_level"] = row.quantity
    if row.has_competitor:
        news |= {"competitor_amount": row.competitor_amount, "competitor_currency": row.competitor_currency}
    if row.has_rule:
        news |= {name: row[name] for name in ("min_amount", "min_currency", "max_amount", "max_currency")}
    changed = any(held[name] != value for name, value in news.items())
    held |= news
    return changed


def _same_currency(held: dict) -> bool:
    """A product whose rule and competitor price differ in currency has no price until they agree."""
    low = held["min_currency"] or DEFAULT_CURRENCY
    return low == held["competitor_currency"] and held["max_currency"] in (None, low)


class _PriceKeeper(StatefulProcessor):
    """Gives each price the one before it; keeps the last one of the product."""

    def __init__(self, columns: list[str]):
        self._columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "amount decimal(18,2)")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        made = Row(*self._columns, "has_previous", "previous_price")
        if key[1] != _FIRSTS:  # nothing has changed since the product's last price
            for row in rows:
                yield made(*[row[name] for name in self._columns], not row.is_conflict, None if row.is_conflict else row.new_amount)
            return
        known = self._last.exists()
        before = self._last.get()[0] if known else None
        # few rows: the first of each bucket after each change
        # a reset comes after all other rows of its micro-batch
        for row in sorted(rows, key=lambda r: (r.metric_type == "RESET", r.at_us, r.rank, r.seq)):
            yield made(*[row[name] for name in self._columns], known, before)
            known, before = True, row.new_amount
        self._last.update((before,))

    def close(self) -> None:
        pass


def _flat(log: DataFrame) -> DataFrame:
    return log.where(F.col("product_id").isNotNull() & F.col("ts").isNotNull()).select(
        "product_id",
        "product_name",
        F.unix_micros("ts").alias("at_us"),
        "rank",
        "seq",
        "metric_type",
        F.col("demand").isNotNull().alias("has_demand"),
        F.col("demand.current_demand").alias("current_demand"),
        F.col("demand.historical_average").alias("historical_average"),
        "quantity",
        F.col("competitor").isNotNull().alias("has_competitor"),
        F.col("competitor.amount").alias("competitor_amount"),
        F.col("competitor.currency").alias("competitor_currency"),
        F.col("rule").isNotNull().alias("has_rule"),
        F.col("rule.min_price.amount").alias("min_amount"),
        F.col("rule.min_price.currency").alias("min_currency"),
        F.col("rule.max_price.amount").alias("max_amount"),
        F.col("rule.max_price.currency").alias("max_currency"),
        F.col("emergency.factor").alias("factor"),
    )


def _with_marks(hot: Collection[str] | None):
    """Adds to each Arrow batch a mark of the last click of every hot product in it."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            yield batch
            kind = batch.schema.get_field_index("metric_type")
            clicks = batch.select(["product_id", "at_us", "seq", "metric_type"]).to_pandas().query("metric_type == 'CLICK'")
            if hot is not None:
                clicks = clicks[clicks["product_id"].isin(hot)]
            last = clicks.sort_values(["at_us", "seq"]).drop_duplicates("product_id", keep="last").index
            if len(last):
                marks = batch.take(pa.array(last, pa.int64()))
                yield marks.set_column(kind, batch.schema.field(kind), pa.array([_SEEN] * len(last), batch.schema.field(kind).type))

    return mark


def _dealt(log: DataFrame, models: DataFrame, buckets: int, shards: int, hot: Collection[str] | None) -> DataFrame:
    """Rows of the log and model versions with the bucket each goes to, and the shard of the product."""
    if not 1 <= shards <= buckets:
        raise ValueError("a product is dealt to between one and all buckets")
    rows, home = _flat(log), F.pmod(F.xxhash64("product_id"), F.lit(buckets))
    shard = F.lit(0)
    if shards > 1:
        rows = rows.mapInArrow(_with_marks(None if hot is None else frozenset(hot)), rows.schema)
        one = F.pmod(F.xxhash64("product_id", "at_us", "seq"), F.lit(shards)).cast("int")
        dealt = F.when(F.col("metric_type") == "CLICK", F.array(one)).otherwise(F.sequence(F.lit(0), F.lit(shards - 1)))
        shard = F.explode(dealt if hot is None else F.when(F.col("product_id").isin(*hot), dealt).otherwise(F.array(F.lit(0))))
    placed = rows.withColumn("shard", shard).withColumn("bucket", F.pmod(home + F.col("shard"), F.lit(buckets)).cast("int"))
    versions = models.where(F.col("effective_ts").isNotNull()).select(
        F.unix_micros("effective_ts").alias("at_us"), F.lit(_VERSION).alias("metric_type"), *_MODEL, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    )
    return placed.unionByName(versions, allowMissingColumns=True)


def pricing_facts(
    log: DataFrame,
    models: DataFrame,
    *,
    ttl: str = "10 minutes",
    gap: str = "5 minutes",
    buckets: int = BUCKETS,
    shards: int = 1,
    hot: Collection[str] | None = None,
) -> DataFrame:
    """For each trigger of the event stream the facts and the model that it is priced with.

    With `is_conflict` where the facts differ in currency: such a trigger has no price. `models` is a stream of model
    versions; the newest that has come is in force, and inside a micro-batch none before its time.
    Surge factors expire and inactive products are repriced by processing time.

    `buckets` is the most tasks that can work on it, and belongs to the checkpoint like `shards`, the number of
    buckets of a product: of all products, or of those in `hot`. Updates of a dealt product are copied to each of its buckets.
    """
    keeper = _FactKeeper(micros(ttl) // 1000, micros(gap) // 1000, uuid.uuid4().hex)
    dealt = _dealt(log, models, buckets, shards, hot)
    return dealt.groupBy("bucket").transformWithState(keeper, _ddl(_PRICED), "append", "processingTime")


def price_stream(
    log: DataFrame,
    models: DataFrame,
    *,
    scorer: str | Scorer = "linear",
    rules: Rules = DEFAULT_RULES,
    **dealing,
) -> DataFrame:
    """The price stream with `previous_price` and `is_alert`; `ts` is the time of pricing.

    Triggers whose amounts differ in currency come with `is_conflict` and without a price. `event_id` is that of the
    trigger (product, kind and place in the log; of a reset its instant), and so the same however often it is priced. The
    other options are those of `pricing_facts`.
    """
    facts = pricing_facts(log, models, **dealing)
    ctx = F.struct(
        "product_id",
        *["current_demand", "historical_average", "inventory_level", "adjustment_factor"],
        money(F.col("competitor_amount"), F.col("competitor_currency")).alias("competitor_price"),
        F.struct(
            money(F.col("min_amount"), F.col("min_currency")).alias("min_price"),
            money(F.col("max_amount"), F.col("max_currency")).alias("max_price"),
        ).alias("price_rule"),
    )
    carried = ["product_id", "lane", *_PLACE, "product_name", "metric_type", "priced_at_ms", "is_conflict"]
    shown = ["inventory_level", "current_demand", "competitor_currency", "min_currency", "max_currency"]
    predicted = model_price(ctx, F.struct(*_MODEL), scorer)
    scored = facts.select(*carried, *shown, ctx.alias("ctx"), predicted.alias("prediction"))
    amount = price_steps(F.col("ctx"), F.col("prediction"), rules)["new_price"]
    priced = scored.select(
        *carried,
        *shown,
        "prediction",
        F.when(~F.col("is_conflict"), amount).cast("decimal(18,2)").alias("new_amount"),
        rule_currency(F.col("ctx")).alias("currency"),
    )
    kept = [name for name in priced.columns if name != "lane"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in priced.select(kept).schema)
    emitted = priced.groupBy("product_id", "lane").transformWithState(
        _PriceKeeper(kept), f"{fields}, has_previous boolean, previous_price decimal(18,2)", "append", "none"
    )
    return emitted.select(
        "product_id",
        "product_name",
        F.when(~F.col("is_conflict"), money(F.col("new_amount"), F.col("currency"))).alias("new_price"),
        money(F.col("prediction"), F.col("currency")).alias("model_prediction"),
        F.timestamp_millis("priced_at_ms").alias("ts"),
        "inventory_level",
        "current_demand",
        "metric_type",
        "previous_price",
        F.coalesce(
            alert_condition(F.col("new_amount"), F.col("previous_price"), F.col("metric_type"), rules) & ~F.col("is_conflict"),
            F.lit(False),
        ).alias("is_alert"),
        "is_conflict",
        F.struct(
            F.col("min_currency").alias("min"), F.col("max_currency").alias("max"), F.col("competitor_currency").alias("competitor")
        ).alias("currencies"),
        F.md5(F.to_json(F.struct("product_id", "metric_type", *_PLACE))).alias("event_id"),
    )
