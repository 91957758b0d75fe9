"""Reading the message streams and binding their JSON to fixed columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repricer.functions.money import MONEY
from repricer.schemas import MODEL
from repricer.sources import lines

RAW = "value string, timestamp timestamp"

#: Milliseconds that fit a timestamp.
_MOST_MILLIS = 9_223_372_036_854_775
# JSON paths of a message kind's objects with the fields each may hold
_FIELDS = {
    "click": {"$": ("productId", "productName", "timestamp")},
    "order": {"$": ("orderId", "productId", "productName", "quantity", "timestamp")},
    "inventory": {"$": ("productId", "productName", "quantity")},
    "rule": {
        "$": ("productId", "productName", "priceRule"),
        "$.priceRule": ("minPrice", "maxPrice"),
        "$.priceRule.minPrice": ("amount", "currency"),
        "$.priceRule.maxPrice": ("amount", "currency"),
    },
}
_MONEY_TEXT = "struct<amount: string, currency: string>"
# numbers are read as text first, so a quoted number binds like a bare one
_TEXT = {
    "click": "productId string, productName string, timestamp string",
    "order": "orderId string, productId string, productName string, quantity string, timestamp string",
    "inventory": "productId string, productName string, quantity string",
    "rule": "productId string, productName string, "
    f"priceRule struct<minPrice: {_MONEY_TEXT}, maxPrice: {_MONEY_TEXT}>",
}
_NUMBERS = {
    "click": ("timestamp",),
    "order": ("quantity", "timestamp"),
    "inventory": ("quantity",),
    "rule": ("priceRule.minPrice.amount", "priceRule.maxPrice.amount"),
}


def kafka_options(
    topic: str,
    *,
    brokers: str,
    bounded: bool,
    options: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of the Kafka source: a bounded read covers everything there is now, an
    unbounded one starts at the latest offset unless its checkpoint knows better."""
    chosen = {"kafka.bootstrap.servers": brokers, "subscribe": topic}
    if bounded:
        chosen |= {"startingOffsets": "earliest", "endingOffsets": "latest"}
    else:
        chosen |= {"startingOffsets": "latest"}
    return chosen | dict(options or {})


def read_raw(
    spark: SparkSession,
    path_or_topic: str,
    *,
    fmt: str = "parquet",
    bounded: bool = True,
    brokers: str = "",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Messages as (value, timestamp, seq), the timestamp and the position being the transport's own.

    `parquet` holds the first two columns, `text` and `lines` one message per line stamped with the file's
    modification time, `kafka` a topic. `seq` orders messages of one instant: by offset and
    partition of a topic (products are its keys, so a product's messages lie in one partition),
    by file and row of a parquet file, by file and place of a line. `lines` splits large files and numbers them by
    arrival; of a stream it needs the option `log` (see `repricer.sources.lines`). Without it, text files of a stream are read
    whole as `text`, so one of them has to fit a task; a table of `text` is read as `lines`.
    """
    reader = spark.read if bounded else spark.readStream
    if fmt == "kafka":
        chosen = kafka_options(path_or_topic, brokers=brokers, bounded=bounded, options=options)
        loaded = reader.format("kafka").options(**chosen).load()
        position = F.shiftleft(F.col("offset"), 16) + F.col("partition")
        return loaded.select(F.col("value").cast("string").alias("value"), "timestamp", position.alias("seq"))
    reader = reader.options(**dict(options or {}))
    if fmt == "lines" or fmt == "text" and bounded:
        lines.register(spark)
        return reader.format("lines").load(path_or_topic)
    if fmt == "text":
        # a stream has no row numbers of its own, so a file is taken as one and its lines are numbered
        file = F.pmod(F.xxhash64("_metadata.file_path"), F.lit(1 << 23))
        stamped = reader.text(path_or_topic, wholetext=True).select(
            F.regexp_replace("value", r"\r?\n\z", "").alias("lines"),
            F.col("_metadata.file_modification_time").alias("timestamp"),
            F.shiftleft(file, 40).alias("place"),
        )
        numbered = stamped.select("*", F.posexplode(F.split("lines", r"\r?\n", -1)).alias("line", "value"))
        return numbered.select("value", "timestamp", (F.col("place") + F.col("line")).alias("seq"))
    if fmt == "parquet":
        file = F.pmod(F.xxhash64("_metadata.file_path"), F.lit(1 << 23))
        position = F.shiftleft(file, 40) + F.col("_metadata.row_index")
        return reader.schema(RAW).parquet(path_or_topic).select("*", position.alias("seq"))
    raise ValueError(f"unknown format: {fmt}")


def _unknown_fields(kind: str) -> Column:
    checks = []
    for path, fields in _FIELDS[kind].items():
        text = F.col("value") if path == "$" else F.get_json_object("value", path)
        extra = F.array_except(F.json_object_keys(text), F.array(*[F.lit(f) for f in fields]))
        checks.append(F.coalesce(F.size(extra) > 0, F.lit(False)))
    found = checks[0]
    for check in checks[1:]:
        found = found | check
    return found


def _whole(text: Column) -> Column:
    """The integral part of a number given as text, fractions cut off; NULL for what is no number."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)(?:\.\d*)?\s*$", 1)
    scientific = text.try_cast("decimal(38,18)")
    cut = F.when(scientific < 0, F.ceil(scientific)).otherwise(F.floor(scientific))
    return F.when(digits != "", digits.try_cast("decimal(38,0)")).otherwise(cut.cast("decimal(38,0)"))


def _value(name: str) -> Column:
    """A number field in its own type, rounded once; NULL where it is absent, no number or out of range."""
    text = F.col(f"_message.{name}")
    if name.endswith("amount"):
        return text.try_cast("decimal(18,2)")
    if name == "timestamp":
        whole = _whole(text)
        return F.when(F.abs(whole) <= _MOST_MILLIS, whole.cast("bigint"))
    return _whole(text).try_cast("int")


def _wrong_numbers(kind: str) -> Column:
    bad = F.lit(False)
    for name in _NUMBERS[kind]:
        bad = bad | (F.col(f"_message.{name}").isNotNull() & _value(name).isNull())
    return bad


def _one_sided_rule() -> Column:
    bounds = [F.col(f"_message.priceRule.{side}.amount").isNull() for side in ("minPrice", "maxPrice")]
    return F.col("_message.priceRule").isNotNull() & (bounds[0] != bounds[1])


def classify_json(raw: DataFrame, kind: str) -> DataFrame:
    """Add the parsed `_message` and the `reason` a message cannot be bound (NULL when it can)."""
    shape = f"{_TEXT[kind]}, _corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = raw.withColumn("_message", F.from_json("value", shape, options))
    reason = (
        F.when(
            F.col("_message").isNull()
            | F.col("_message._corrupt").isNotNull()
            | F.json_object_keys("value").isNull(),
            "malformed",
        )
        .when(_unknown_fields(kind), "unknown_field")
        .when(_wrong_numbers(kind), "wrong_type")
    )
    if kind == "rule":
        reason = reason.when(_one_sided_rule(), "one_sided_rule")
    # no state can be kept for it
    reason = reason.when(F.col("_message.productId").isNull(), "no_product")
    return parsed.withColumn("reason", reason)


def _number(name: str) -> Column:
    """A number field; absent or null gives zero."""
    return F.coalesce(_value(name), F.lit(0))


def _bound(side: str) -> Column:
    field = F.col(f"_message.priceRule.{side}")
    return F.when(
        field["amount"].isNotNull(),
        F.struct(_value(f"priceRule.{side}.amount").alias("amount"), field["currency"]),
    ).cast(MONEY)


def bind(classified: DataFrame, kind: str) -> DataFrame:
    """Typed columns of the messages that can be bound, with `seq` where the transport gives one.

    Clicks live on the time in the message, all other kinds on the transport's.
    """
    good = classified.where(F.col("reason").isNull())
    product = [
        F.col("_message.productId").alias("product_id"),
        F.col("_message.productName").alias("product_name"),
    ]
    place = ["seq"] if "seq" in classified.columns else []
    quantity = _number("quantity").alias("quantity") if kind in ("order", "inventory") else None
    sent = F.timestamp_millis(_number("timestamp")) if kind in ("click", "order") else None
    if kind == "click":
        return good.select(*product, sent.alias("ts"), *place)
    transport = F.col("timestamp").alias("ts")
    if kind == "order":
        order_id = F.col("_message.orderId").alias("order_id")
        return good.select(order_id, *product, quantity, sent.alias("order_ts"), transport, *place)
    if kind == "inventory":
        return good.select(*product, quantity, transport, *place)
    return good.select(
        *product, _bound("minPrice").alias("min_price"), _bound("maxPrice").alias("max_price"), transport, *place
    )


def decode_json(raw: DataFrame, kind: str, *, on_error: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Bound messages and the quarantine (value, timestamp, reason), which the caller has to deliver.

    With `on_error="fail"` reading the first of the two stops at the first bad message.
    """
    classified = classify_json(raw, kind)
    bad = classified.where(F.col("reason").isNotNull()).select("value", "timestamp", "reason")
    if on_error == "fail":
        message = F.concat(F.lit("cannot bind message: "), F.col("reason"))
        classified = classified.withColumn(
            "reason", F.when(F.col("reason").isNotNull(), F.raise_error(message)).cast("string")
        )
    elif on_error != "quarantine":
        raise ValueError(f"unknown on_error: {on_error}")
    return bind(classified, kind), bad


def read_events(
    spark: SparkSession, kind: str, path_or_topic: str, *, on_error: str = "quarantine", **source
) -> tuple[DataFrame, DataFrame]:
    """One of the four message streams (click, order, inventory or rule) and its quarantine."""
    return decode_json(read_raw(spark, path_or_topic, **source), kind, on_error=on_error)


_MODEL_TEXT = {
    "modelId": ("model_id", "string"),
    "effectiveTime": ("effective_ts", None),
    "kind": ("kind", "string"),
    "bias": ("bias", "decimal(18,4)"),
    "wInventory": ("w_inventory", "decimal(10,4)"),
    "wDemand": ("w_demand", "decimal(10,4)"),
    "wCompetitor": ("w_competitor", "decimal(10,4)"),
    "artifactUri": ("artifact_uri", "string"),
}


def decode_models(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model versions sent as JSON, and the quarantine (value, timestamp, reason) of those that cannot be bound.

    A version without an `effectiveTime` (in milliseconds) is in force from the transport's time on.
    """
    shape = ", ".join(f"{name} string" for name in _MODEL_TEXT) + ", _corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = raw.withColumn("_message", F.from_json("value", shape, options))
    sent = F.col("_message.effectiveTime")
    whole = _whole(sent)
    millis = F.when(F.abs(whole) <= _MOST_MILLIS, whole.cast("bigint"))
    bound = {
        column: F.col(f"_message.{name}").try_cast(kind) if kind else F.coalesce(F.timestamp_millis(millis), F.when(sent.isNull(), F.col("timestamp")))
        for name, (column, kind) in _MODEL_TEXT.items()
    }
    wrong = F.lit(False)
    for name, (column, _) in _MODEL_TEXT.items():
        wrong = wrong | (F.col(f"_message.{name}").isNotNull() & bound[column].isNull())
    extra = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(name) for name in _MODEL_TEXT]))
    reason = (
        F.when(F.col("_message").isNull() | F.col("_message._corrupt").isNotNull() | F.json_object_keys("value").isNull(), "malformed")
        .when(F.size(extra) > 0, "unknown_field")
        .when(wrong, "wrong_type")
        .when(F.col("_message.modelId").isNull(), "no_model")
    )
    classified = parsed.withColumn("reason", reason)
    good = classified.where(F.col("reason").isNull()).select(*[value.alias(column) for column, value in bound.items()])
    return good, classified.where(F.col("reason").isNotNull()).select("value", "timestamp", "reason")


def read_models(
    spark: SparkSession, path_or_topic: str, *, fmt: str = "registry", bounded: bool = False, **source
) -> tuple[DataFrame, DataFrame]:
    """Model versions as rows, and the quarantine of those sent as messages.

    `registry` is a folder of parquet files in the registry's own shape, to which each publication adds one; the other
    formats are those of `read_raw`, one version per JSON message. A stream begins with all versions there are, as
    pricing needs the newest of them from its first row on.
    """
    if fmt == "registry":
        reader = spark.read if bounded else spark.readStream
        versions = reader.options(**dict(source.get("options") or {})).schema(MODEL).parquet(path_or_topic)
        return versions, versions.where(F.lit(False)).select(*[F.lit(None).cast(kind).alias(name) for name, kind in _REFUSED.items()])
    if fmt == "kafka" and not bounded:
        source["options"] = {"startingOffsets": "earliest"} | dict(source.get("options") or {})
    return decode_models(read_raw(spark, path_or_topic, fmt=fmt, bounded=bounded, **source))


_REFUSED = {"value": "string", "timestamp": "timestamp", "reason": "string"}


def read_model_registry(spark: SparkSession, path: str) -> DataFrame:
    """All model versions published so far."""
    return spark.read.schema(MODEL).parquet(path)
