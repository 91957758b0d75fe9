"""The sample tables bound to the inputs of the engine.

The `events` table is the source of every stream: its type selects the stream, the key in
its JSON properties is the product, `part` names the product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repricer.functions.intervals import floor_to, micros, slice_width_for
from repricer.functions.money import amount, money

# event type of each input
STREAMS = {
    "click": "click",
    "order": "purchase",
    "inventory": "signup",
    "rule": "error",
    "competitor": "view",
}


# columns used of each table; a fixed schema spares the footer-reading job of inference
_COLUMNS = {
    "events": "event_id bigint, ts timestamp_ntz, event_type string, value double, props string",
    "part": "p_partkey bigint, p_name string, p_retailprice double",
    "orders": "o_orderkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_tax double",
}


def quantity() -> Column:
    return F.floor("value").cast("int")


def competitor_price() -> Column:
    return money(F.col("value"))


def rule_bounds(mixed_currencies: bool = False) -> list[Column]:
    """Price bounds at one and three times the event's value."""
    value = F.col("value")
    low, high = F.lit("EUR"), F.lit("EUR")
    if mixed_currencies:
        low = F.when(value >= 100, "USD").otherwise("EUR")
        high = F.when(value >= 50, "USD").otherwise("EUR")
    return [
        money(amount(value), low).alias("min_price"),
        money(amount(value) * 3, high).alias("max_price"),
    ]


class Sample:
    """The tables of one folder; each is opened once however many streams use it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._open, self._width = spark, sf_dir, {}, None

    def table(self, name: str) -> DataFrame:
        if name not in self._open:
            reader = self._spark.read.schema(_COLUMNS[name])
            self._open[name] = reader.parquet(f"{self._dir}/{name}.parquet")
        return self._open[name]

    def events(self, *kinds: str) -> DataFrame:
        """Event rows of the given streams, or all, as (product_id, product_name, ts, seq, event_type, value)."""
        rows = self.table("events")
        if kinds:
            rows = rows.where(F.col("event_type").isin(*[STREAMS[kind] for kind in kinds]))
        keyed = rows.select(
            F.get_json_object("props", "$.k").alias("product_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id").alias("seq"),
            "event_type",
            "value",
        )
        names = self.table("part").select("p_partkey", F.col("p_name").alias("product_name"))
        return keyed.join(names, F.col("product_id").cast("bigint") == F.col("p_partkey"), "left").select(
            "product_id", "product_name", "ts", "seq", "event_type", "value"
        )

    def slice_width(self) -> str:
        """The width of time slices that suits the busiest product of the events; worked out once."""
        if self._width is None:
            keyed = self.table("events").select(F.get_json_object("props", "$.k").alias("product_id"), F.col("ts").cast("timestamp").alias("ts"))
            self._width = slice_width_for(keyed)
        return self._width

    def clicks(self) -> DataFrame:
        return self.events("click").select("product_id", "product_name", "ts", "seq")

    def orders(self) -> DataFrame:
        return self.events("order").select("product_id", "product_name", "ts", "seq")

    def sales(self) -> DataFrame:
        """Orders with the price they were made at."""
        return self.events("order").select("product_id", "product_name", "ts", "seq", money(F.col("value")).alias("price"))

    def line_orders(self) -> DataFrame:
        """Order lines as orders, one per line, at the time of their order."""
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        dated = self.table("orders").select("o_orderkey", "o_orderdate")
        return lines.join(dated, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_partkey").cast("string").alias("product_id"),
            F.lit("").alias("product_name"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            # order key and line number as one number: lines stay in order within an instant
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        )

    def inventory(self) -> DataFrame:
        return self.events("inventory").select(
            "product_id", "product_name", "ts", "seq", quantity().alias("quantity")
        )

    def rules(self) -> DataFrame:
        return self.events("rule").select("product_id", "product_name", "ts", "seq", *rule_bounds())

    def competitor_prices(self) -> DataFrame:
        return self.events("competitor").select(
            "product_id", "product_name", "ts", "seq", competitor_price().alias("price")
        )

    def competitor_answers(self) -> DataFrame:
        """One service answer per part: its retail price."""
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("product_id"),
            F.lit(200).alias("status"),
            F.to_json(F.struct(F.col("p_retailprice").alias("price"))).alias("body"),
        )

    def registry(self) -> DataFrame:
        """A linear model per week, released at the week's end with its mean competitor price as bias."""
        week = micros("7 days")
        seen = (
            self.table("events")
            .where(F.col("event_type") == STREAMS["competitor"])
            .select(
                floor_to(F.unix_micros(F.col("ts").cast("timestamp")), week).alias("week"),
                (amount(F.col("value")) * 100).cast("bigint").alias("cents"),
            )
        )
        number = (F.col("week") / week).cast("bigint").cast("string")
        mean = F.col("mean_cents").cast("decimal(18,2)") * F.lit("0.01").cast("decimal(3,2)")
        return (
            seen.groupBy("week")
            .agg(F.expr("sum(cents) div count(1)").alias("mean_cents"))
            .select(
                F.concat(F.lit("week-"), number).alias("model_id"),
                F.timestamp_micros(F.col("week") + week).alias("effective_ts"),
                F.lit("linear").alias("kind"),
                mean.cast("decimal(18,4)").alias("bias"),
                F.lit("-0.05").cast("decimal(10,4)").alias("w_inventory"),
                F.lit("0.75").cast("decimal(10,4)").alias("w_demand"),
                F.lit("0.4").cast("decimal(10,4)").alias("w_competitor"),
                F.lit(None).cast("string").alias("artifact_uri"),
            )
        )

    def messages(self, kind: str) -> DataFrame:
        """The events of one stream as JSON messages with their transport time."""

        def bound(times: int) -> Column:
            cents = (amount(F.col("value")) * times).cast("decimal(18,2)")
            return F.struct(cents.alias("amount"), F.lit("EUR").alias("currency"))

        product = [F.col("product_id").alias("productId"), F.col("product_name").alias("productName")]
        sent = F.unix_millis("ts").alias("timestamp")
        counted = quantity().alias("quantity")
        record = {
            "click": F.struct(*product, sent),
            "order": F.struct(F.col("seq").cast("string").alias("orderId"), *product, counted, sent),
            "inventory": F.struct(*product, counted),
            "rule": F.struct(
                *product, F.struct(bound(1).alias("minPrice"), bound(3).alias("maxPrice")).alias("priceRule")
            ),
        }[kind]
        return self.events(kind).select(F.to_json(record).alias("value"), F.col("ts").alias("timestamp"), "seq")
