"""Price models: which version holds at an instant, and what it predicts."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repricer.functions.intervals import floor_to, micros
from repricer.functions.money import amount
from repricer.functions.pricing import linear_price
from repricer.schemas import MODEL_FIELDS

_DAY = micros("1 day")
#: Versions, counted once per day in force, that are broadcast: some 20 MB.
BROADCAST_ROWS = 50_000
SALTS = 64

# Takes one Arrow batch (product_id, inventory_level, current_demand, competitor_price as
# float32 features, model_id, artifact_uri) and returns its predicted prices.
Scorer = Callable[[pd.DataFrame], pd.Series]


# Takes features of one model version and returns its predicted prices.
Predict = Callable[[pd.DataFrame], pd.Series]


class ArtifactScorer:
    """A scorer that loads what `artifact_uri` points to, once per worker process.

    A batch is split by artifact, so a model only ever sees rows of its own version, and every row once. `load` turns a
    URI into a prediction; each worker keeps the `keep` artifacts used last. Rows without an artifact have no price.
    """

    def __init__(self, load: Callable[[str], Predict], *, keep: int = 4):
        self._load, self._keep, self._name = load, keep, uuid.uuid4().hex

    def __call__(self, features: pd.DataFrame) -> pd.Series:
        prices = pd.Series(float("nan"), index=features.index, dtype="float32")
        for uri, rows in features.groupby("artifact_uri", sort=True):
            prices.loc[rows.index] = pd.Series(self._loaded(uri)(rows), index=rows.index).astype("float32")
        return prices

    def _loaded(self, uri: str) -> Predict:
        held = _artifacts.setdefault(self._name, OrderedDict())
        if uri not in held:
            held[uri] = self._load(uri)
            if len(held) > self._keep:
                held.popitem(last=False)
        held.move_to_end(uri)
        return held[uri]


#: By scorer: the artifacts that this worker process has loaded, the one used last at the end.
_artifacts: dict[str, OrderedDict[str, Predict]] = {}


def model_days(registry: DataFrame) -> DataFrame:
    """Model versions with their validity span, once per calendar day they are in force.

    At most one row per version plus one per day between the first and the last version.
    """
    dated = registry.withColumn("day", floor_to(F.unix_micros("effective_ts"), _DAY))
    # the unpartitioned window sees one row per calendar day with a release, nothing more
    following = (
        dated.groupBy("day")
        .agg(F.min("effective_ts").alias("first_ts"))
        .select("day", F.lead("first_ts").over(Window.orderBy("day")).alias("next_day_ts"))
    )
    in_day = Window.partitionBy("day").orderBy("effective_ts", "model_id")
    spans = dated.join(following, "day").withColumn(
        "valid_to", F.coalesce(F.lead("effective_ts").over(in_day), F.col("next_day_ts"))
    )
    last_day = floor_to(F.unix_micros(F.coalesce("valid_to", "effective_ts")), _DAY)
    return spans.select(
        F.struct(*MODEL_FIELDS).alias("model"),
        "valid_to",
        F.explode(F.sequence("day", last_day, F.lit(_DAY))).alias("held_day"),
    )


def _small(held: DataFrame, most: int) -> DataFrame | None:
    """The rows as a local table, if there are at most `most`; they are computed once, here."""
    rows = held.limit(most + 1).collect()
    return held.sparkSession.createDataFrame(rows, held.schema) if len(rows) <= most else None


def attach_model(
    rows: DataFrame, registry: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS, salts: int = SALTS
) -> DataFrame:
    """Add the struct `model`, the newest version at `ts`; NULL before the first release.

    An equi-join on the day; days after the last release share that release's day. Up to
    `broadcast_rows` versions (one per day in force) are computed once and broadcast, and the
    rows stay where they are. Beyond it the join is shuffled on day and salt, the salt a hash
    of the product and the versions copied to each, so that no day is one task. Which of the two it is takes a job that
    reads the registry when the query is built.
    """
    held = model_days(registry)
    local = _small(held, broadcast_rows)
    last_release = registry if local is None else local.select("model.effective_ts")
    last_day = last_release.agg(floor_to(F.unix_micros(F.max("effective_ts")), _DAY)).scalar()
    keyed = rows.withColumn("on_day", F.least(floor_to(F.unix_micros("ts"), _DAY), last_day))
    in_force = (
        (F.col("on_day") == F.col("held_day"))
        & (F.col("model.effective_ts") <= F.col("ts"))
        & (F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to")))
    )
    if local is not None:
        return keyed.join(F.broadcast(local), in_force, "left").drop("on_day", "held_day", "valid_to")
    dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("product_id", "ts"), F.lit(salts)).cast("int"))
    copied = held.withColumn("held_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = in_force & (F.col("salt") == F.col("held_salt"))
    return dealt.join(copied, same, "left").drop("on_day", "held_day", "valid_to", "salt", "held_salt")


def _scored_by(scorer: Scorer, ctx: Column, model: Column) -> Column:
    @F.pandas_udf("float")
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for features in batches:
            yield scorer(features).astype("float32")

    features = F.struct(
        ctx["product_id"].alias("product_id"),
        ctx["inventory_level"].cast("float").alias("inventory_level"),
        ctx["current_demand"].cast("float").alias("current_demand"),
        ctx["competitor_price"]["amount"].cast("float").alias("competitor_price"),
        model["model_id"].alias("model_id"),
        model["artifact_uri"].alias("artifact_uri"),
    )
    return amount(predict(features).cast("double"))


def model_price(ctx: Column, model: Column, scorer: str | Scorer = "linear") -> Column:
    """Predicted price of a context struct, as an exact two-decimal amount."""
    return linear_price(ctx, model) if scorer == "linear" else _scored_by(scorer, ctx, model)


def score(
    context: DataFrame, registry: DataFrame, *, scorer: str | Scorer = "linear", effects: DataFrame | None = None
) -> DataFrame:
    """Contexts with a `model` and its `model_price`; rows without a model are dropped.

    `effects` (model_id, product_id, effect) are added to the prices of the products they name; there is one row at most for
    a version and product, so the join copies nothing, and a hot product's rows are split by Spark.
    """
    known = attach_model(context, registry).where(F.col("model").isNotNull())
    ctx = F.struct(*[F.col(name) for name in context.columns])
    priced = known.withColumn("model_price", model_price(ctx, F.col("model"), scorer))
    if effects is None:
        return priced
    own = effects.select(F.col("model_id").alias("e_model"), F.col("product_id").alias("e_product"), "effect")
    same = (F.col("model.model_id") == F.col("e_model")) & (F.col("product_id") == F.col("e_product"))
    lifted = amount(F.col("model_price") + F.coalesce("effect", F.lit(0).cast("decimal(18,4)")))
    return priced.join(own, same, "left").withColumn("model_price", lifted).drop("e_model", "e_product", "effect")
