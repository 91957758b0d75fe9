"""Training sets as of decision time, evaluation of models and a batch fit of the linear one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from repricer.functions.money import AMOUNT
from repricer.operators.eventlog import as_update
from repricer.operators.model import Scorer, score
from repricer.operators.state import DEFAULT_SLICE, EMERGENCY_TTL, state_asof, with_defaults
from repricer.schemas import MODEL, PAYLOADS

FEATURES = ("inventory_level", "current_demand", "competitor_amount")


def training_set(
    log: DataFrame, sales: DataFrame, *, ttl: str = EMERGENCY_TTL, slice_width: str = DEFAULT_SLICE
) -> DataFrame:
    """For each sale the facts known just before it, and its price as `label`.

    `sales` has product_id, product_name, ts, seq and the money `price`. A sale comes before all
    that happens at its instant, so that nothing it caused itself (a surge) is among its facts. Sales that are alike in
    product, time and `seq` are an example each.
    """
    # the price travels in the log; as a struct it is the sale's own even where it is NULL
    asked = as_update(sales.withColumn("sale", F.struct(F.col("price.amount").alias("label"))), "SALE", keep=("sale",))
    known = state_asof(log.unionByName(asked, allowMissingColumns=True), slice_width=slice_width, payloads=(*PAYLOADS, "sale"))
    facts = with_defaults(known.where(F.col("metric_type") == "SALE"), ttl=ttl, keep=("sale",))
    return facts.withColumn("label", F.col("sale.label")).drop("sale")


def product_effects(
    examples: DataFrame, registry: DataFrame, *, scorer: str | Scorer = "linear", shrinkage: int = 5
) -> DataFrame:
    """Columns model_id, product_id, examples and effect: by how much a product sold above what the version in force predicts.

    The mean is taken as if there were `shrinkage` more examples that were met exactly, so products with few sales stay
    near the common model. Residuals are added up as exact decimals in the map tasks first, a row per version and product.
    """
    priced = score(examples.where(F.col("label").isNotNull()), registry, scorer=scorer)
    residual = (F.col("label") - F.col("model_price")).cast("decimal(20,2)")
    sums = priced.groupBy(F.col("model.model_id").alias("model_id"), "product_id").agg(
        F.count(residual).alias("examples"), F.sum(residual).cast("decimal(24,2)").alias("off")
    )
    return sums.where("examples > 0").select(
        "model_id", "product_id", "examples", (F.col("off") / (F.col("examples") + shrinkage)).cast("decimal(18,4)").alias("effect")
    )


def model_errors(
    examples: DataFrame, registry: DataFrame, *, scorer: str | Scorer = "linear", effects: DataFrame | None = None
) -> DataFrame:
    """Per model version the number of examples it priced, mean squared error and mean absolute percentage error.

    Takes the output of `training_set`; examples before the first version are left out. The percentage
    leaves out labels of zero. Errors are added up as exact decimals, so the order of rows does not show.
    """
    priced = score(examples.where(F.col("label").isNotNull()), registry, scorer=scorer, effects=effects)
    off = (F.col("model_price") - F.col("label")).cast(AMOUNT)
    share = F.when(F.col("label") != 0, F.abs(off.cast("double") / F.col("label").cast("double")))
    return (
        priced.select(
            F.col("model.model_id").alias("model_id"),
            (off * off).cast("decimal(30,4)").alias("squared"),
            share.cast("decimal(18,8)").alias("share"),
        )
        .groupBy("model_id")
        .agg(
            F.count(F.lit(1)).alias("examples"),
            (F.sum("squared").cast("double") / F.count("squared")).alias("mse"),
            (F.sum("share").cast("double") / F.count("share") * 100).alias("mape"),
        )
    )


def fit_linear(examples: DataFrame, model_id: str, effective_ts: dt.datetime) -> DataFrame:
    """A linear model of the label as one row of the model registry."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    columns = {
        "inventory_level": F.col("inventory_level").cast("double"),
        "current_demand": F.col("current_demand"),
        "competitor_amount": F.col("competitor_price.amount").cast("double"),
    }
    rows = examples.where(F.col("label").isNotNull()).select(
        *[column.alias(name) for name, column in columns.items()], F.col("label").cast("double").alias("label")
    )
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    fitted = LinearRegression(featuresCol="features", labelCol="label").fit(vectors)
    inventory, demand, competitor = map(float, fitted.coefficients)
    row = (model_id, effective_ts, "linear", float(fitted.intercept), inventory, demand, competitor)
    names = ("model_id", "effective_ts", "kind", "bias", "w_inventory", "w_demand", "w_competitor")
    numbers = ", ".join(f"{name} double" for name in names[3:])
    made = examples.sparkSession.createDataFrame([row], f"model_id string, effective_ts timestamp, kind string, {numbers}")
    return made.withColumn("artifact_uri", F.lit(None)).select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(MODEL)])



def fit_with_products(
    examples: DataFrame, model_id: str, effective_ts: dt.datetime, *, shrinkage: int = 5, rounds: int = 3
) -> tuple[DataFrame, DataFrame]:
    """A linear model with an effect of each product: the registry row, and the effects beside it.

    The two are fitted in turn, each to what the other leaves. Products are as many as they are: effects are rows that are
    joined by product, and a product without sales has none.
    """
    model = fit_linear(examples, model_id, effective_ts)
    always = model.withColumn("effective_ts", F.lit(dt.datetime(1970, 1, 1)))
    effects = product_effects(examples, always, shrinkage=shrinkage)
    for _ in range(rounds - 1):
        lifts = effects.select("product_id", "effect")
        rest = examples.join(lifts, "product_id", "left").withColumn("label", F.col("label") - F.coalesce("effect", F.lit(0).cast("decimal(18,4)")))
        model = fit_linear(rest.drop("effect"), model_id, effective_ts)
        always = model.withColumn("effective_ts", F.lit(dt.datetime(1970, 1, 1)))
        effects = product_effects(examples, always, shrinkage=shrinkage)
    return model, effects
