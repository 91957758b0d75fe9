import datetime as dt
import os
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from repricer.functions.money import money
from repricer.operators.eventlog import as_update, metric_union
from repricer.operators.model import ArtifactScorer, score
from repricer.operators.training import fit_linear, fit_with_products, model_errors, product_effects, training_set
from repricer.schemas import MODEL

CLICK = "product_id string, product_name string, t double, seq bigint"


@pytest.fixture()
def example(rows):
    """Stock of 5 from 0 s, of 50 from 10 s; a surge at 20 s, with a sale at 10 s, 11 s and 20 s."""
    stock = rows(f"{CLICK}, quantity int", ("p", "n", 0.0, 0, 5), ("p", "n", 10.0, 1, 50))
    surge = rows(f"{CLICK}, adjustment_factor double", ("p", "n", 20.0, 7, 1.2))
    sales = rows(f"{CLICK}, amount string", *[("p", "n", t, i, f"{i}.00") for i, t in [(5, 10.0), (6, 11.0), (7, 20.0)]])
    log = metric_union(as_update(stock, "INVENTORY"), as_update(surge, "EMERGENCY"))
    return log, sales.withColumn("price", money(F.col("amount")))


@pytest.mark.parametrize("width", ["1 second", "1 hour"])
def test_facts_are_those_before_the_sale(example, width):
    got = training_set(*example, slice_width=width).collect()
    assert {(r.seq, r.inventory_level, r.adjustment_factor, r.label) for r in got} == {
        (5, 5, 1.0, Decimal("5.00")), (6, 50, 1.0, Decimal("6.00")), (7, 50, 1.0, Decimal("7.00")),
    }


def test_errors_and_fit(spark, rows):
    facts = rows(
        f"{CLICK}, inventory_level int, current_demand double, c string",
        *[("p", "n", float(i), i, i % 7, float(i % 5), f"{i % 11}.00") for i in range(200)],
    ).select("*", money(F.col("c")).alias("competitor_price"))
    label = 3 + F.col("inventory_level") * 0.5 + F.col("current_demand") * 2 - F.col("competitor_price.amount").cast("double") * 0.25
    examples = facts.withColumn("label", label.cast("decimal(18,2)"))
    model = fit_linear(examples, "m", dt.datetime(2024, 1, 1))
    row = model.first()
    assert row.kind == "linear" and float(row.bias) == pytest.approx(3, abs=0.02)
    assert [float(row[w]) for w in ("w_inventory", "w_demand", "w_competitor")] == pytest.approx([0.5, 2, -0.25], abs=0.01)
    errors = model_errors(examples, model).first()
    assert (errors.model_id, errors.examples) == ("m", 200) and errors.mse < 0.001 and errors.mape < 1
    flat = model.withColumns({w: F.lit(0).cast("decimal(10,4)") for w in ("w_inventory", "w_demand", "w_competitor")})
    off = model_errors(examples.filter("seq = 4"), flat.withColumn("bias", F.lit(10).cast("decimal(18,4)"))).first()
    wanted = float(examples.filter("seq = 4").first().label)
    assert off.mse == pytest.approx((10 - wanted) ** 2) and off.mape == pytest.approx(abs(10 - wanted) / wanted * 100)
    assert not model_errors(examples, flat.withColumn("effective_ts", F.lit(dt.datetime(2030, 1, 1)))).collect()


def test_repeated_sales_are_an_example_each(example, rows):
    log, sales = example
    twice = sales.unionByName(sales.where("seq = 5").withColumn("price", money(F.lit("9.00")))).unionByName(
        sales.where("seq = 6").withColumn("price", F.lit(None).cast("struct<amount: decimal(18,2), currency: string>"))
    )
    got = sorted((r.seq, str(r.label), r.inventory_level) for r in training_set(log, twice, slice_width="1 second").collect())
    assert got == [(5, "5.00", 5), (5, "9.00", 5), (6, "6.00", 50), (6, "None", 50), (7, "7.00", 50)]
    plan = training_set(log, twice)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the slices' inherited values; the label is not joined back


@pytest.fixture()
def levels(rows):
    """Sales of 40 products, each with a level of its own."""
    facts = rows(
        f"{CLICK}, inventory_level int, current_demand double, c string",
        *[(f"p{i % 40}", "n", float(i), i, i % 7, float(i // 40 % 5), f"{i % 11}.00") for i in range(1200)],
    ).select("*", money(F.col("c")).alias("competitor_price"))
    level = F.substring("product_id", 2, 9).cast("int") % 9 * 10
    label = 3 + level + F.col("inventory_level") * 0.5 + F.col("current_demand") * 2 - F.col("competitor_price.amount").cast("double") * 0.25
    return facts.withColumn("label", label.cast("decimal(18,2)"))


def test_product_effects_lower_the_error(levels):
    since = dt.datetime(2024, 1, 1)
    plain = model_errors(levels, fit_linear(levels, "m", since)).first()
    model, effects = fit_with_products(levels, "m", since)
    lifted = model_errors(levels, model, effects=effects).first()
    assert lifted.examples == plain.examples == 1200
    assert lifted.mse < 0.1 * plain.mse and lifted.mape < 0.5 * plain.mape
    assert float(model.first().w_demand) == pytest.approx(2, abs=0.05)


def test_effects_of_few_sales_are_small(levels, spark):
    model = fit_linear(levels, "m", dt.datetime(2024, 1, 1)).withColumns({n: F.lit(0).cast("decimal(10,4)") for n in ("w_inventory", "w_demand", "w_competitor")})
    model = model.withColumn("bias", F.lit(0).cast("decimal(18,4)"))
    few = levels.where("seq < 41").withColumn("label", F.lit("10.00").cast("decimal(18,2)"))
    effects = {r.product_id: (r.examples, r.effect) for r in product_effects(few, model, shrinkage=4).collect()}
    assert effects["p1"] == (1, Decimal("2.0000")) and effects["p0"] == (2, Decimal("3.3333")) and len(effects) == 40
    none = product_effects(few.withColumn("label", F.lit(None).cast("decimal(18,2)")), model)
    assert none.count() == 0 and model_errors(few, model, effects=none).first().examples == 41


def test_artifacts_are_loaded_once_and_see_their_rows_only(spark, rows, tmp_path):
    folder = str(tmp_path)

    def load(uri):
        import tempfile

        tempfile.mkstemp(prefix=f"{uri}-", dir=folder)

        def predict(features):
            assert set(features["artifact_uri"]) == {uri}
            return features["inventory_level"] + (100 if uri == "a" else 200)

        return predict

    def version(name, since):
        return (f"m{name}", dt.datetime(2025, 1, 1) + dt.timedelta(seconds=since), "onnx", *[Decimal(0)] * 4, name)

    registry = spark.createDataFrame([version("a", 0), version("b", 50), version(None, 90)], MODEL)
    contexts = rows(
        "product_id string, t double, inventory_level int, current_demand double, c string",
        *[(f"p{i % 9}", float(i), i, 1.0, "2.00") for i in range(100)],
    ).select("*", money(F.col("c")).alias("competitor_price")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {r.inventory_level: r.model_price for r in score(contexts, registry, scorer=ArtifactScorer(load)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: Decimal(i + (100 if i < 50 else 200)) if i < 90 else None for i in range(100)}
    assert sorted(name.split("-")[0] for name in os.listdir(folder)) == ["a", "b"]


def test_the_artifacts_kept_are_bounded():
    loaded = []
    scorer = ArtifactScorer(lambda uri: loaded.append(uri) or (lambda features: features["x"]), keep=2)
    for uri in ["a", "b", "a", "c", "a", "b"]:
        scorer(pd.DataFrame({"artifact_uri": [uri], "x": [1.0]}))
    assert loaded == ["a", "b", "c", "b"]
