"""The engine from message files to price and alert files."""

import json

import pytest

from repricer.schemas import MODEL
from repricer.streaming.job import start
from repricer.streaming.session import prepare
from test_streaming import model

BASE = 1_735_689_600_000


def put(folder, name, *messages):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages))


def test_messages_to_prices_and_back_again(spark, tmp_path):
    streaming = prepare(spark.newSession())
    product = {"productId": "p", "productName": "n"}
    money = lambda amount: {"amount": amount, "currency": "EUR"}
    source = tmp_path / "in"
    put(source / "inventory", "a.json", {**product, "quantity": 50})
    put(source / "rule", "a.json", {**product, "priceRule": {"minPrice": money(1), "maxPrice": money(500)}}, "nonsense")
    put(source / "click", "a.json", *[{**product, "timestamp": BASE + 20_000 * i} for i in range(4)], '{"productName":"n"}')
    put(source / "order", "a.json", *[{**product, "orderId": str(i), "quantity": 1, "timestamp": BASE} for i in range(12)])
    inputs = {kind: {"path_or_topic": str(source / kind), "fmt": "text"} for kind in ("click", "order", "inventory", "rule")}
    inputs["model"] = {"path_or_topic": str(source / "model")}
    streaming.createDataFrame([model()], MODEL).write.parquet(str(source / "model"))

    def run():
        queries = start(
            streaming, inputs, str(tmp_path / "out"), once=True,
            fetch=lambda product: (200, '{"price": 42.0}'),
        )
        queries["pricing"].awaitTermination(120)
        assert all(q.exception() is None for q in queries.values())
        return streaming.read.parquet(str(tmp_path / "out" / "delivered"))

    first = run()
    assert first.where("topic = 'prices'").count() == 6  # four clicks, the stock and the rule
    refused = streaming.read.parquet(str(tmp_path / "out" / "quarantine"))
    assert {(r.kind, r.reason) for r in refused.collect()} == {("rule", "malformed"), ("click", "no_product")}
    looked_up = streaming.read.parquet(str(tmp_path / "out" / "updates" / "lookup"))
    assert {str(r.competitor.amount) for r in looked_up.collect()} == {"42.00"} and looked_up.count() == 4
    assert run().count() == first.count()
    put(source / "click", "b.json", {**product, "timestamp": BASE + 7_200_000})
    assert run().where("topic = 'prices'").count() == 7
    put(source / "click", "c.json", {**product, "timestamp": BASE + 7_300_000})
    run()
    demand = streaming.read.parquet(str(tmp_path / "out" / "updates" / "demand"))
    assert demand.count() and {r.metric_type for r in demand.collect()} == {"DEMAND"}
    assert pytest.approx(0.8) == max(r.demand.current_demand for r in demand.collect())
