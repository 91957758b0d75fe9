import datetime as dt
from decimal import Decimal

import pytest

from repricer.sources.ingest import decode_json, kafka_options, read_events, read_model_registry

AT = dt.datetime(2025, 1, 1)


def raw(spark, *values):
    return spark.createDataFrame([(v, AT) for v in values], "value string, timestamp timestamp")


def decode(spark, kind, *values):
    good, bad = decode_json(raw(spark, *values), kind)
    return [r.asDict(recursive=True) for r in good.collect()], {r.value: r.reason for r in bad.collect()}


def test_click_lives_on_its_own_time(spark):
    good, bad = decode(spark, "click", '{"productId":"p","productName":"n","timestamp":1735689600500}')
    assert good == [{"product_id": "p", "product_name": "n", "ts": dt.datetime(2025, 1, 1, 0, 0, 0, 500000)}] and not bad


def test_order_and_inventory_live_on_transport_time(spark):
    good, _ = decode(spark, "order", '{"orderId":"o","productId":"p","quantity":2,"timestamp":1000}')
    assert good[0]["ts"] == AT and good[0]["order_ts"] == dt.datetime(1970, 1, 1, 0, 0, 1)
    assert good[0]["product_name"] is None and good[0]["quantity"] == 2
    good, _ = decode(spark, "inventory", '{"productId":"p","productName":"n"}', '{"productId":"p","quantity":"7"}')
    assert [g["quantity"] for g in good] == [0, 7] and good[0]["ts"] == AT


def test_rule_bounds_are_rescaled(spark):
    text = (
        '{"productId":"p","productName":"n","priceRule":{"minPrice":{"amount":10.555,"currency":"EUR"},'
        '"maxPrice":{"amount":20,"currency":"EUR"}}}'
    )
    good, bad = decode(spark, "rule", text, '{"productId":"q","priceRule":null}')
    assert good[0]["min_price"] == {"amount": Decimal("10.56"), "currency": "EUR"} and not bad
    assert good[1]["min_price"] is None and good[1]["max_price"] is None


@pytest.mark.parametrize(
    "kind, text, reason",
    [
        ("click", "nonsense", "malformed"),
        ("click", '{"productId":"p"', "malformed"),
        ("click", None, "malformed"),
        ("click", "[1]", "malformed"),
        ("click", '{"productId":"p","colour":"red"}', "unknown_field"),
        ("click", '{"productId":"p","timestamp":"soon"}', "wrong_type"),
        ("order", '{"productId":"p","quantity":99999999999}', "wrong_type"),
        ("order", '{"productId":"p","timestamp":9223372036854776}', "wrong_type"),
        ("click", '{"productId":"p","timestamp":1e30}', "wrong_type"),
        ("click", '{"productName":"n","timestamp":5}', "no_product"),
        ("inventory", '{"productId":null,"quantity":1}', "no_product"),
        (
            "rule",
            '{"productId":"p","priceRule":{"minPrice":{"amount":1e20,"currency":"EUR"},"maxPrice":{"amount":2,"currency":"EUR"}}}',
            "wrong_type",
        ),
        ("rule", '{"priceRule":{"minPrice":{"amount":1,"unit":"x"}}}', "unknown_field"),
        ("rule", '{"priceRule":{"minPrice":{"amount":1,"currency":"EUR"}}}', "one_sided_rule"),
    ],
)
def test_quarantine(spark, kind, text, reason):
    good, bad = decode(spark, kind, text)
    assert not good and bad == {text: reason}


def test_fail_stops_at_a_bad_message(spark):
    good, _ = decode_json(raw(spark, "nonsense"), "click", on_error="fail")
    with pytest.raises(Exception, match="cannot bind message: malformed"):
        good.collect()
    good, _ = decode_json(raw(spark, '{"productId":"p"}'), "click", on_error="fail")
    assert good.count() == 1


def test_sources(spark, tmp_path):
    text = '{"productId":"p","productName":"n","quantity":3}'
    raw(spark, text, text, text).write.parquet(str(tmp_path / "raw"))
    (tmp_path / "lines.json").write_text(text + "\n")
    assert read_events(spark, "inventory", str(tmp_path / "raw"))[0].count() == 3
    lines = read_events(spark, "inventory", str(tmp_path / "lines.json"), fmt="text")[0].first()
    assert lines.quantity == 3 and lines.ts is not None
    assert read_events(spark, "inventory", str(tmp_path / "raw"), bounded=False)[0].isStreaming


def test_kafka_offsets():
    bounded = kafka_options("clicks", brokers="b:1", bounded=True)
    assert (bounded["startingOffsets"], bounded["endingOffsets"]) == ("earliest", "latest")
    live = kafka_options("clicks", brokers="b:1", bounded=False, options={"maxOffsetsPerTrigger": "1000"})
    assert live["startingOffsets"] == "latest" and "endingOffsets" not in live
    assert live["subscribe"] == "clicks" and live["maxOffsetsPerTrigger"] == "1000"


def test_registry_is_read_with_its_schema(spark, tmp_path):
    spark.sql("select 'a' as model_id, timestamp'2025-01-01' as effective_ts, 'linear' as kind").write.parquet(
        str(tmp_path / "models")
    )
    row = read_model_registry(spark, str(tmp_path / "models")).first()
    assert row.model_id == "a" and row.bias is None


def test_numbers_are_rounded_once(spark):
    text = (
        '{"productId":"p","priceRule":{"minPrice":{"amount":1.0049999,"currency":"EUR"},'
        '"maxPrice":{"amount":"1.005","currency":"EUR"}}}'
    )
    rule = decode(spark, "rule", text)[0][0]
    assert (rule["min_price"]["amount"], rule["max_price"]["amount"]) == (Decimal("1.00"), Decimal("1.01"))
    texts = ["2.9999999", "-2.9999999999999999999999", "1e2", " 7 ", "2147483647.9"]
    good, bad = decode(spark, "inventory", *[f'{{"productId":"{i}","quantity":"{t}"}}' for i, t in enumerate(texts)])
    assert [g["quantity"] for g in good] == [2, -2, 100, 7, 2147483647] and not bad


def test_messages_of_one_instant_keep_their_order(spark, tmp_path):
    texts = [f'{{"productId":"p","quantity":{i}}}' for i in range(50)]
    raw(spark, *texts).coalesce(1).write.parquet(str(tmp_path / "raw"))
    (tmp_path / "lines.json").write_text("\n".join(texts))
    for path, fmt in [("raw", "parquet"), ("lines.json", "text")]:
        good, _ = read_events(spark, "inventory", str(tmp_path / path), fmt=fmt)
        assert [r.quantity for r in good.orderBy("ts", "seq").collect()] == list(range(50))
    streamed, _ = read_events(spark, "inventory", str(tmp_path / "raw"), bounded=False)
    query = streamed.writeStream.format("memory").queryName("placed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.quantity for r in spark.table("placed").orderBy("ts", "seq").collect()] == list(range(50))
