import datetime as dt
import os
import random
import time
from collections import Counter
from contextlib import nullcontext
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import BASE
from repricer.operators import demand as batch_demand
from repricer.operators import surge as batch_surge
from repricer.operators.lookup import lookup_competitor
from repricer.operators.pricing import price_alerts, priced_rows, with_previous_price
from repricer.schemas import EVENT_LOG, MODEL
from repricer.sources.ingest import decode_models, read_models
from repricer.streaming import demand, surge
from repricer.streaming.pricing import price_stream
from repricer.streaming.session import ends_with_its_data, prepare
from repricer.streaming.monitor import COUNTS, Counts, counted
from repricer.streaming.sinks import batch_writer, deduplicated, messages, received, with_headers, write_alerts, write_batches, write_messages, write_prices

CLICK = "product_id string, product_name string, ts timestamp, seq bigint"


def at(seconds):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=seconds)


def stream(spark, folder, schema, batches):
    """A file stream that delivers each batch in its own micro-batch."""
    for i, rows in enumerate(batches):
        add(spark, folder, schema, rows, i)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def add(spark, folder, schema, rows, i):
    staged = f"{folder}-staged-{i}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(staged)
    part = next(f for f in os.listdir(staged) if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    target = f"{folder}/{i:03d}.parquet"
    os.link(f"{staged}/{part}", target)
    os.utime(target, (BASE + i, BASE + i))


def finish(query):
    ended = query.awaitTermination(90)
    query.stop()
    assert ended and query.exception() is None


def drain(df, tmp_path, name, *, timers=False):
    writer = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True)
    )
    with ends_with_its_data(df.sparkSession) if timers else nullcontext():
        query = writer.start()
    finish(query)
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def streaming(spark):
    return prepare(spark)


def clicks_in_order(seed=7):
    """Three batches of clicks, out of order within the watermark, and the closing rows."""
    rng = random.Random(seed)
    clicks = [(f"p{rng.randrange(3)}", "n", at(rng.uniform(0, 5400)), i) for i in range(300)]
    clicks.sort(key=lambda c: c[2])
    batches = [clicks[:100], clicks[100:200], clicks[200:]]
    for batch in batches:
        rng.shuffle(batch)
    # rows of another product, hours later, move the watermark past every window
    return batches, [[("end", "n", at(40_000), 900)], [("end", "n", at(80_000), 901)]]


def test_demand_equals_batch(streaming, tmp_path):
    batches, closing = clicks_in_order()
    clicks = stream(streaming, str(tmp_path / "in"), CLICK, batches + closing)
    got = drain(demand.demand_metrics(clicks), tmp_path, "demand_pairs").where("product_id <> 'end'")
    columns = ["product_id", "product_name", "short_end", "long_end", "current_demand", "historical_average", "ts", "seq"]
    whole = streaming.createDataFrame([c for b in batches for c in b], CLICK)
    expected = batch_demand.demand_metrics(whole).select(columns)
    assert sorted(got.select(columns).collect()) == sorted(expected.collect()) and expected.count() > 100


def test_rates_equal_batch(streaming, tmp_path):
    batches, closing = clicks_in_order(8)
    clicks = stream(streaming, str(tmp_path / "in"), CLICK, batches + closing)
    got = drain(demand.sliding_rate(clicks), tmp_path, "rates").where("product_id <> 'end'").drop("at")
    expected = batch_demand.sliding_rate(streaming.createDataFrame([c for b in batches for c in b], CLICK))
    assert sorted(got.select(expected.columns).collect()) == sorted(expected.collect())


def test_late_clicks_are_dropped(streaming, tmp_path):
    # the watermark of a micro-batch rejects rows from the next one but one on
    times = [10, 4000, 4001, 4002, 20, 9000]
    clicks = stream(streaming, str(tmp_path / "in"), CLICK, [[("p", "n", at(t), i)] for i, t in enumerate(times)])
    got = drain(demand.sliding_rate(clicks), tmp_path, "late").where("window_start <= timestamp'2025-01-01 00:00:00'")
    assert {r.clicks for r in got.collect()} == {1}


def test_a_click_updates_one_cell(streaming, tmp_path):
    clicks = [("p", "n", at(30 * i), i) for i in range(400)]
    source = stream(streaming, str(tmp_path / "in"), CLICK, [clicks, [("end", "n", at(40_000), 900)]])
    writer = demand.sliding_rate(source, size="1 hour").writeStream.format("noop").outputMode("append")
    query = writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    finish(query)
    first = query.recentProgress[0]
    # the windows are the last operator; of 60 each click lies in they see none before its cell is over
    updated = [op["numRowsUpdated"] for op in first["stateOperators"]]
    assert sum(updated) == 200 and first["numInputRows"] == 400


@pytest.mark.parametrize("width, within, n", [("1 minute", "1 minute", 10), ("1 hour", "1 minute", 10), ("10 minutes", "24 hours", 30), ("1 minute", "1 minute", 1), ("5 seconds", "1 minute", 4)])
def test_surges_equal_batch(streaming, tmp_path, width, within, n):
    rng = random.Random(3)
    orders = [(f"p{rng.randrange(2)}", f"n{i}", at(rng.uniform(3000, 4200)), i) for i in range(220)]
    orders += [("p0", "tie", at(3500), 500 + i) for i in range(12)]
    orders.sort(key=lambda o: o[2])
    batches = [orders[:80], orders[80:150], orders[150:]]
    for batch in batches:
        rng.shuffle(batch)
    closing = [[("end", "n", at(40_000), 900)], [("end", "n", at(80_000), 901)]]
    source = stream(streaming, str(tmp_path / "in"), CLICK, batches + closing)
    found = surge.surge_runs(source, n=n, within=within, slice_width=width)
    got = drain(found, tmp_path, f"surges_{width[:2].strip()}_{n}".replace(" ", "")).where("product_id <> 'end'")
    expected = batch_surge.surge_runs(streaming.createDataFrame(orders, CLICK), n=n, within=within)
    columns = ["product_id", "product_name", "first_ts", "ts", "seq"]
    assert sorted(got.select(columns).collect()) == sorted(expected.select(columns).collect())
    assert expected.count() > 20


class Kept:
    """State of one key in memory, counting what is read and written."""

    def __init__(self):
        self.moved, self.timers, self.states = 0, set(), {}

    def registerTimer(self, at_ms):
        self.timers.add(at_ms)

    def getMapState(self, name, *_):
        return self.states.setdefault(name, KeptState(self))

    getValueState = getMapState


class KeptState(dict):
    def __init__(self, handle):
        self.handle = handle

    def _move(self, value):
        self.handle.moved += sum(len(v) if isinstance(v, list) else 1 for v in value)
        return value

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self._move(self[key])

    def updateValue(self, key, value):
        self[key] = self._move(value)

    def removeKey(self, key):
        del self[key]

    def exists(self):
        return None in self

    def get(self):
        return self._move(self[None])

    def update(self, value):
        self[None] = self._move(value)

    def clear(self):
        self.pop(None, None)


def test_work_per_order_does_not_grow_with_the_slice():
    from types import SimpleNamespace

    def moved(count):
        handle = Kept()
        finder = surge._SliceRuns(10, 60_000_000, 86_400_000_000, 1_000_000)
        finder.init(handle)
        list(finder.handleInputRows(("p", 0), [SimpleNamespace(at=i * 700_000, seq=i, product_name="n") for i in range(count)], None))
        runs = []
        for due in sorted(handle.timers):
            runs += [r for r in finder.handleExpiredTimer(("p", 0), None, SimpleNamespace(getExpiryTimeInMs=lambda: due)) if r.first_at is not None]
        assert len(runs) == count - 9 and not any(handle.states.values())
        return handle.moved / count

    assert moved(8000) <= 1.05 * moved(500)


def test_lookup_on_a_stream(streaming, tmp_path):
    clicks = stream(streaming, str(tmp_path / "in"), CLICK, [[("a", "n", at(0), 0), ("a", "n", at(1), 1)], [("b", "n", at(2), 2)]])

    def fetch(product):
        return (200, '{"price": 42.0}') if product == "a" else (404, None)

    got = drain(lookup_competitor(clicks, fetch), tmp_path, "lookups")
    assert sorted((r.seq, str(r.price.amount)) for r in got.collect()) == [(0, "42.00"), (1, "42.00"), (2, "0.00")]


# --- pricing state -------------------------------------------------------------------------


def update(product, t, kind, seq, **payload):
    row = {f.split()[0]: None for f in ("demand x", "quantity x", "competitor x", "rule x", "emergency x")}
    row.update(payload)
    rank = {"DEMAND": 0, "CLICK": 2}.get(kind, 1)
    return (product, at(t), rank, seq, kind, "n", row["demand"], row["quantity"], row["competitor"], row["rule"], row["emergency"])


def model(name="a", bias="100", since=-3600, uri=None):
    return (name, at(since), "linear", Decimal(bias), Decimal(0), Decimal(0), Decimal(0), uri)


def models(spark, tmp_path, *batches):
    """A stream of model versions; one that is there from the start by default."""
    return stream(spark, str(tmp_path / "models"), MODEL, batches or [[model()]])


def eur(text):
    return (Decimal(text), "EUR")


def test_pricing_state(streaming, tmp_path):
    batches = [
        [update("p", 0, "INVENTORY", 0, quantity=50), update("q", 0, "CLICK", 1)],
        [update("p", 2, "CLICK", 2), update("p", 1, "COMPETITOR", 3, competitor=eur("300.00"))],
        [update("p", 3, "DEMAND", 4, demand=(2.0, 1.0))],
        [
            update("p", 4, "RULE", 5, rule=(eur("1.00"), eur("150.00"))),
            update("p", 5, "RULE", 6, rule=((Decimal("1.00"), "USD"), (Decimal("9.00"), "USD"))),
        ],
    ]
    log = stream(streaming, str(tmp_path / "in"), EVENT_LOG, batches)
    got = drain(price_stream(log, models(streaming, tmp_path)), tmp_path, "priced", timers=True)
    rows = {
        "p": [
            (r.metric_type, str(r.new_price.amount), r.previous_price and str(r.previous_price), r.is_alert)
            for r in got.where("product_id = 'p' AND NOT is_conflict").orderBy("ts").collect()
        ],
        "q": [(r.metric_type, str(r.new_price.amount)) for r in got.where("product_id = 'q'").collect()],
    }
    assert rows["p"] == [
        ("INVENTORY", "70.00", None, False),
        ("CLICK", "160.00", "70.00", True),
        ("RULE", "150.00", "160.00", False),
    ]
    (refused,) = got.where("is_conflict").collect()
    assert (refused.metric_type, refused.new_price, refused.is_alert) == ("RULE", None, False)
    assert rows["q"] == [("CLICK", "77.00")]  # unknown stock counts as low


def test_no_model_no_price(streaming, tmp_path):
    log = stream(streaming, str(tmp_path / "in"), EVENT_LOG, [[update("p", 0, "CLICK", 0)]])
    assert drain(price_stream(log, models(streaming, tmp_path, [])), tmp_path, "unpriced", timers=True).count() == 0


def test_surge_factor_and_inactivity_by_processing_time(streaming, tmp_path):
    """The factor dies and the product is repriced without demand while nothing arrives."""
    folder = str(tmp_path / "in")
    first = [
        update("p", 0, "INVENTORY", 0, quantity=50),
        update("p", 1, "DEMAND", 1, demand=(2.0, 1.0)),
        update("p", 2, "EMERGENCY", 2, emergency=(1.2, at(2))),
        update("p", 3, "CLICK", 3),
    ]
    log = stream(streaming, folder, EVENT_LOG, [first])
    priced = price_stream(log, models(streaming, tmp_path), ttl="3 seconds", gap="4 seconds")
    query = (
        priced.writeStream.format("memory").queryName("timed").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start()
    )
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not streaming.table("timed").where("metric_type = 'RESET'").count():
            time.sleep(1)
    finally:
        query.stop()
    rows = {r.metric_type: r for r in streaming.table("timed").collect()}
    assert str(rows["CLICK"].new_price.amount) == "88.20"
    assert (str(rows["RESET"].new_price.amount), rows["RESET"].current_demand) == ("70.00", 0.0)
    assert rows["RESET"].product_name == "n" and not rows["RESET"].is_alert
    assert streaming.table("timed").where("metric_type = 'RESET'").count() == 1


def test_delivery(streaming, tmp_path):
    batches = [
        [update("p", 0, "INVENTORY", 0, quantity=50)],
        [update("p", 1, "COMPETITOR", 1, competitor=eur("300.00")), update("p", 2, "CLICK", 2)],
    ]
    log = stream(streaming, str(tmp_path / "in"), EVENT_LOG, batches)
    priced = price_stream(log, models(streaming, tmp_path))
    text = "ALERT: price jump for p new=Money(amount=160.00, currency=EUR)"

    def deliver(write, name):
        out = str(tmp_path / name)
        finish(write(priced, path=out, checkpoint=str(tmp_path / f"{name}-checkpoint"), once=True))
        return streaming.read.parquet(out)

    both = deliver(write_messages, "both")
    assert {r.topic: r["count"] for r in both.groupBy("topic").count().collect()} == {"prices": 2, "alerts": 1}
    assert both.where("topic = 'alerts'").first().value == text
    # a restart from the same checkpoint delivers nothing twice
    assert deliver(write_messages, "both").count() == 3
    assert deliver(write_prices, "prices").count() == 2
    assert [r.key for r in deliver(write_alerts, "alerts").collect()] == [text]
    assert messages(priced).isStreaming


def test_currency_conflicts_are_delivered(streaming, tmp_path):
    dollars = ((Decimal("1.00"), "USD"), (Decimal("9.00"), "USD"))
    batches = [[update("p", 0, "CLICK", 0)], [update("p", 1, "RULE", 1, rule=dollars)], [update("p", 2, "COMPETITOR", 2, competitor=(Decimal("5.00"), "USD")), update("p", 3, "CLICK", 3)]]
    priced = price_stream(stream(streaming, str(tmp_path / "in"), EVENT_LOG, batches), models(streaming, tmp_path))
    out = str(tmp_path / "out")
    finish(write_messages(priced, path=out, checkpoint=str(tmp_path / "checkpoint"), once=True))
    rows = streaming.read.parquet(out).collect()
    assert sorted(r.topic for r in rows) == ["conflicts", "prices", "prices"]
    (value,) = [r.value for r in rows if r.topic == "conflicts"]
    assert '"metric_type":"RULE"' in value and '"min":"USD"' in value and '"competitor":"EUR"' in value


def prices(table):
    rows = table.collect()
    return sorted((r.product_id, r.metric_type, str(r.new_price.amount), str(r.previous_price), r.is_alert) for r in rows)


def hot_log(seed=5):
    """Four micro-batches in the order of time; one product has most of the clicks and some of the updates."""
    rng, rows = random.Random(seed), []
    for seq in range(400):
        t, product = seq * 1.5, "hot" if rng.random() < 0.8 else f"p{rng.randrange(3)}"
        kind = rng.choices(["CLICK", "INVENTORY", "DEMAND", "COMPETITOR", "RULE", "EMERGENCY"], [30, 2, 2, 2, 1, 1])[0]
        payload = {
            "INVENTORY": lambda: {"quantity": rng.choice([3, 50])},
            "DEMAND": lambda: {"demand": rng.choice([(2.0, 1.0), (1.0, 1.0)])},
            "COMPETITOR": lambda: {"competitor": eur(rng.choice(["10.00", "90.00", "400.00"]))},
            "RULE": lambda: {"rule": (eur("1.00"), eur(rng.choice(["80.00", "500.00"])))},
            "EMERGENCY": lambda: {"emergency": (1.2, at(t))},
        }.get(kind, dict)()
        rows.append(update(product, t, kind, seq, **payload))
    batches = [rows[:90], rows[90:200], rows[200:210], rows[210:]]
    for batch in batches:
        rng.shuffle(batch)
    return batches


@pytest.mark.parametrize("shards, hot", [(1, None), (3, ["hot"]), (4, None)])
def test_a_hot_product_is_priced_as_in_batch(streaming, tmp_path, shards, hot):
    batches = hot_log()
    # a dearer model comes in the third micro-batch, and holds from inside it
    versions = [[model()], [], [model("b", "170", since=303.0)], []]
    log = stream(streaming, str(tmp_path / "in"), EVENT_LOG, batches)
    priced = price_stream(log, models(streaming, tmp_path, *versions), ttl="1 day", gap="1 day", buckets=5, shards=shards, hot=hot)
    got = drain(priced, tmp_path, f"hot_{shards}", timers=True)
    whole = streaming.createDataFrame([r for b in batches for r in b], EVENT_LOG)
    registry = streaming.createDataFrame([v for b in versions for v in b], MODEL)
    emitted = priced_rows(whole, registry, ttl="1 day")
    alerts = {r.seq for r in price_alerts(emitted).collect()}
    expected = sorted(
        (r.product_id, r.metric_type, str(r.new_price.amount), str(r.previous_price), r.seq in alerts) for r in with_previous_price(emitted).collect()
    )
    assert prices(got) == expected
    assert len(alerts) > 5 and len({p for p, *_ in expected}) == 4


def test_the_own_place_of_a_hot_product_sees_changes_only(streaming, tmp_path):
    from repricer.streaming.pricing import pricing_facts

    log = stream(streaming, str(tmp_path / "in"), EVENT_LOG, hot_log())
    facts = pricing_facts(log, models(streaming, tmp_path), ttl="1 day", gap="1 day", buckets=4, shards=4, hot=["hot"])
    rows = drain(facts, tmp_path, "lanes", timers=True).where("product_id = 'hot'").collect()
    assert len({r.lane for r in rows}) == 5 and sum(r.lane == 0 for r in rows) < 0.5 * len(rows)


def test_versions_come_as_a_stream(streaming, tmp_path):
    """A version prices the next trigger, an older one that comes late does not, and a restart keeps the newest."""
    clicks = [[update("p", 10, "INVENTORY", 0, quantity=50)], [update("p", 20, "CLICK", 1)], [update("p", 30, "CLICK", 2)]]
    log = stream(streaming, str(tmp_path / "in"), EVENT_LOG, clicks)
    versions = models(streaming, tmp_path, [model("a", "100")], [model("c", "300", since=15)], [model("b", "200", since=12)])

    def run():
        out = str(tmp_path / "out")
        finish(write_messages(price_stream(log, versions, buckets=3), path=out, checkpoint=str(tmp_path / "checkpoint"), once=True))
        return [r.value for r in streaming.read.parquet(out).where("topic = 'prices'").collect()]

    amounts = lambda values: sorted(v.split('"amount":')[1].split(",")[0] for v in values)
    assert amounts(run()) == ["210.00", "210.00", "70.00"]
    add(streaming, str(tmp_path / "in"), EVENT_LOG, [update("p", 40, "CLICK", 3), update("new", 41, "CLICK", 4)], 7)
    assert amounts(run()) == ["210.00", "210.00", "210.00", "231.00", "70.00"]


def test_scored_once_and_the_past_stays(streaming, tmp_path):
    """A scorer sees every trigger once; the previous price is the one that was emitted, whatever the scorer is now."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def scorer_of(price):
        def scorer(features):
            for _ in range(len(features)):
                (seen / str(random.random())).touch()
            return features["inventory_level"] * 0 + price

        return scorer

    def run(price):
        priced = price_stream(log, models(streaming, tmp_path, []) if price < 0 else versions, scorer=scorer_of(price), buckets=2)
        query = (
            priced.select("metric_type", F.col("new_price.amount").alias("amount"), "previous_price").writeStream.format("parquet")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
        )
        with ends_with_its_data(streaming):
            finish(query.start())
        rows = streaming.read.parquet(str(tmp_path / "out")).collect()
        return Counter((r.metric_type, str(r.amount), str(r.previous_price)) for r in rows)

    log = stream(streaming, str(tmp_path / "in"), EVENT_LOG, [[update("p", 1, "INVENTORY", 0, quantity=50)], [update("p", 2, "CLICK", 1)]])
    versions = models(streaming, tmp_path)
    first = Counter({("INVENTORY", "70.00", "None"): 1, ("CLICK", "70.00", "70.00"): 1})
    assert run(100.0) == first and len(os.listdir(seen)) == 2
    add(streaming, str(tmp_path / "in"), EVENT_LOG, [update("p", 3, "CLICK", 2)], 5)
    assert run(300.0) == first + Counter({("CLICK", "210.00", "70.00"): 1}) and len(os.listdir(seen)) == 3


def test_model_messages(spark):
    texts = [
        '{"modelId":"m","effectiveTime":1735689600000,"kind":"linear","bias":"12.5","wInventory":0.1,"wDemand":2,"wCompetitor":null,"artifactUri":"s"}',
        '{"modelId":"n","kind":"linear"}',
        '{"modelId":"n","bias":"many"}',
        '{"kind":"linear"}',
        '{"modelId":"n","color":"red"}',
        "nonsense",
    ]
    good, bad = decode_models(spark.createDataFrame([(t, at(7)) for t in texts], "value string, timestamp timestamp"))
    assert [c for c in good.columns] == [c.split()[0] for c in MODEL.split(", ")]
    rows = {r.model_id: r for r in good.collect()}
    assert rows["m"].effective_ts == at(0) and rows["m"].bias == Decimal("12.5") and rows["m"].w_competitor is None
    assert rows["n"].effective_ts == at(7)
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "no_model", "unknown_field", "wrong_type"]


def test_versions_from_files_of_messages(streaming, tmp_path):
    (tmp_path / "sent").mkdir()
    (tmp_path / "sent" / "a.json").write_text('{"modelId":"m","effectiveTime":5,"kind":"linear","bias":1,"wInventory":0,"wDemand":0,"wCompetitor":0}\nno\n')
    good, bad = read_models(streaming, str(tmp_path / "sent"), fmt="text")
    assert [r.model_id for r in drain(good, tmp_path, "sent_models").collect()] == ["m"]
    assert [r.reason for r in drain(bad, tmp_path, "refused_models").collect()] == ["malformed"]


def test_a_repeated_batch_gives_each_price_once(streaming, tmp_path):
    batches = [
        [update("p", 0, "INVENTORY", 0, quantity=50), update("q", 0, "CLICK", 1)],
        [update("p", 1, "COMPETITOR", 2, competitor=eur("300.00")), update("p", 2, "CLICK", 3), update("p", 2, "CLICK", 4)],
    ]
    priced = price_stream(stream(streaming, str(tmp_path / "in"), EVENT_LOG, batches), models(streaming, tmp_path))
    out = str(tmp_path / "out")
    finish(write_batches(priced, out, checkpoint=str(tmp_path / "checkpoint"), once=True))
    sent = streaming.read.parquet(out).select("batch", "topic", "key", "value", "message_id")
    first = sorted(sent.collect())
    assert Counter(r.topic for r in first) == {"prices": 4, "alerts": 1} and len({r.message_id for r in first}) == 5
    # the last micro-batch runs again: its folder is replaced
    again = streaming.createDataFrame(sent.where("batch = 1").drop("batch").collect(), sent.drop("batch").schema)
    batch_writer(out)(again, 1)
    assert sorted(streaming.read.parquet(out).select(sent.columns).collect()) == first
    # another run over the same events sends the same ids, whatever the instant of pricing
    other = str(tmp_path / "other")
    finish(write_messages(priced, path=other, checkpoint=str(tmp_path / "other-checkpoint"), once=True))
    assert {r.message_id for r in streaming.read.parquet(other).collect()} == {r.message_id for r in first}
    # a consumer of an at-least-once topic
    schema = "topic string, key string, value string, message_id string, sent_at timestamp"
    once = [(r.topic, r.key, r.value, r.message_id, at(i)) for i, r in enumerate(first)]
    twice = [(*r[:4], r[4] + dt.timedelta(seconds=30)) for r in once]
    arriving = stream(streaming, str(tmp_path / "topic"), schema, [once[:3], twice[:3] + once[3:], twice])
    got = drain(deduplicated(arriving, within="10 minutes"), tmp_path, "deduplicated")
    assert sorted(r.message_id for r in got.collect()) == sorted(r.message_id for r in first)
    sent = streaming.read.parquet(out)
    assert deduplicated(sent.union(sent)).count() == 5


def test_ids_travel_as_headers(spark):
    out = spark.createDataFrame([("prices", "p", "{}", "prices:1")], "topic string, key string, value string, message_id string")
    records = with_headers(out).selectExpr("topic", "cast(key as binary) key", "cast(value as binary) value", "headers", "timestamp'2025-01-01 00:00:00' timestamp")
    assert [tuple(r) for r in received(records).collect()] == [("prices", "p", "{}", "prices:1", dt.datetime(2025, 1, 1))]


def test_counts_of_late_refused_and_conflicting_rows(streaming, tmp_path):
    counts = Counts()
    streaming.streams.addListener(counts)
    try:
        times = [10, 4000, 4001, 4002, 20, 100, 200, 9000]
        clicks = [[("p", "n", at(t), i)] for i, t in enumerate(times[:4])] + [[("p", "n", at(t), i) for i, t in enumerate(times[4:7])]] + [[("p", "n", at(9000), 9)]]
        drain(demand.sliding_rate(stream(streaming, str(tmp_path / "clicks"), CLICK, clicks)), tmp_path, "late_counted")
        dollars = ((Decimal("1.00"), "USD"), (Decimal("9.00"), "USD"))
        log = stream(streaming, str(tmp_path / "in"), EVENT_LOG, [[update("p", 0, "CLICK", 0)], [update("p", 1, "RULE", 1, rule=dollars), update("p", 2, "CLICK", 2)]])
        priced = counted(price_stream(log, models(streaming, tmp_path)), "priced", conflicts="is_conflict", alerts="is_alert")
        drain(priced, tmp_path, "conflicts_counted", timers=True)
        deadline = time.time() + 30
        while time.time() < deadline and counts.table(streaming).where("query = 'conflicts_counted'").count() < 2:
            time.sleep(0.5)
    finally:
        streaming.streams.removeListener(counts)
    table = counts.table(streaming)
    totals = {r["query"]: r for r in table.groupBy("query").agg(*[F.sum(c).alias(c) for c in ("rows_read", "dropped_late", "conflicts", "alerts")]).collect()}
    assert (totals["late_counted"].rows_read, totals["late_counted"].dropped_late) == (8, 3)
    assert (totals["conflicts_counted"].conflicts, totals["conflicts_counted"].alerts) == (2, 0)
    counts.write(streaming, str(tmp_path / "counts"))
    counts.write(streaming, str(tmp_path / "counts"))
    assert sorted(streaming.read.parquet(str(tmp_path / "counts")).collect()) == sorted(table.collect())
    assert streaming.read.parquet(str(tmp_path / "counts")).columns == [f.split()[0] for f in COUNTS.split(", ")]
