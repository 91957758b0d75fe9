import threading
import time
from decimal import Decimal

import pytest

from repricer.operators import lookup
from repricer.operators.lookup import lookup_competitor, lookup_competitor_table, parse_competitor_response

CLICK = "product_id string, t double, seq bigint"


@pytest.mark.parametrize(
    "status, body, price, error",
    [
        (200, '{"price": 42.5}', "42.50", False),
        (200, '{"price": "42.5"}', "42.50", False),
        (200, '{"price": "soon"}', "0.00", False),
        (200, '{"price": true}', "1.00", False),
        (200, '{"cost": 1}', "0.00", True),
        (200, "nonsense", "0.00", True),
        (200, None, "0.00", False),
        (404, None, "0.00", False),
        (404, '{"price": 42.5}', "0.00", False),
        (500, '{"price": 42.5}', "0.00", True),
        (None, None, "0.00", True),
    ],
)
def test_answers(spark, status, body, price, error):
    row = parse_competitor_response(spark.createDataFrame([(status, body)], "status int, body string")).first()
    assert (row.price.amount, row.price.currency, row.is_error) == (Decimal(price), "EUR", error)


def service(product):
    if product == "slow":
        time.sleep(1.5)
    if product == "broken":
        raise OSError("refused")
    return (404, None) if product == "new" else (200, '{"price": 42.0}')


@pytest.mark.parametrize("dedupe", [True, False])
def test_one_price_per_click(rows, dedupe):
    clicks = rows(CLICK, *[(p, float(i), i) for i, p in enumerate(["a", "a", "slow", "broken", "new", None])])
    got = lookup_competitor(clicks, service, timeout_ms=500, dedupe=dedupe, tasks=2)
    prices = {r.seq: (str(r.price.amount), r.is_error) for r in got.collect()}
    assert prices == {
        0: ("42.00", False), 1: ("42.00", False), 2: ("0.00", True), 3: ("0.00", True), 4: ("0.00", False), 5: ("0.00", True),
    }


def test_errors_can_leave_the_last_price(rows):
    clicks = rows(CLICK, ("a", 0.0, 0), ("broken", 1.0, 1))
    got = lookup_competitor(clicks, service, on_error="keep_last")
    assert [r.seq for r in got.collect()] == [0]


def test_capacity_bounds_the_calls_in_flight(rows, tmp_path):
    folder = str(tmp_path)

    def counted(product):
        import os
        import tempfile

        handle, name = tempfile.mkstemp(dir=folder, prefix="busy")
        os.close(handle)
        busy = len(os.listdir(folder))
        time.sleep(0.02)
        os.unlink(name)
        return (200, f'{{"price": {busy}}}')

    clicks = rows(CLICK, *[(str(i), float(i), i) for i in range(40)]).coalesce(1)
    got = lookup_competitor(clicks, counted, capacity=4, dedupe=False)
    assert 1 <= max(r.price.amount for r in got.collect()) <= 4


def test_table_of_answers(rows, spark):
    clicks = rows(CLICK, ("a", 0.0, 0), ("b", 1.0, 1), ("c", 2.0, 2))
    answers = spark.createDataFrame(
        [("a", 200, '{"price": 1.5}'), ("b", None, None)], "product_id string, status int, body string"
    )
    got = {r.seq: (str(r.price.amount), r.is_error) for r in lookup_competitor_table(clicks, answers).collect()}
    assert got == {0: ("1.50", False), 1: ("0.00", True), 2: ("0.00", False)}


def hung(product):
    if product.startswith("hung"):
        time.sleep(6)
    return 200, '{"price": 7.0}'


@pytest.mark.parametrize("count, answered", [(3, True), (4, False)])
def test_hung_calls_cost_others_bounded_time(rows, count, answered):
    """With a place left the others are served through it; with none left they get an error soon."""
    names = [f"hung{i}" for i in range(count)] + [f"ok{i}" for i in range(8)]
    clicks = rows(CLICK, *[(name, 0.0, i) for i, name in enumerate(names)]).coalesce(1)
    got = lookup_competitor(clicks, hung, timeout_ms=1000, capacity=4, dedupe=False)
    began = time.monotonic()
    failed = {r.product_id: r.is_error for r in got.collect()}
    assert failed == {name: name.startswith("hung") or not answered for name in names}
    assert time.monotonic() - began < 5


def test_late_calls_keep_their_places():
    """A service that only gets slower never has more calls to answer than there are places."""
    alive, most, lock = 0, 0, threading.Lock()

    def slow(product):
        nonlocal alive, most
        with lock:
            alive += 1
            most = max(most, alive)
        time.sleep(1.0)
        with lock:
            alive -= 1
        return 200, "{}"

    places = lookup._Places(4)
    began = time.monotonic()
    answers = lookup._fetch_all([str(i) for i in range(40)], slow, 0.2, places)
    assert set(answers.values()) == {(None, None)} and len(answers) == 40 and time.monotonic() - began < 0.9
    # while all hang, a later batch is answered at once
    again = time.monotonic()
    assert set(lookup._fetch_all(["a", "b"], slow, 0.2, places).values()) == {(None, None)} and time.monotonic() - again < 0.1
    time.sleep(1.2)
    assert lookup._fetch_all(["c"], lambda product: (200, product), 0.2, places) == {"c": (200, "c")}
    assert most == 4 and places.alive == 0


def test_places_outlive_the_batch(rows, spark):
    """The second batch of a task finds the places of the first one's late calls taken."""
    clicks = rows(CLICK, *[(f"hung{i}", float(i), i) for i in range(6)], ("ok", 9.0, 9)).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = lookup_competitor(clicks, hung, timeout_ms=400, capacity=2, dedupe=False)
        began = time.monotonic()
        assert {r.is_error for r in got.collect()} == {True} and time.monotonic() - began < 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_click_gets_one_price_of_several_answers(spark, rows):
    clicks = rows(CLICK, ("a", 0.0, 0), ("b", 1.0, 1))
    answers = spark.createDataFrame(
        [("a", 1, 200, '{"price": 1}'), ("a", 3, 200, '{"price": 3}'), ("a", 2, 500, None)], "product_id string, t long, status int, body string"
    ).selectExpr("product_id", "timestamp_seconds(t) ts", "status", "body")
    for table, price in [(answers, "3.00"), (answers.drop("ts"), "0.00")]:
        got = {r.seq: str(r.price.amount) for r in lookup_competitor_table(clicks, table).collect()}
        assert got == {0: price, 1: "0.00"}
