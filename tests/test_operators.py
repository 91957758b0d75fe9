from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from repricer.operators.demand import demand_metrics, sliding_rate
from repricer.operators.eventlog import as_update, event_log, metric_union
from repricer.operators.model import attach_model, score
from repricer.operators.pricing import currency_mismatches, price_alerts, price_batch, priced_rows
from repricer.operators.state import inactivity_resets, pricing_context, state_asof, with_defaults
from repricer.operators.surge import surge_adjustments, surge_runs
from repricer.schemas import MODEL

CLICK = "product_id string, product_name string, t double, seq bigint"
TEN = [0, 5, 10, 15, 20, 25, 30, 35, 40, 43]


def clicks_at(rows, *times, product="p", name="n"):
    return rows(CLICK, *[(product, name, float(t), i) for i, t in enumerate(times)])


def test_demand_of_ten_clicks(rows, second):
    got = demand_metrics(clicks_at(rows, *TEN)).selectExpr(
        "product_name", second("short_end"), second("long_end"), "current_demand", "historical_average"
    )
    assert sorted(map(tuple, got.collect())) == [("n", s, 300, 2.0, 10 / 60) for s in (180, 240, 300)]


def test_window_name_is_the_earliest_clicks(rows):
    clicks = rows(CLICK, ("p", "late", 20.0, 1), ("p", "early", 10.0, 2), ("p", "late", 70.0, 3))
    names = {r.window_end.minute: r.product_name for r in sliding_rate(clicks).collect()}
    assert names[1] == "early" and names[5] == "early" and names[6] == "late"
    paired = {r.short_end.minute: (r.product_name, r.current_demand) for r in demand_metrics(clicks).collect()}
    assert paired[5] == ("early", 0.6) and paired[6] == ("late", 0.2)


def _pairs_by_search(times, slide, tolerance):
    """The interval join by trying every pair of windows."""
    def windows(size, step):
        ends = {(int(t) // step + 1 + k) * step for t in times for k in range(size // step)}
        return {e: sum(e - size <= t < e for t in times) for e in ends}
    short, long = windows(300, 60), windows(3600, slide)
    return sorted(
        (s, l, short[s] / 5, long[l] / 60) for s in short for l in long
        if short[s] and long[l] and abs(l - s) <= tolerance
    )


@pytest.mark.parametrize("slide, tolerance", [(300, 150), (300, 120), (300, 300), (600, 60), (60, 60)])
def test_demand_pairs_equal_a_search_over_all_windows(rows, second, slide, tolerance):
    times = [0, 30, 299, 300, 301, 1790, 3599, 3600, 7199, 86_390, 86_399, 86_401, 90_000]
    got = demand_metrics(
        clicks_at(rows, *times), long=("1 hour", f"{slide} seconds"), tolerance=f"{tolerance} seconds"
    ).selectExpr(second("short_end"), second("long_end"), "current_demand", "historical_average")
    assert sorted(map(tuple, got.collect())) == _pairs_by_search(times, slide, tolerance)


def test_unaligned_grids_are_refused(rows):
    with pytest.raises(ValueError):
        demand_metrics(clicks_at(rows, 0), long=("1 hour", "90 seconds"))


def surges(rows, times, **options):
    return surge_runs(clicks_at(rows, *times), **options)


def test_surge_counts(rows):
    assert surges(rows, range(1, 11)).count() == 1
    assert surges(rows, [i * 1.5 for i in range(12)]).count() == 3
    nine = [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert surges(rows, nine + [60.0]).count() == 0
    assert surges(rows, nine + [59.999]).count() == 1


def test_surge_across_slices_and_names(rows, second):
    times = [3590 + 2 * i for i in range(12)]
    orders = rows(CLICK, *[("p", f"n{i}", float(t), i) for i, t in enumerate(times)])
    got = surge_runs(orders, slice_width="1 minute").selectExpr("product_name", second("first_ts"), second("ts"))
    expected = [(f"n{i}", times[i], times[i + 9]) for i in range(3)]
    assert sorted(map(tuple, got.collect())) == expected
    assert {r.adjustment_factor for r in surge_adjustments(surge_runs(orders)).collect()} == {1.2}


@pytest.mark.parametrize("width", ["1 second", "7 seconds", "30 seconds", "1 hour"])
def test_runs_do_not_depend_on_the_slices(rows, width):
    times = [t for start in (0, 40, 55, 300, 320) for t in range(start, start + 9, 2)] + [900 + 6.5 * i for i in range(12)]
    ordered = sorted(times)
    got = surges(rows, ordered, slice_width=width)
    runs = [(i, i + 9) for i in range(len(ordered) - 9) if ordered[i + 9] - ordered[i] < 60]
    assert sorted(r.seq for r in got.collect()) == [last for _, last in runs]


def test_resets(rows, second):
    def resets(*times, **options):
        got = inactivity_resets(clicks_at(rows, *times), **options).selectExpr(second("ts"), "seq")
        return sorted(map(tuple, got.collect()))

    assert resets(0, 360) == [(300, 0), (660, 1)]
    assert resets(0, 360, close_tail=False) == [(300, 0)]
    assert resets(0, 300, close_tail=False) == []
    assert resets(0, 300.001, close_tail=False) == [(300, 0)]
    assert resets(0, 10, 50_000, 50_010, slice_width="1 minute") == [(310, 1), (50_310, 3)]


# --- state and pricing over one small event log -------------------------------------------

UPDATES = {
    "DEMAND": "product_id string, product_name string, t double, seq bigint, current_demand double, historical_average double",
    "INVENTORY": "product_id string, product_name string, t double, seq bigint, quantity int",
    "COMPETITOR": "product_id string, product_name string, t double, seq bigint, price struct<amount: decimal(18,2), currency: string>",
    "RULE": "product_id string, product_name string, t double, seq bigint, "
    "min_price struct<amount: decimal(18,2), currency: string>, max_price struct<amount: decimal(18,2), currency: string>",
    "EMERGENCY": "product_id string, product_name string, t double, seq bigint, adjustment_factor double",
    "RESET": "product_id string, product_name string, t double, seq bigint",
}


def money(text, currency="EUR"):
    return (Decimal(text), currency)


@pytest.fixture
def log(rows):
    def make(clicks=(), **updates):
        clicked = rows(CLICK, *[("p", "n", float(t), i) for i, t in enumerate(clicks)])
        kinds = {
            kind: [("p", "n", float(t), 100 + i, *values) for i, (t, *values) in enumerate(updates.get(kind, []))]
            for kind in UPDATES
        }
        return event_log(
            clicked, metric_union(*[as_update(rows(UPDATES[k], *v), k) for k, v in kinds.items()])
        )

    return make


@pytest.fixture
def registry(rows):
    def make(*versions):
        fields = "model_id string, t double, kind string, bias decimal(18,4), w_inventory decimal(10,4), w_demand decimal(10,4), w_competitor decimal(10,4), artifact_uri string"
        df = rows(
            fields,
            *[
                (name, float(t), "linear", Decimal(bias), Decimal(0), Decimal(0), Decimal(0), None)
                for name, t, bias in versions
            ],
        )
        return df.withColumnRenamed("ts", "effective_ts").select(*[f.split()[0] for f in MODEL.split(", ")])

    return make


def test_defaults_when_nothing_is_known(log):
    row = pricing_context(log(clicks=[0])).first()
    assert (row.current_demand, row.historical_average, row.inventory_level) == (0.0, 0.0, 0)
    assert tuple(row.competitor_price) == money("0.00")
    assert row.price_rule is None and row.adjustment_factor == 1.0


@pytest.mark.parametrize("width", ["1 minute", "7 minutes", "1 hour", "10 days"])
def test_state_does_not_depend_on_the_slices(log, second, width):
    events = log(
        clicks=[10, 100, 700, 5000],
        INVENTORY=[(5, 7), (650, 20)],
        DEMAND=[(60, 2.0, 1.0)],
        COMPETITOR=[(61, money("3.00"))],
        RULE=[(90, money("1.00"), money("9.00"))],
        EMERGENCY=[(600, 1.2)],
        RESET=[(1000,)],
    )
    got = pricing_context(events, slice_width=width).selectExpr(
        second("ts"), "metric_type", "inventory_level", "current_demand",
        "cast(competitor_price.amount as string)", "price_rule.max_price.amount IS NOT NULL", "adjustment_factor",
    )
    assert sorted(map(tuple, got.collect())) == [
        (5, "INVENTORY", 7, 0.0, "0.00", False, 1.0),
        (10, "CLICK", 7, 0.0, "0.00", False, 1.0),
        (90, "RULE", 7, 2.0, "3.00", True, 1.0),
        (100, "CLICK", 7, 2.0, "3.00", True, 1.0),
        (600, "EMERGENCY", 7, 2.0, "3.00", True, 1.2),
        (650, "INVENTORY", 20, 2.0, "3.00", True, 1.2),
        (700, "CLICK", 20, 2.0, "3.00", True, 1.2),
        (1000, "RESET", 20, 0.0, "3.00", True, 1.2),
        (5000, "CLICK", 20, 0.0, "3.00", True, 1.0),
    ]


def test_updates_without_trigger_give_no_price(log):
    assert pricing_context(log(DEMAND=[(0, 1.0, 1.0)], COMPETITOR=[(1, money("1.00"))])).count() == 0


@pytest.mark.parametrize("click, factor", [(599.999, 1.2), (600.0, 1.0)])
def test_surge_factor_expires(log, click, factor):
    context = pricing_context(log(clicks=[click], EMERGENCY=[(0, 1.2)]), slice_width="1 minute")
    assert context.where("metric_type = 'CLICK'").first().adjustment_factor == factor


def test_surge_factor_is_refreshed_by_a_newer_one(log):
    context = pricing_context(log(clicks=[900], EMERGENCY=[(0, 1.2), (540, 1.2)]), slice_width="1 minute")
    assert context.where("metric_type = 'CLICK'").first().adjustment_factor == 1.2


def test_rule_bounds_come_from_one_update(log):
    events = log(clicks=[10], RULE=[(0, money("1.00"), money("9.00")), (5, None, None)])
    last = with_defaults(state_asof(events)).where("metric_type = 'CLICK'").first()
    assert last.price_rule.min_price is None and last.price_rule.max_price is None


def test_model_versions(rows, registry, second):
    day = 86_400
    events = rows("seq int, t double", *[(i, float(t)) for i, t in enumerate([0, 10, 19, 20, day, 3 * day, 99 * day])])
    versions = registry(("a", 10, "1"), ("b", 20, "1"), ("c", 20, "1"), ("d", 3 * day, "1"))
    got = attach_model(events, versions).select("seq", "model.model_id").collect()
    assert dict(map(tuple, got)) == {0: None, 1: "a", 2: "a", 3: "c", 4: "c", 5: "d", 6: "d"}


def test_injected_scorer(log, registry):
    def scorer(features):
        return features["inventory_level"] + 0.125 + features["competitor_price"] * 0

    context = pricing_context(log(INVENTORY=[(5, 7)]))
    scored = score(context, registry(("a", 0, "1")), scorer=scorer)
    assert scored.first().model_price == Decimal("7.13")


@pytest.mark.parametrize("width", ["1 minute", "1 hour"])
def test_prices_and_alerts(log, registry, second, width):
    events = log(
        clicks=[5, 100, 200, 500],
        INVENTORY=[(1, 50)],
        COMPETITOR=[(90, money("100.00")), (190, money("300.00")), (400, money("0.00"))],
        RESET=[(450,)],
    )
    models = registry(("a", 3, "100"))
    options = {"slice_width": width}
    prices = price_batch(events, models, **options).selectExpr(second("ts"), "cast(new_price.amount as string) AS p")
    # the trigger before the first model has no price
    assert sorted(map(tuple, prices.collect())) == [
        (5, "70.00"), (100, "100.00"), (200, "160.00"), (450, "70.00"), (500, "70.00"),
    ]
    alerts = price_alerts(priced_rows(events, models, **options))
    assert [(r.seq, r.previous_price) for r in alerts.collect()] == [(2, Decimal("100.00"))]


def test_reset_is_previous_price_but_never_alerts(log, registry):
    events = log(
        clicks=[0, 500], INVENTORY=[(400, 50)], COMPETITOR=[(300, money("300.00")), (460, money("0.00"))], RESET=[(450,)],
    )
    priced = priced_rows(events, registry(("a", 0, "10")), slice_width="1 minute")
    assert [r.metric_type for r in priced.orderBy("ts").collect()] == ["CLICK", "INVENTORY", "RESET", "CLICK"]
    assert [r.seq for r in price_alerts(priced).collect()] == [100]


def test_conflicting_currency_is_set_aside(log, registry):
    events = log(clicks=[0, 10], RULE=[(5, money("1.00", "USD"), money("9.00", "USD"))])
    models = registry(("a", 0, "10"))
    assert price_batch(events, models).count() == 1
    kinds = currency_mismatches(events, models).select("metric_type").collect()
    assert sorted(k.metric_type for k in kinds) == ["CLICK", "RULE"]


def test_log_shuffle_is_shared(log, spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = state_asof(log(clicks=[0], INVENTORY=[(1, 2)]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("REPARTITION_BY_COL") == 1 + plan.count("ReusedExchange") and "ReusedExchange" in plan


def test_models_join_alike_broadcast_or_dealt(rows, registry):
    from repricer.operators.model import attach_model

    triggers = rows("product_id string, t double, seq bigint", *[(f"p{i % 5}", 40_000.0 * i - 90_000, i) for i in range(40)])
    models = registry(("a", 0, "10"), ("b", 35_000, "20"), ("c", 200_000, "30"), ("d", 700_000, "40"))

    def joined(**options):
        got = attach_model(triggers, models, **options)
        plan = got._jdf.queryExecution().executedPlan().toString()
        return sorted((r.seq, r.model and r.model.model_id) for r in got.collect()), plan

    small, plan = joined()
    assert "BroadcastHashJoin" in plan
    large, plan = joined(broadcast_rows=1, salts=3)
    assert "held_salt" in plan and small == large and {m for _, m in small} == {None, "a", "b", "c", "d"}


def test_slice_width_by_the_busiest_product(rows):
    from repricer.functions.intervals import slice_width_for

    seconds = 100_000
    clicks = rows("product_id string, t double", *[("hot", float(t)) for t in range(0, seconds, 100)], *[("cold", float(t)) for t in (0, 1)])
    # 1000 rows in 100,000 seconds: 50 of them in 5000 seconds, 9 in 900
    assert slice_width_for(clicks, most=50) == "1 hour" and slice_width_for(clicks, most=9) == "5 minutes"
    assert slice_width_for(clicks, most=1000) == "30 days" and slice_width_for(clicks, most=1) == "1 minute"
    assert slice_width_for(clicks.where("false")) == "30 days"
