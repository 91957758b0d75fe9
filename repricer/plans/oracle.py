"""The registered queries as plain SQL, written from the definitions and not from the plans."""

from __future__ import annotations

# Inputs bound from the sample tables.
_FEEDS = """
ev AS (
  SELECT json_extract_string(e.props, '$.k') AS product_id, p.p_name AS product_name, e.ts,
         e.event_id AS seq, e.event_type, e.value
  FROM events e LEFT JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)
),
clicks AS (SELECT product_id, product_name, ts, seq FROM ev WHERE event_type = 'click'),
orders_in AS (SELECT product_id, product_name, ts, seq FROM ev WHERE event_type = 'purchase')
"""


def _windows(name: str, size: str, slide: str, minutes: int) -> str:
    return f"""
{name} AS (
  SELECT product_id, w AS window_end, count(*) AS clicks, count(*) / {minutes}::DOUBLE AS rate,
         coalesce(arg_min(product_name, {{'ts': ts, 'n': product_name}}), '') AS product_name
  FROM clicks, unnest(range(time_bucket(INTERVAL '{slide}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{slide}',
                            time_bucket(INTERVAL '{slide}', ts, TIMESTAMP '1970-01-01')
                              + INTERVAL '{size}' + INTERVAL '{slide}',
                            INTERVAL '{slide}')) AS t(w)
  GROUP BY product_id, w
)
"""


_SHORT = _windows("short_rate", "5 minutes", "1 minute", 5)
_LONG = _windows("long_rate", "1 hour", "5 minutes", 60)
_DEMAND = f"""{_SHORT}, {_LONG},
demand AS (
  SELECT s.product_id, s.product_name, s.window_end AS short_end, l.window_end AS long_end,
         s.rate AS current_demand, l.rate AS historical_average,
         greatest(s.window_end, l.window_end) AS ts
  FROM short_rate s JOIN long_rate l ON l.product_id = s.product_id
   AND l.window_end BETWEEN s.window_end - INTERVAL '150 seconds' AND s.window_end + INTERVAL '150 seconds'
)
"""
_RUNS = """
runs AS (
  SELECT product_id, first_name AS product_name, first_ts, ts, seq FROM (
    SELECT product_id, ts, seq, lag(ts, 2) OVER w AS first_ts, lag(product_name, 2) OVER w AS first_name
    FROM orders_in WINDOW w AS (PARTITION BY product_id ORDER BY ts, seq)
  ) WHERE ts - first_ts < INTERVAL '24 hours'
)
"""
_RESETS = """
resets AS (
  SELECT product_id, product_name, ts + INTERVAL '1 day' AS ts, seq, ts AS last_click_ts FROM (
    SELECT *, lead(ts) OVER (PARTITION BY product_id ORDER BY ts, seq) AS next_ts FROM clicks
  ) WHERE next_ts IS NULL OR next_ts > ts + INTERVAL '1 day'
)
"""
_NONE = {
    "demand_current_demand": "DOUBLE",
    "demand_historical_average": "DOUBLE",
    "quantity": "INTEGER",
    "competitor_amount": "DECIMAL(18,2)",
    "competitor_currency": "VARCHAR",
    "rule_min_price_amount": "DECIMAL(18,2)",
    "rule_min_price_currency": "VARCHAR",
    "rule_max_price_amount": "DECIMAL(18,2)",
    "rule_max_price_currency": "VARCHAR",
    "emergency_factor": "DOUBLE",
    "emergency_written_at": "TIMESTAMP",
}


def _log_rows(source: str, kind: str, rank: int, seq: str = "seq", **values: str) -> str:
    payload = ", ".join(f"CAST({values.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _NONE.items())
    return (
        f"SELECT product_id, ts, {rank} AS rank, CAST({seq} AS BIGINT) AS seq, '{kind}' AS metric_type, "
        f"product_name, {payload} FROM {source}"
    )


# a competitor price of its own stream, or one looked up for each click
_COMPETITOR = _log_rows(
    "ev WHERE event_type = 'view'", "COMPETITOR", 1, competitor_amount="value", competitor_currency="'EUR'"
)
_LOOKUP = _log_rows(
    "looked_up", "COMPETITOR", 3, competitor_amount="price", competitor_currency="'EUR'"
)


def _updates(
    min_currency: str = "'EUR'", max_currency: str = "'EUR'", competitor: str = _COMPETITOR
) -> str:
    return " UNION ALL ".join(
        [
            _log_rows(
                "demand", "DEMAND", 0, "epoch_us(short_end)",
                demand_current_demand="current_demand", demand_historical_average="historical_average",
            ),
            _log_rows("ev WHERE event_type = 'signup'", "INVENTORY", 1, quantity="floor(value)"),
            competitor,
            _log_rows(
                "ev WHERE event_type = 'error'", "RULE", 1,
                rule_min_price_amount="value", rule_min_price_currency=min_currency,
                rule_max_price_amount="CAST(value AS DECIMAL(18,2)) * 3", rule_max_price_currency=max_currency,
            ),
            _log_rows("runs", "EMERGENCY", 1, emergency_factor="1.2", emergency_written_at="ts"),
        ]
    )


def _log(feeds: str = _FEEDS, more: str = "", **updates: str) -> str:
    return f"""{feeds}, {_DEMAND}, {_RUNS}, {_RESETS},
updates AS ({_updates(**updates)}),
log AS (
  {_log_rows("clicks", "CLICK", 2)}
  UNION ALL SELECT * FROM updates
  UNION ALL {_log_rows("resets", "RESET", 4, demand_current_demand="0.0", demand_historical_average="0.0")}
  {more}
)
"""


# the same streams as they come out of messages: clicks have milliseconds, prices are looked up per click
_DECODED = f"""{_FEEDS.replace("clicks AS (SELECT product_id, product_name, ts, seq", "clicks AS (SELECT product_id, product_name, date_trunc('millisecond', ts) AS ts, seq")},
looked_up AS (
  SELECT c.product_id, '' AS product_name, c.ts, c.seq, coalesce(p.p_retailprice, 0) AS price
  FROM clicks c LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = c.product_id
)
"""
_KEYS = "product_id, ts, rank, seq, metric_type, product_name"
_STATE = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER so_far AS {c}" for c in _NONE if not c.startswith("rule_")
)
# both bounds of a rule come from the same update
_RULE_STATE = ", ".join(f"held_rule.{c} AS {c}" for c in _NONE if c.startswith("rule_"))


def _state(**currencies: str) -> str:
    packed = ", ".join(f"{c} := {c}" for c in _NONE if c.startswith("rule_"))
    return f"""{_log(**currencies)},
held AS (
  SELECT {_KEYS}, {_STATE},
    last_value(CASE WHEN metric_type = 'RULE' THEN struct_pack({packed}) END IGNORE NULLS) OVER so_far AS held_rule
  FROM log
  WINDOW so_far AS (PARTITION BY product_id ORDER BY ts, rank, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
state AS (SELECT * EXCLUDE (held_rule), {_RULE_STATE} FROM held),
context AS (
  SELECT {_KEYS}, coalesce(demand_current_demand, 0.0::DOUBLE) AS current_demand,
    coalesce(demand_historical_average, 0.0::DOUBLE) AS historical_average,
    coalesce(quantity, 0) AS inventory_level,
    coalesce(competitor_amount, 0.00::DECIMAL(18,2)) AS competitor_amount,
    coalesce(competitor_currency, 'EUR') AS competitor_currency,
    rule_min_price_amount, rule_min_price_currency, rule_max_price_amount, rule_max_price_currency,
    CASE WHEN ts < emergency_written_at + INTERVAL '12 hours' THEN emergency_factor ELSE 1.0::DOUBLE END
      AS adjustment_factor
  FROM state WHERE metric_type IN ('CLICK', 'INVENTORY', 'RULE', 'EMERGENCY', 'RESET')
)
"""


# a sale sees what was known before its instant
_EXAMPLES = f"""{_state(more="UNION ALL " + _log_rows("orders_in", "SALE", -1))},
examples AS (
  SELECT s.product_id, s.ts, s.seq, coalesce(demand_current_demand, 0.0::DOUBLE) AS current_demand,
    coalesce(demand_historical_average, 0.0::DOUBLE) AS historical_average,
    coalesce(quantity, 0) AS inventory_level,
    coalesce(competitor_amount, 0.00::DECIMAL(18,2)) AS competitor_amount,
    coalesce(competitor_currency, 'EUR') AS competitor_currency,
    rule_min_price_amount, rule_min_price_currency, rule_max_price_amount, rule_max_price_currency,
    CASE WHEN s.ts < emergency_written_at + INTERVAL '12 hours' THEN emergency_factor ELSE 1.0::DOUBLE END
      AS adjustment_factor,
    CAST(e.value AS DECIMAL(18,2)) AS label
  FROM state s JOIN ev e ON e.seq = s.seq WHERE metric_type = 'SALE'
)
"""
_REGISTRY = """
registry AS (
  SELECT 'week-' || (wk::BIGINT)::VARCHAR AS model_id,
    make_timestamp((wk::BIGINT + 1) * 604800000000) AS effective_ts,
    CAST(cents // n AS DECIMAL(18,2)) * 0.01::DECIMAL(3,2) AS bias
  FROM (
    SELECT epoch_us(ts) // 604800000000 AS wk,
      sum((CAST(value AS DECIMAL(18,2)) * 100)::BIGINT)::BIGINT AS cents, count(*) AS n
    FROM events WHERE event_type = 'view' GROUP BY 1
  )
)
"""


def _money(expression: str) -> str:
    return f"CAST(round({expression}, 2) AS DECIMAL(18,2))"


_MODEL_PRICE = _money('''CAST(r.bias AS DECIMAL(18,4)) + CAST(-0.05 AS DECIMAL(10,4)) * CAST(c.inventory_level AS DECIMAL(10,0))
      + CAST(0.75 AS DECIMAL(10,4)) * CAST(c.current_demand AS DECIMAL(18,4))
      + CAST(0.4 AS DECIMAL(10,4)) * c.competitor_amount''')


def _priced(**currencies: str) -> str:
    return f"""{_state(**currencies)}, {_REGISTRY},
scored AS (
  SELECT c.*, r.model_id,
    {_MODEL_PRICE} AS model_price
  FROM context c ASOF JOIN registry r ON c.ts >= r.effective_ts
),
s1 AS (SELECT *, CAST({_money("model_price * CAST(0.7 AS DECIMAL(2,1))")}
    + {_money("competitor_amount * CAST(0.3 AS DECIMAL(2,1))")} AS DECIMAL(18,2)) AS blended FROM scored),
s2 AS (SELECT *, CASE WHEN current_demand > historical_average
    THEN {_money("blended * CAST(1.05 AS DECIMAL(3,2))")} ELSE blended END AS after_demand FROM s1),
s3 AS (SELECT *, CASE WHEN inventory_level < 10
    THEN {_money("after_demand * CAST(1.1 AS DECIMAL(2,1))")} ELSE after_demand END AS after_stock FROM s2),
s4 AS (SELECT *, CASE WHEN adjustment_factor > 1.0
    THEN {_money("after_stock * CAST(adjustment_factor AS DECIMAL(10,6))")} ELSE after_stock END AS after_surge FROM s3),
priced AS (SELECT *,
    CASE WHEN after_surge < rule_min_price_amount THEN rule_min_price_amount
         WHEN after_surge > rule_max_price_amount THEN rule_max_price_amount
         ELSE after_surge END AS new_price,
    coalesce(rule_min_price_currency, 'EUR') AS currency,
    coalesce(rule_min_price_currency, 'EUR') <> competitor_currency
      OR (rule_max_price_amount IS NOT NULL AND after_surge >= rule_min_price_amount
          AND rule_max_price_currency <> rule_min_price_currency) AS is_conflict
  FROM s4)
"""


_ALERTS = f"""{_priced()},
emitted AS (
  SELECT *, lag(new_price) OVER (PARTITION BY product_id ORDER BY ts, rank, seq) AS previous_price
  FROM priced WHERE NOT is_conflict
),
alerts AS (
  SELECT * FROM emitted
  WHERE metric_type <> 'RESET' AND (
    (previous_price > 0 AND new_price - previous_price >= CAST(0.505 AS DECIMAL(3,3)) * previous_price)
    OR (previous_price < 0 AND new_price - previous_price <= CAST(0.505 AS DECIMAL(3,3)) * previous_price))
)
"""
_RESULT = """product_id, product_name, new_price::DOUBLE AS new_price_amount, currency AS new_price_currency,
  model_price::DOUBLE AS model_prediction_amount, currency AS model_prediction_currency,
  ts, inventory_level, current_demand"""


def _typed(columns: str = "*") -> str:
    """Log or state rows with amounts as doubles."""
    amounts = [c for c, t in _NONE.items() if t.startswith("DECIMAL")]
    return f"{columns} REPLACE (" + ", ".join(f"{c}::DOUBLE AS {c}" for c in amounts) + ")"


ORACLE: dict[str, str] = {
    "decode_clicks": f"WITH {_FEEDS} SELECT product_id, product_name, date_trunc('millisecond', ts) AS ts, seq FROM clicks",
    "decode_orders": f"""WITH {_FEEDS} SELECT CAST(seq AS VARCHAR) AS order_id, product_id, product_name,
        CAST(floor(value) AS INTEGER) AS quantity, date_trunc('millisecond', ts) AS order_ts, ts, seq
        FROM ev WHERE event_type = 'purchase'""",
    "decode_inventory": f"""WITH {_FEEDS} SELECT product_id, product_name,
        CAST(floor(value) AS INTEGER) AS quantity, ts, seq FROM ev WHERE event_type = 'signup'""",
    "decode_rules": f"""WITH {_FEEDS} SELECT product_id, product_name,
        CAST(value AS DECIMAL(18,2))::DOUBLE AS min_price_amount, 'EUR' AS min_price_currency,
        (CAST(value AS DECIMAL(18,2)) * 3)::DOUBLE AS max_price_amount, 'EUR' AS max_price_currency, ts, seq
        FROM ev WHERE event_type = 'error'""",
    "decode_quarantine": """
        SELECT CASE event_type WHEN 'click' THEN 'malformed' WHEN 'view' THEN 'unknown_field'
                 WHEN 'error' THEN 'wrong_type' ELSE 'accepted' END AS reason,
          CASE event_type WHEN 'signup' THEN true WHEN 'purchase' THEN false END AS without_name,
          count(*) AS messages,
          CAST(sum(CASE WHEN event_type = 'purchase' THEN floor(value) ELSE 0 END) AS BIGINT) AS quantity
        FROM events GROUP BY 1, 2""",
    "demand_short": f"""WITH {_FEEDS}, {_SHORT} SELECT product_id, product_name,
        window_end - INTERVAL '5 minutes' AS window_start, window_end, clicks, rate FROM short_rate""",
    "demand_long": f"""WITH {_FEEDS}, {_LONG} SELECT product_id, product_name,
        window_end - INTERVAL '1 hour' AS window_start, window_end, clicks, rate FROM long_rate""",
    "demand_metrics": f"WITH {_FEEDS}, {_DEMAND} SELECT * FROM demand",
    "surge_runs": f"WITH {_FEEDS}, {_RUNS} SELECT * FROM runs",
    "surge_runs_lines": """
        SELECT product_id, first_ts, ts, seq FROM (
          SELECT CAST(l_partkey AS VARCHAR) AS product_id, o_orderdate AS ts,
            l_orderkey * 100 + l_linenumber AS seq, lag(o_orderdate, 2) OVER (
              PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey * 100 + l_linenumber) AS first_ts
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        ) WHERE ts - first_ts < INTERVAL '90 days'""",
    "surge_adjustments": f"""WITH {_FEEDS}, {_RUNS}
        SELECT product_id, product_name, 1.2::DOUBLE AS adjustment_factor, ts, seq FROM runs""",
    "competitor_lookup": f"""WITH {_FEEDS}
        SELECT c.product_id, '' AS product_name, c.ts, c.seq,
          coalesce(CAST(p.p_retailprice AS DECIMAL(18,2)), 0)::DOUBLE AS price_amount, 'EUR' AS price_currency,
          false AS is_error
        FROM clicks c LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = c.product_id""",
    "competitor_parse": f"""WITH {_FEEDS}
        SELECT seq, product_id, CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END::DOUBLE
            AS price_amount, 'EUR' AS price_currency, event_type IN ('error', 'purchase', 'signup') AS is_error
        FROM ev""",
    "metric_union": f"WITH {_log()} SELECT {_typed()} FROM updates",
    "event_log": f"WITH {_log()} SELECT {_typed()} FROM log",
    "price_triggers": f"""WITH {_log()} SELECT {_KEYS} FROM log
        WHERE metric_type NOT IN ('DEMAND', 'COMPETITOR')""",
    "inactivity_resets": f"WITH {_FEEDS}, {_RESETS} SELECT * FROM resets",
    "inactivity_resets_tail": f"""WITH {_FEEDS}
        SELECT product_id, product_name, ts + INTERVAL '5 minutes' AS ts, seq, ts AS last_click_ts FROM clicks c
        WHERE NOT EXISTS (SELECT 1 FROM clicks n WHERE n.product_id = c.product_id AND n.seq <> c.seq
          AND (n.ts > c.ts OR (n.ts = c.ts AND n.seq > c.seq)) AND n.ts <= c.ts + INTERVAL '5 minutes')""",
    "state_asof": f"WITH {_state()} SELECT {_typed()} FROM state",
    "emergency_ttl": f"WITH {_state()} SELECT product_id, ts, rank, seq, adjustment_factor FROM context",
    "pricing_context": f"""WITH {_state()} SELECT {_KEYS}, current_demand, historical_average, inventory_level,
        competitor_amount::DOUBLE AS competitor_price_amount, competitor_currency AS competitor_price_currency,
        rule_min_price_amount::DOUBLE AS price_rule_min_price_amount,
        rule_min_price_currency AS price_rule_min_price_currency,
        rule_max_price_amount::DOUBLE AS price_rule_max_price_amount,
        rule_max_price_currency AS price_rule_max_price_currency, adjustment_factor FROM context""",
    "model_asof": f"""WITH {_FEEDS}, {_REGISTRY}
        SELECT e.seq, e.ts, e.product_id, r.model_id, r.effective_ts, r.bias::DOUBLE AS bias
        FROM ev e ASOF LEFT JOIN registry r ON e.ts >= r.effective_ts""",
    "model_score": f"""WITH {_priced()} SELECT product_id, ts, rank, seq, model_id,
        model_price::DOUBLE AS model_price FROM scored""",
    "price_steps": f"""WITH {_priced()} SELECT product_id, ts, rank, seq, model_price::DOUBLE AS model_price,
        blended::DOUBLE AS blended, after_demand::DOUBLE AS after_demand, after_stock::DOUBLE AS after_stock,
        after_surge::DOUBLE AS after_surge, new_price::DOUBLE AS new_price FROM priced""",
    "reprice": f"WITH {_priced()} SELECT {_RESULT} FROM priced WHERE NOT is_conflict",
    "reprice_from_messages": f"""WITH {_priced(feeds=_DECODED, competitor=_LOOKUP)}
        SELECT {_RESULT} FROM priced WHERE NOT is_conflict""",
    "training_set": f"""WITH {_EXAMPLES} SELECT product_id, ts, seq, current_demand, historical_average, inventory_level,
        competitor_amount::DOUBLE AS competitor_price_amount, competitor_currency AS competitor_price_currency,
        rule_min_price_amount::DOUBLE AS price_rule_min_price_amount,
        rule_min_price_currency AS price_rule_min_price_currency,
        rule_max_price_amount::DOUBLE AS price_rule_max_price_amount,
        rule_max_price_currency AS price_rule_max_price_currency, adjustment_factor, label::DOUBLE AS label
        FROM examples""",
    "model_eval": f"""WITH {_EXAMPLES}, {_REGISTRY}, scored AS (
        SELECT c.*, r.model_id, {_MODEL_PRICE} AS model_price
        FROM examples c ASOF JOIN registry r ON c.ts >= r.effective_ts)
        SELECT model_id, count(*) AS examples,
          sum(CAST((model_price - label) * (model_price - label) AS DECIMAL(30,4)))::DOUBLE / count(*) AS mse,
          sum(CAST(CASE WHEN label <> 0 THEN abs((model_price - label)::DOUBLE / label::DOUBLE) END AS DECIMAL(18,8)))::DOUBLE
            / count(*) FILTER (label <> 0) * 100 AS mape
        FROM scored GROUP BY model_id""",
    "product_effects": f"""WITH {_EXAMPLES}, {_REGISTRY}, scored AS (
        SELECT c.product_id, c.label, r.model_id, {_MODEL_PRICE} AS model_price
        FROM examples c ASOF JOIN registry r ON c.ts >= r.effective_ts),
        sums AS (SELECT model_id, product_id, count(*) AS examples, CAST(sum(CAST((label - model_price) * 100 AS BIGINT)) AS BIGINT) AS cents
            FROM scored WHERE label IS NOT NULL GROUP BY model_id, product_id)
        SELECT model_id, product_id, examples,
          sign(cents) * ((abs(cents) * 200 + examples + 5) // (2 * (examples + 5)))::DOUBLE / 10000 AS effect FROM sums""",
    "price_alerts": f"""WITH {_ALERTS} SELECT {_RESULT}, previous_price::DOUBLE AS previous_price, seq FROM alerts""",
    "alert_text": f"""WITH {_ALERTS}, texts AS (
        SELECT 'ALERT: price jump for ' || product_id || ' new=Money(amount=' || CAST(new_price AS VARCHAR)
          || ', currency=' || currency || ')' AS t FROM alerts)
        SELECT t AS key, t AS value FROM texts""",
    "encode_result": f"""WITH {_priced()} SELECT product_id AS key,
        '{{"productId":"' || product_id || '","productName":"' || product_name
        || '","newPrice":{{"amount":' || CAST(new_price AS VARCHAR) || ',"currency":"' || currency
        || '"}},"modelPrediction":{{"amount":' || CAST(model_price AS VARCHAR) || ',"currency":"' || currency
        || '"}},"timestamp":' || CAST(epoch_us(ts) // 1000 AS VARCHAR)
        || ',"inventoryLevel":' || CAST(inventory_level AS VARCHAR)
        || ',"currentDemand":' || CAST(current_demand AS VARCHAR) || '}}' AS value
        FROM priced WHERE NOT is_conflict""",
    "currency_mismatch": f"""WITH {_priced(
        min_currency="CASE WHEN value >= 100 THEN 'USD' ELSE 'EUR' END",
        max_currency="CASE WHEN value >= 50 THEN 'USD' ELSE 'EUR' END",
    )} SELECT product_id, ts, seq, metric_type, rule_min_price_currency AS min_currency,
        rule_max_price_currency AS max_currency, competitor_currency FROM priced WHERE is_conflict""",
    "money_ops": """
        WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS a,
          CAST(l_quantity AS DECIMAL(18,2)) AS b, CAST(l_tax AS DECIMAL(10,6)) AS f FROM lineitem),
        c AS (SELECT *, CAST(a * 100 AS HUGEINT) AS ac, CAST(b * 100 AS HUGEINT) AS bc FROM l)
        SELECT l_orderkey, l_linenumber, a::DOUBLE AS amount, (a + b)::DOUBLE AS added,
          (b - a)::DOUBLE AS subtracted,
          CASE WHEN bc <> 0 THEN CAST((200 * ac + bc) // (2 * bc) AS DOUBLE) / 100 END AS divided,
          abs(b - a)::DOUBLE AS absolute, round(a * f, 2)::DOUBLE AS multiplied, a < b AS is_less, a > b AS is_greater
        FROM c""",
}
