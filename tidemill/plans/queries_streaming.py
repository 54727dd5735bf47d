"""Registered queries: windowed KPIs in batch, and the same on streams drained to a table.

A stream emits a window when the watermark has passed its end, so the SQL of a drained stream keeps
the windows that end at or before the last event's time less the delay.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.scalars import lookup
from tidemill.operators import fraud, joins
from tidemill.plans.bindings import BEHAVIOR, CHANNELS, behavior
from tidemill.plans.registry import query
from tidemill.sources import readers
from tidemill.sources.tablestore import TableStore
from tidemill.streaming import aggregations as ag
from tidemill.streaming import detection, runs

SALES = f"{BEHAVIOR}, sales AS (SELECT event_id, ts, channel AS location, value AS amount, k % 7 + 1 AS quantity, user_id AS customer_id, CASE WHEN k % 3 = 0 THEN 'credit_card' ELSE 'paypal' END AS payment_method, CASE WHEN value > 100 THEN 3 ELSE 0 END AS risk, product_id, event_type AS category FROM behavior)"


def as_sales(b):
    return b.select(
        "event_id", "ts", F.col("channel").alias("location"), F.col("value").alias("amount"), (F.col("k") % 7 + 1).alias("quantity"), F.col("user_id").alias("customer_id"), F.when(F.col("k") % 3 == 0, "credit_card").otherwise("paypal").alias("payment_method"),
        F.when(F.col("value") > 100, 3).otherwise(0).alias("risk"), "product_id", F.col("event_type").alias("category"),
    )


def streamed(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    made = runs.stream_table(spark, sf, "events", "ts")
    return made.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), F.get(F.array(*map(F.lit, CHANNELS)), k % 9).alias("channel"), (k % 5).alias("product_id"))


def r(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


def sliding(table: str, hours: int, slide: int) -> str:
    """Rows once for each window of `hours` that slides by `slide` hours."""
    return f"(SELECT *, time_bucket(INTERVAL {slide} HOUR, ts, TIMESTAMP '2000-01-01') - to_hours(CAST(i * {slide} AS INTEGER)) AS ws FROM {table}, range({hours // slide}) t(i))"


KPI = f"""WITH {SALES} SELECT ws AS window_start, ws + INTERVAL 6 HOUR AS window_end, location, count(*) AS transactions, round(sum(amount), 6) AS revenue, round(avg(amount), 6) AS avg_order_value, max(amount) AS max_order, min(amount) AS min_order, count(DISTINCT customer_id) AS customers, CAST(sum(quantity) AS BIGINT) AS items,
  count(*) FILTER (WHERE risk >= 3) AS high_risk, count(*) FILTER (WHERE payment_method = 'credit_card') AS credit_card, round(sum(amount) / count(DISTINCT customer_id), 6) AS revenue_per_customer, round(sum(quantity) / count(*), 6) AS items_per_order,
  round(100 * count(*) FILTER (WHERE risk >= 3) / count(*), 6) AS high_risk_pct, round(100 * count(*) FILTER (WHERE payment_method = 'credit_card') / count(*), 6) AS credit_card_pct FROM {sliding("sales", 6, 2)} GROUP BY ws, location"""


@query(KPI)
def events_sliding_kpis(spark, sf):
    return r(ag.kpis(as_sales(behavior(spark, sf)), "6 hours", "2 hours"), "revenue", "avg_order_value", "revenue_per_customer", "items_per_order", "high_risk_pct", "credit_card_pct")


DONE = "ws + INTERVAL {} HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 MINUTE"


@query(f"WITH {SALES} SELECT ws AS window_start, location, count(*) AS transactions, round(sum(amount), 6) AS revenue, CAST(sum(quantity) AS BIGINT) AS items FROM {sliding('sales', 6, 2)} WHERE {DONE.format(6)} GROUP BY ws, location")
def stream_sliding_kpis(spark, sf):
    made = runs.drain(ag.kpis(as_sales(streamed(spark, sf)), "6 hours", "2 hours", streaming=True), "kpis")
    return r(made, "revenue").select("window_start", "location", "transactions", "revenue", "items")


BEH = f"""SELECT ws AS window_start, user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'signup') AS signups, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(sum(value), 6) AS value,
  round(count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 6) AS conversion_rate, CASE WHEN count(*) >= 20 THEN 'Very High' WHEN count(*) >= 10 THEN 'High' WHEN count(*) >= 5 THEN 'Medium' ELSE 'Low' END AS activity_intensity FROM {sliding("behavior", 24, 12)}"""
COLS = ["window_start", "user_id", "events", "views", "clicks", "signups", "purchases", "value", "conversion_rate", "activity_intensity"]


@query(f"WITH {BEHAVIOR} {BEH} GROUP BY ws, user_id")
def events_behavior_aggregations(spark, sf):
    return r(ag.behavior(behavior(spark, sf), "24 hours", "12 hours"), "value", "conversion_rate").select(*COLS)


@query(f"WITH {BEHAVIOR} {BEH} WHERE ws + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 3 MINUTE GROUP BY ws, user_id")
def stream_behavior_aggregations(spark, sf):
    return r(runs.drain(ag.behavior(streamed(spark, sf), "24 hours", "12 hours", streaming=True), "behavior"), "value", "conversion_rate").select(*COLS)


@query(f"""WITH {SALES} SELECT ws AS window_start, product_id, category, CAST(sum(quantity) AS BIGINT) AS units, round(sum(amount), 6) AS revenue, count(DISTINCT customer_id) AS buyers, count(*) AS orders, CASE WHEN sum(quantity) >= 50 THEN 'Fast' WHEN sum(quantity) >= 20 THEN 'Medium' WHEN sum(quantity) >= 5 THEN 'Slow' ELSE 'Very Slow' END AS velocity_category FROM {sliding("sales", 24, 6)} GROUP BY ws, product_id, category""")
def events_product_performance(spark, sf):
    return r(ag.products(as_sales(behavior(spark, sf)), "24 hours", "6 hours"), "revenue").select("window_start", "product_id", "category", "units", "revenue", "buyers", "orders", "velocity_category")


def scored(b):
    return b.withColumn("engagement_score", lookup(F.col("event_type"), {"purchase": 100, "click": 60, "view": 20}, 10))


SCORED = f"{BEHAVIOR}, sc AS (SELECT *, CASE event_type WHEN 'purchase' THEN 100 WHEN 'click' THEN 60 WHEN 'view' THEN 20 ELSE 10 END AS e FROM behavior)"
METRICS = "count(*) AS events, CAST(sum(e) AS BIGINT) AS engagement, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS duration_seconds, CASE WHEN sum(e) >= 300 THEN 'Excellent' WHEN sum(e) >= 150 THEN 'Good' WHEN sum(e) >= 50 THEN 'Fair' ELSE 'Poor' END AS session_quality, arg_min(event_type, {'t': ts, 'i': event_id}) || ' -> ' || arg_max(event_type, {'t': ts, 'i': event_id}) AS funnel_progression"
GAPS = f"{SCORED}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM sc WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g)"
SESSION_COLS = ["user_id", "events", "engagement", "duration_seconds", "session_quality", "funnel_progression"]


@query(f"WITH {GAPS} SELECT min(ts) AS window_start, user_id, {METRICS} FROM s GROUP BY user_id, no")
def events_gap_sessions(spark, sf):
    return ag.sessions(scored(behavior(spark, sf)), "2 hours").select("window_start", *SESSION_COLS)


@query(f"WITH {SCORED} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS window_start, user_id, {METRICS} FROM sc GROUP BY 1, 2")
def events_tumbling_sessions(spark, sf):
    return ag.sessions(scored(behavior(spark, sf)), "6 hours", tumbling=True).select("window_start", *SESSION_COLS)


@query(f"WITH {GAPS}, f AS (SELECT min(ts) AS window_start, user_id, {METRICS}, max(ts) AS l FROM s GROUP BY user_id, no) SELECT * EXCLUDE (l) FROM f WHERE l + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 3 MINUTE")
def stream_gap_sessions(spark, sf):
    return runs.drain(ag.sessions(scored(streamed(spark, sf)), "2 hours", streaming=True), "sessions").select("window_start", *SESSION_COLS)


@query(f"WITH {BEHAVIOR} SELECT ws AS window_start, event_type, channel, count(*) AS events, round(sum(value), 6) AS value FROM {sliding('behavior', 12, 4)} WHERE ws + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ws, event_type, channel")
def stream_category_aggregations(spark, sf):
    return r(runs.drain(ag.by_category(streamed(spark, sf), "12 hours", "4 hours", streaming=True), "categories"), "value").select("window_start", "event_type", "channel", "events", "value")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'browsing' WHEN 'click' THEN 'cart' WHEN 'purchase' THEN 'conversion' ELSE 'other' END AS event_type_category FROM events")
def stream_event_categories(spark, sf):
    return runs.drain(ag.event_category(streamed(spark, sf)), "event-categories").select("event_id", "event_type_category")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct_events(spark, sf):
    return runs.drain(runs.distinct_events(streamed(spark, sf), ["user_id", "event_type"], delay="60 days"), "distinct").select("user_id", "event_type")


@query(f"""WITH {BEHAVIOR} SELECT e.event_id AS a_event_id, p.event_id AS b_event_id, CAST(abs(floor(epoch(e.ts)) - floor(epoch(p.ts))) AS BIGINT) AS time_difference_seconds FROM behavior e JOIN behavior p ON e.user_id = p.user_id AND e.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= e.ts - INTERVAL 2 HOUR AND p.ts <= e.ts + INTERVAL 2 HOUR""")
def stream_interval_join(spark, sf):
    views = streamed(spark, sf).filter("event_type = 'view'").select("event_id", "user_id", "ts")
    buys = streamed(spark, sf).filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    made = joins.correlate(views, buys, ["user_id"], "2 hours", watermark="10 minutes")
    return runs.drain(made, "interval-join").select("a_event_id", "b_event_id", "time_difference_seconds")


@query("SELECT user_id, arg_max(event_id, {'t': ts, 'i': event_id}) AS event_id, count(*) * 0 + 1 AS one FROM events GROUP BY user_id")
def stream_profile_upsert(spark, sf):
    store = TableStore(spark, runs.folder(spark, "upsert"))
    made = streamed(spark, sf).select("user_id", "ts", "event_id")
    runs.upsert(made, store, "profiles", ["user_id"], "ts", f"{store.root}/_checkpoint").awaitTermination()
    return store.read("profiles").select("user_id", "event_id", F.lit(1).cast("long").alias("one"))


@query("SELECT event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 60, false) AS is_rapid_fire FROM events")
def stream_rapid_fire(spark, sf):
    return runs.drain(runs.rapid_fire(streamed(spark, sf), least_seconds=60.0), "rapid-fire")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_user_counts(spark, sf):
    """Counts in update mode, each batch's merged into the table of all."""
    store = TableStore(spark, runs.folder(spark, "counts"))
    made = streamed(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    runs.upsert(made, store, "counts", ["user_id"], "ts", f"{store.root}/_checkpoint").awaitTermination()
    return store.read("counts").select("user_id", "n")


RULES = (fraud.Rule("high_value", "price > 100", "HIGH"), fraud.Rule("burst", "transaction_count_1d > 3", "MEDIUM"), fraud.Rule("methods", "distinct_payment_methods_1d > 1", "LOW"))
PAYMENTS = f"""{SALES}, pay AS (SELECT event_id AS transaction_id, customer_id, product_id AS merchant_id, amount AS price, ts, payment_method, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM sales),
  vel AS (SELECT *, count(*) OVER w AS n, len(list_distinct(list(payment_method) OVER w)) AS m FROM pay WINDOW w AS (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)),
  found AS (SELECT *, CAST(0.7 * (price > 100)::INT + 0.3 * (n > 3)::INT + 0.1 * (m > 1)::INT AS DOUBLE) AS score, concat_ws(',', CASE WHEN price > 100 THEN 'high_value' END, CASE WHEN n > 3 THEN 'burst' END, CASE WHEN m > 1 THEN 'methods' END) AS rules FROM vel)"""


def payments(b):
    return as_sales(b).select(F.col("event_id").alias("transaction_id"), "customer_id", F.col("product_id").alias("merchant_id"), F.col("amount").alias("price"), "ts", "payment_method")


def detected(spark, sf):
    """The payments in order of time as a stream of four files, each of which is a micro-batch."""
    at = runs.folder(spark, "fraud")
    df = payments(behavior(spark, sf))
    part = F.ntile(4).over(W.orderBy("day"))
    days = df.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumn("part", part)  # one row for each day
    rows = df.withColumn("day", F.to_date("ts")).join(F.broadcast(days.select("day", "part")), "day").drop("day")
    for i in range(1, 5):  # files are taken in the order in which they were written
        rows.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = readers.stream_files(spark, f"{at}/in", df.schema, files_per_trigger=1)
    detection.detect(stream, at, f"{at}/_checkpoint", RULES, spans={"1d": "1 day"}, longest="1 day").awaitTermination()
    return detection.scored(spark, at)


@query(f"WITH {PAYMENTS} SELECT transaction_id, round(score, 6) AS fraud_score, rules AS triggered_rules FROM found")
def stream_fraud_detection(spark, sf):
    return detected(spark, sf).select("transaction_id", F.round("fraud_score", 6).alias("fraud_score"), F.array_join("triggered_rules", ",").alias("triggered_rules"))


@query(f"WITH {PAYMENTS} SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01') AS window_start, count(*) AS transactions, count(*) FILTER (WHERE score > 0) AS alerts, round(coalesce(sum(price) FILTER (WHERE score > 0), 0), 4) AS alert_amount, round(max(score), 6) AS max_score, round(count(*) FILTER (WHERE score > 0) / count(*), 6) AS alert_rate FROM found GROUP BY 1")
def stream_fraud_kpis(spark, sf):
    return r(r(detection.kpis(detected(spark, sf), "1 day"), "max_score", "alert_rate"), "alert_amount", digits=4)


@query(f"WITH {SALES} SELECT DISTINCT customer_id, payment_method, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '2000-01-01') AS slot FROM sales")
def stream_distinct_payments(spark, sf):
    made = runs.drain(detection.distinct_payments(payments(streamed(spark, sf)), ["customer_id", "payment_method"]), "distinct-payments")
    return made.select("customer_id", "payment_method", F.window("ts", "10 minutes")["start"].alias("slot"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS window_start, count(*) AS events, round(avg(value), 6) AS mean, round(greatest(max(value) - avg(value), avg(value) - min(value)) / nullif(stddev(value), 0), 6) AS farthest, coalesce(greatest(max(value) - avg(value), avg(value) - min(value)) / nullif(stddev(value), 0) > 3, false) AS is_anomalous FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 6 HOUR, min(ts), TIMESTAMP '2000-01-01') + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_anomalous_windows(spark, sf):
    made = runs.drain(detection.anomalous_windows(streamed(spark, sf), "value", "6 hours"), "anomalies")
    return r(made, "mean", "farthest").select("window_start", "events", "mean", "farthest", "is_anomalous")
