"""Registered queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.scalars import lookup
from tidemill.operators import joins
from tidemill.plans.bindings import BEHAVIOR, EVENTS_AS_OF, behavior, table
from tidemill.plans.registry import query

INTENT = {"signup": 70, "click": 40, "view": 30}
EV = f"""{BEHAVIOR}, ev AS (SELECT event_id, user_id, ts, event_type, product_id, CASE event_type WHEN 'signup' THEN 70 WHEN 'click' THEN 40 WHEN 'view' THEN 30 ELSE 10 END AS score FROM behavior WHERE event_type <> 'purchase'), buy AS (SELECT event_id, user_id, ts, product_id, value FROM behavior WHERE event_type = 'purchase')"""


def sides(spark, sf):
    b = behavior(spark, sf)
    events = b.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts", "event_type", "product_id", lookup(F.col("event_type"), INTENT, 10).alias("purchase_intent_score"))
    return events, b.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "product_id", "value")


@query(f"""WITH {EV}, j AS (SELECT e.event_id AS a, p.event_id AS b, e.score, e.event_type, (floor(epoch(p.ts)) - floor(epoch(e.ts))) / 60 AS m, e.product_id = p.product_id AS pm FROM ev e JOIN buy p ON e.user_id = p.user_id AND p.ts >= e.ts AND p.ts <= e.ts + INTERVAL 120 MINUTE)
  SELECT a AS a_event_id, b AS b_event_id, round(m, 6) AS time_to_purchase_minutes, pm AS product_match, score + CASE WHEN pm THEN 20 ELSE 0 END AS intent_to_purchase_score, event_type || ' -> purchase' AS conversion_path, CASE WHEN m <= 5 THEN 'Immediate' WHEN m <= 30 THEN 'Quick' WHEN m <= 120 THEN 'Considered' ELSE 'Delayed' END AS purchase_velocity FROM j""")
def join_transaction_behavior(spark, sf):
    events, buys = sides(spark, sf)
    made = joins.purchase_after_behavior(buys, events, "120 minutes")
    return made.select("a_event_id", "b_event_id", F.round("time_to_purchase_minutes", 6).alias("time_to_purchase_minutes"), "product_match", "intent_to_purchase_score", "conversion_path", "purchase_velocity")


@query(f"""WITH {EV}, j AS (SELECT e.event_id AS a, p.event_id AS b, e.event_type, (floor(epoch(p.ts)) - floor(epoch(e.ts))) / 3600 AS h, coalesce(e.product_id = p.product_id, false) AS pc FROM ev e LEFT JOIN buy p ON e.user_id = p.user_id AND p.ts >= e.ts AND p.ts <= e.ts + INTERVAL 4 HOUR)
  SELECT a AS a_event_id, b AS b_event_id, b IS NOT NULL AS led_to_purchase, round(h, 6) AS time_to_purchase_hours, CASE WHEN b IS NULL THEN 0 WHEN h <= 0.5 THEN 100 WHEN h <= 1 THEN 80 WHEN h <= 2 THEN 60 WHEN h <= 3 THEN 40 ELSE 20 END AS journey_effectiveness, pc AS product_correlation,
  CASE event_type WHEN 'signup' THEN 5 WHEN 'click' THEN 3 WHEN 'view' THEN 1 ELSE 0 END AS journey_stage_impact FROM j""")
def join_user_journey(spark, sf):
    events, buys = sides(spark, sf)
    made = joins.user_journey(events, buys)
    return made.select("a_event_id", "b_event_id", "led_to_purchase", F.round("time_to_purchase_hours", 6).alias("time_to_purchase_hours"), "journey_effectiveness", "product_correlation", "journey_stage_impact")


@query(f"WITH {BEHAVIOR} SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS event_sequence FROM behavior")
def join_event_sequence(spark, sf):
    return joins.event_sequence(behavior(spark, sf)).select("event_id", "event_sequence")


PROFILES = f"""{EV}, u AS (SELECT user_id, ts, event_id, list_extract(['Bronze', 'Silver', 'Gold', 'Platinum'], k % 4 + 1) AS tier, CAST(ts AS DATE) - (k % 200) AS registered, CAST(ts AS DATE) - (k % 120) AS last_login, k % 20 AS orders, value * 20 AS lifetime_value, value * 15 AS spent FROM behavior WHERE event_type = 'signup'),
  l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


def updates(spark, sf):
    b = behavior(spark, sf).filter("event_type = 'signup'")
    tiers = F.array(*map(F.lit, ("Bronze", "Silver", "Gold", "Platinum")))
    return b.select("user_id", "ts", "event_id", F.get(tiers, F.col("k") % 4).alias("tier"), F.date_sub(F.to_date("ts"), F.col("k") % 200).alias("registered"), F.date_sub(F.to_date("ts"), F.col("k") % 120).alias("last_login"), (F.col("k") % 20).alias("orders"), (F.col("value") * 20).alias("lifetime_value"), (F.col("value") * 15).alias("spent"))


@query(f"""WITH {PROFILES}, j AS (SELECT b.event_id, l.*, CAST(date_diff('day', registered, DATE '{EVENTS_AS_OF}') AS INTEGER) AS tenure, CAST(date_diff('day', last_login, DATE '{EVENTS_AS_OF}') AS INTEGER) AS away FROM buy b LEFT JOIN (SELECT * EXCLUDE (event_id) FROM l) l ON l.user_id = b.user_id)
  SELECT event_id, tier, tenure AS customer_tenure_days, away AS days_since_last_login, coalesce(tier = 'Bronze' AND spent > 500 OR tier = 'Silver' AND spent > 1000 OR tier = 'Gold' AND spent > 2000, false) AS tier_upgrade_eligible,
  CASE WHEN tenure < 30 THEN 'New' WHEN away > 90 THEN 'At Risk' WHEN orders > 10 THEN 'Loyal' WHEN lifetime_value > 1000 THEN 'VIP' ELSE 'Regular' END AS customer_segment, round((epoch(TIMESTAMP '{EVENTS_AS_OF}') - floor(epoch(ts))) / 3600, 6) AS profile_freshness_hours FROM j""")
def join_customer_profile(spark, sf):
    _, buys = sides(spark, sf)
    made = joins.with_profile(buys.select("event_id", "user_id"), updates(spark, sf).withColumnRenamed("event_id", "_update"), F.lit(EVENTS_AS_OF).cast("timestamp"))
    return made.select("event_id", "tier", "customer_tenure_days", "days_since_last_login", "tier_upgrade_eligible", "customer_segment", F.round("profile_freshness_hours", 6).alias("profile_freshness_hours"))


@query(f"WITH {EV} SELECT a.event_id AS a_event_id, b.event_id AS b_event_id, CAST(abs(floor(epoch(a.ts)) - floor(epoch(b.ts))) AS BIGINT) AS time_difference_seconds FROM ev a JOIN buy b ON a.user_id = b.user_id AND b.ts >= a.ts - INTERVAL 15 MINUTE AND b.ts <= a.ts + INTERVAL 15 MINUTE")
def join_cross_stream_correlation(spark, sf):
    events, buys = sides(spark, sf)
    return joins.correlate(events, buys, ["user_id"]).select("a_event_id", "b_event_id", "time_difference_seconds")


@query(f"""WITH {EV}, g AS (SELECT *, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) <= 7200 THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(user_id AS VARCHAR) || '_' || CAST(CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS VARCHAR) AS session_id FROM g),
  p AS (SELECT user_id, session_id, min(ts) AS st, max(ts) AS en, count(*) AS events, max(score) AS intent, list(DISTINCT product_id) AS products FROM s GROUP BY 1, 2)
  SELECT session_id, events, b.event_id AS purchase_id, b.event_id IS NOT NULL AS within_session_purchase, intent + CASE WHEN b.event_id IS NOT NULL THEN 50 ELSE 0 END AS session_conversion_score, coalesce(list_contains(products, b.product_id), false) AS session_product_match FROM p LEFT JOIN buy b ON p.user_id = b.user_id AND b.ts >= st AND b.ts <= en + INTERVAL 2 HOUR""")
def join_sessionized(spark, sf):
    events, buys = sides(spark, sf)
    made = joins.session_purchases(events, buys, "2 hours")
    return made.select("session_id", "events", "purchase_id", "within_session_purchase", "session_conversion_score", "session_product_match")


@query("""WITH bands AS (SELECT i AS band, CAST(i * 1000 AS BIGINT) AS low, CAST(i * 1000 + 1500 AS BIGINT) AS high FROM range(100) t(i)) SELECT o_orderkey, band FROM orders JOIN bands ON o_orderkey >= low AND o_orderkey < high""")
def join_range(spark, sf):
    spans = spark.range(100).select(F.col("id").alias("band"), (F.col("id") * 1000).alias("low"), (F.col("id") * 1000 + 1500).alias("high"))
    return joins.range_join(table(spark, sf, "orders").select("o_orderkey"), spans, "o_orderkey", "low", "high", 1000).select("o_orderkey", "band")


@query(f"WITH {EV} SELECT b.event_id, e.event_id AS last_event, e.event_type AS last_type FROM buy b ASOF LEFT JOIN (SELECT * FROM ev) e ON b.user_id = e.user_id AND b.ts >= e.ts")
def join_as_of(spark, sf):
    events, buys = sides(spark, sf)
    made = joins.as_of_join(buys, events.withColumnsRenamed({"event_id": "last_event", "event_type": "last_type"}), "user_id", "ts", "ts", ["last_event", "last_type"])
    return made.select("event_id", "last_event", "last_type")


@query(f"""WITH {EV}, a AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS w, count(*) AS volume, sum(value) AS amount, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS risky FROM buy GROUP BY 1), b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS w, count(*) AS events, avg(score) AS engagement FROM ev GROUP BY 1)
  SELECT w AS window_start, coalesce(volume, 0) AS volume, round(amount, 4) AS amount, coalesce(events, 0) AS events, round(engagement, 6) AS engagement, CASE WHEN coalesce(volume, 0) < 10 THEN 'LOW' WHEN volume > 1000 THEN 'HIGH' ELSE 'NORMAL' END AS volume_alert, coalesce(risky, 0) > 5 AS risk_alert,
  CASE WHEN engagement < 30 THEN 'LOW' WHEN engagement > 80 THEN 'HIGH' ELSE 'NORMAL' END AS engagement_alert FROM a FULL JOIN b USING (w)""")
def join_alert_windows(spark, sf):
    events, buys = sides(spark, sf)
    made = joins.window_alerts(buys.select("ts", F.col("value").alias("amount"), F.when(F.col("value") > 100, 3).otherwise(0).alias("risk")), events.select("ts", F.col("purchase_intent_score").alias("score")), "6 hours")
    return made.select(F.col("window.start").alias("window_start"), "volume", F.round("amount", 4).alias("amount"), "events", F.round("engagement", 6).alias("engagement"), "volume_alert", "risk_alert", "engagement_alert")
