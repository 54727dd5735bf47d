"""Registered queries: scans, filters and stateless enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.scalars import is_location_anomaly, haversine_km, iso_week, period
from tidemill.operators import enrich
from tidemill.plans.bindings import BEHAVIOR, CUSTOMERS, LINES, TX, WIDE, behavior, customers, lines, table, transactions, wide
from tidemill.plans.registry import query


@query(f"""WITH {WIDE} SELECT transaction_id, line, coalesce(upper(trim(customer_tier)), 'Unknown') AS customer_tier_normalized,
  CASE WHEN customer_lifetime_value >= 1000 THEN 'High' WHEN customer_lifetime_value >= 500 THEN 'Medium' WHEN customer_lifetime_value >= 100 THEN 'Low' ELSE 'Unknown' END AS ltv_category FROM wide""")
def enrich_customer(spark, sf):
    return enrich.customer(wide(spark, sf)).select("transaction_id", "line", "customer_tier_normalized", "ltv_category")


@query(f"""WITH {WIDE} SELECT transaction_id, line, split_part(category, '/', 1) AS main_category, split_part(category, '/', 2) AS sub_category,
  CASE WHEN price >= 100 THEN 'High' WHEN price >= 50 THEN 'Medium' WHEN price >= 10 THEN 'Low' ELSE 'Very Low' END AS price_category,
  CASE WHEN product_id IS NULL THEN 0 ELSE CAST(trunc(price * 0.1 + 50) AS INTEGER) END AS popularity_score FROM wide""")
def enrich_product(spark, sf):
    return enrich.product(wide(spark, sf)).select("transaction_id", "line", "main_category", "sub_category", "price_category", "popularity_score")


@query(f"""WITH {WIDE} SELECT transaction_id, line, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week, dayofweek(ts) IN (0, 6) AS is_weekend,
  CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'Afternoon' WHEN hour(ts) BETWEEN 18 AND 22 THEN 'Evening' ELSE 'Night' END AS time_period,
  hour(ts) BETWEEN 9 AND 17 AND dayofweek(ts) NOT IN (0, 6) AS is_business_hours FROM wide""")
def enrich_temporal(spark, sf):
    return enrich.temporal(wide(spark, sf)).select("transaction_id", "line", "hour_of_day", "day_of_week", "is_weekend", "time_period", "is_business_hours")


@query("""WITH places AS (SELECT c_custkey AS customer_id, CASE c_custkey % 6 WHEN 0 THEN 'New York City' WHEN 1 THEN 'rural California' WHEN 2 THEN 'Texas suburbs' WHEN 3 THEN 'Downtown Chicago' WHEN 4 THEN 'Elsewhere' END AS location FROM customer)
  SELECT customer_id, CASE WHEN regexp_matches(lower(location), 'new york|boston|philadelphia|northeast') THEN 'Northeast' WHEN regexp_matches(lower(location), 'california|seattle|portland|west') THEN 'West'
    WHEN regexp_matches(lower(location), 'texas|florida|atlanta|south') THEN 'South' WHEN regexp_matches(lower(location), 'chicago|detroit|midwest') THEN 'Midwest' ELSE 'Other' END AS region_category,
  CASE WHEN regexp_matches(lower(location), 'city|urban|downtown|metro') THEN 'Urban' WHEN regexp_matches(lower(location), 'suburb') THEN 'Suburban' ELSE 'Rural' END AS area_type FROM places""")
def enrich_geographic(spark, sf):
    places = F.array(*map(F.lit, ("New York City", "rural California", "Texas suburbs", "Downtown Chicago", "Elsewhere")))
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.get(places, (F.col("c_custkey") % 6).cast("int")).alias("location"))
    return enrich.geographic(df).select("customer_id", "region_category", "area_type")


@query(f"""WITH {WIDE} SELECT transaction_id, line, round(coalesce(total_amount * 0.2, 0), 4) AS revenue_impact,
  CASE WHEN total_amount >= 200 THEN 'Large' WHEN total_amount >= 50 THEN 'Medium' WHEN total_amount >= 10 THEN 'Small' ELSE 'Micro' END AS transaction_size, coalesce(quantity >= 5, false) AS bulk_purchase FROM wide""")
def enrich_business(spark, sf):
    return enrich.business(wide(spark, sf)).select("transaction_id", "line", F.round("revenue_impact", 4).alias("revenue_impact"), "transaction_size", "bulk_purchase")


@query(f"""WITH {WIDE}, r AS (SELECT transaction_id, line, total_amount, ts, CASE WHEN total_amount > 500 THEN 3 WHEN dayofweek(ts) IN (0, 6) AND hour(ts) < 6 THEN 2 WHEN payment_method = 'cash' THEN 1 ELSE 0 END AS risk_score FROM wide)
  SELECT transaction_id, line, risk_score, CASE WHEN risk_score >= 3 THEN 'High' WHEN risk_score >= 2 THEN 'Medium' WHEN risk_score >= 1 THEN 'Low' ELSE 'Minimal' END AS risk_category,
  CASE WHEN total_amount > 1000 THEN 'high_amount' WHEN hour(ts) < 6 THEN 'unusual_time' ELSE 'none' END AS anomaly_flags FROM r""")
def enrich_risk(spark, sf):
    return enrich.risk(wide(spark, sf)).select("transaction_id", "line", "risk_score", "risk_category", "anomaly_flags")


@query(f"""WITH {WIDE} SELECT customer_tier, count(*) AS n, count(*) FILTER (WHERE total_amount > 500) AS high_risk, count(*) FILTER (WHERE dayofweek(ts) IN (0, 6)) AS weekend,
  count(*) FILTER (WHERE quantity >= 5) AS bulk, round(sum(total_amount * 0.2), 2) AS revenue_impact FROM wide GROUP BY customer_tier""")
def enrich_transaction_stream(spark, sf):
    df = enrich.transactions(wide(spark, sf)).groupBy("customer_tier")
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("risk_score") == 3).alias("high_risk"), F.count_if("is_weekend").alias("weekend"), F.count_if("bulk_purchase").alias("bulk"), F.round(F.sum("revenue_impact"), 2).alias("revenue_impact"))


#: The stored event types under the names of a shop's funnel.
NAMES = {"view": "page_view", "click": "product_view", "signup": "add_to_cart", "purchase": "checkout", "error": "search"}
AGENTS = ("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0", "Mozilla/5.0 (iPhone) Mobile Safari/604.1", "Mozilla/5.0 (iPad) Safari/604.1", "Mozilla/5.0 (X11; Linux) Firefox/121.0", "curl/8.0")


def shop_events(spark, sf):
    from tidemill.functions.scalars import lookup

    return behavior(spark, sf).withColumns({"event_type": lookup(F.col("event_type"), NAMES, "other"), "user_agent": F.get(F.array(*map(F.lit, AGENTS)), F.col("k") % 5)})


SHOP = BEHAVIOR + ", shop AS (SELECT * REPLACE (CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMES.items()) + " ELSE 'other' END AS event_type), list_extract([" + ", ".join(f"'{a}'" for a in AGENTS) + "], k % 5 + 1) AS user_agent FROM behavior)"


@query(f"""WITH {SHOP} SELECT event_id, CASE event_type WHEN 'page_view' THEN 30 WHEN 'product_view' THEN 45 WHEN 'add_to_cart' THEN 60 ELSE 15 END AS estimated_session_duration,
  CASE event_type WHEN 'page_view' THEN 1 WHEN 'product_view' THEN 2 WHEN 'add_to_cart' THEN 3 WHEN 'checkout' THEN 4 ELSE 0 END AS page_depth,
  CASE WHEN event_type IN ('add_to_cart', 'checkout', 'purchase') THEN 'High' WHEN event_type IN ('product_view', 'search') THEN 'Medium' ELSE 'Low' END AS engagement_level,
  CASE event_type WHEN 'checkout' THEN 90 WHEN 'add_to_cart' THEN 70 WHEN 'product_view' THEN 40 WHEN 'search' THEN 30 ELSE 10 END AS purchase_intent_score,
  CASE WHEN regexp_matches(lower(user_agent), 'mobile|android|iphone') THEN 'Mobile' WHEN regexp_matches(lower(user_agent), 'tablet|ipad') THEN 'Tablet' WHEN regexp_matches(lower(user_agent), 'windows|macintosh|linux|desktop') THEN 'Desktop' ELSE 'Unknown' END AS device_category,
  CASE WHEN lower(user_agent) LIKE '%chrome%' THEN 'Chrome' WHEN lower(user_agent) LIKE '%firefox%' THEN 'Firefox' WHEN lower(user_agent) LIKE '%safari%' THEN 'Safari' WHEN lower(user_agent) LIKE '%edge%' THEN 'Edge' ELSE 'Other' END AS browser_family,
  CASE event_type WHEN 'purchase' THEN 100 WHEN 'add_to_cart' THEN 80 WHEN 'product_view' THEN 60 WHEN 'search' THEN 40 WHEN 'page_view' THEN 20 ELSE 10 END AS engagement_score,
  CASE event_type WHEN 'page_view' THEN 'Awareness' WHEN 'search' THEN 'Interest' WHEN 'product_view' THEN 'Consideration' WHEN 'add_to_cart' THEN 'Intent' WHEN 'checkout' THEN 'Purchase' ELSE 'Unknown' END AS funnel_stage,
  CASE event_type WHEN 'checkout' THEN 95 WHEN 'add_to_cart' THEN 60 WHEN 'product_view' THEN 25 WHEN 'search' THEN 10 WHEN 'page_view' THEN 2 ELSE 0 END AS conversion_probability FROM shop""")
def enrich_user_behavior(spark, sf):
    made = enrich.user_behavior(shop_events(spark, sf))
    return made.select("event_id", "estimated_session_duration", "page_depth", "engagement_level", "purchase_intent_score", "device_category", "browser_family", "engagement_score", "funnel_stage", "conversion_probability")


@query(f"""WITH {SHOP} SELECT CASE event_type WHEN 'page_view' THEN 'Low' WHEN 'search' THEN 'Medium' WHEN 'product_view' THEN 'Medium' WHEN 'add_to_cart' THEN 'High' ELSE 'Low' END AS activity_intensity, count(*) AS n FROM shop GROUP BY 1""")
def enrich_engagement_intensity(spark, sf):
    return enrich.engagement(shop_events(spark, sf)).groupBy("activity_intensity").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT status, count(*) AS n, round(sum(price * quantity), 2) AS total FROM lines WHERE price > 0 AND quantity > 0 AND customer_id IS NOT NULL GROUP BY status")
def clean_transaction_stream(spark, sf):
    return enrich.clean_transactions(lines(spark, sf)).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("total_amount"), 2).alias("total"))


@query(f"WITH {BEHAVIOR} SELECT CASE WHEN event_type IN ('page_view', 'click') THEN 'engagement' WHEN event_type IN ('add_to_cart', 'purchase') THEN 'conversion' ELSE 'other' END AS event_category, count(*) AS n FROM behavior WHERE user_id IS NOT NULL GROUP BY 1")
def clean_behavior_stream(spark, sf):
    return enrich.clean_behavior(behavior(spark, sf)).groupBy("event_category").agg(F.count("*").alias("n"))


@query(f"WITH {BEHAVIOR} SELECT event_id FROM behavior WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 300 SECOND AND epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch(ts)) <= 300")
def freshness_filter(spark, sf):
    return enrich.fresh(behavior(spark, sf), "ts", 300, F.lit("2024-01-30 00:00:00").cast("timestamp")).select("event_id")


@query(f"WITH {TX} SELECT transaction_id, amount FROM tx WHERE ts >= TIMESTAMP '1997-01-01' AND ts <= TIMESTAMP '1997-03-31'")
def date_range_filter(spark, sf):
    return enrich.date_range(transactions(spark, sf), "ts", "1997-01-01", "1997-03-31").select("transaction_id", "amount")


@query(f"""WITH {TX} SELECT transaction_id, strftime(ts, '%Y-%m-%d %H') AS p_hour, strftime(ts, '%Y-%m-%d') AS p_day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS p_week, strftime(ts, '%Y-%m') AS p_month,
  year(ts) || '-Q' || quarter(ts) AS p_quarter, strftime(ts, '%G-W%V') AS iso FROM tx""")
def time_dimensions(spark, sf):
    ts = F.col("ts")
    return transactions(spark, sf).select("transaction_id", *[period(ts, u).alias(f"p_{u}") for u in ("hour", "day", "week", "month", "quarter")], iso_week(ts).alias("iso"))


@query(f"""WITH {TX} SELECT transaction_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(day(ts) AS INTEGER) AS day_of_month,
  CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week, CAST(weekofyear(ts) AS INTEGER) AS week_of_year, monthname(ts) AS month_name, dayname(ts) AS day_name FROM tx""")
def calendar_features(spark, sf):
    names = ["year", "month", "quarter", "day_of_month", "day_of_week", "week_of_year", "month_name", "day_name"]
    return enrich.calendar(transactions(spark, sf)).select("transaction_id", *names)


@query("SELECT c_custkey, sha256(c_name) AS c_name, c_mktsegment FROM customer")
def anonymize_hash(spark, sf):
    return enrich.anonymize(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name"])


@query("SELECT c_custkey, regexp_replace(c_name, '.', '*', 'g') AS c_name FROM customer")
def anonymize_mask(spark, sf):
    return enrich.anonymize(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name"], "mask")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def anonymize_remove(spark, sf):
    return enrich.anonymize(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name"], "remove")


@query(f"""WITH {CUSTOMERS}, d AS (SELECT customer_id, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(40.0 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(40.0)) * pow(sin(radians(-74.0 - longitude) / 2), 2), 1.0))) AS km FROM customers)
  SELECT customer_id, round(km, 3) AS km, km > 500 AS far FROM d""")
def location_distance(spark, sf):
    place = [F.col("latitude"), F.col("longitude"), F.lit(40.0), F.lit(-74.0)]
    return customers(spark, sf).select("customer_id", F.round(haversine_km(*place), 3).alias("km"), is_location_anomaly(*place).alias("far"))
