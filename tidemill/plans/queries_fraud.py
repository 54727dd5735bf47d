"""Registered queries: fraud, deduplication and late data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import dedup, fraud
from tidemill.plans.bindings import AS_OF, BEHAVIOR, LINES, behavior, lines
from tidemill.plans.registry import query

#: Order lines as card payments: an hour and a payment method from the keys.
PAY = f"""{LINES}, pay AS (SELECT (((transaction_id * 10 + line) * 100000 + product_id) * 1000 + merchant_id) * 100 + CAST(quantity AS BIGINT) AS transaction_id, customer_id, merchant_id, revenue AS price, ts + to_seconds(CAST((transaction_id * 7919 + line * 300) % 86400 AS INTEGER)) AS ts,
  list_extract(['credit_card', 'paypal', 'bank_transfer', 'digital_wallet', 'cash'], CAST((transaction_id + line) % 5 AS INTEGER) + 1) AS payment_method, 'place_' || CAST(merchant_id % 9 AS VARCHAR) AS location FROM lines)"""


def pay(spark, sf):
    df = lines(spark, sf)
    methods = F.array(*map(F.lit, ("credit_card", "paypal", "bank_transfer", "digital_wallet", "cash")))
    return df.select(
        ((((F.col("transaction_id") * 10 + F.col("line")) * 100000 + F.col("product_id")) * 1000 + F.col("merchant_id")) * 100 + F.col("quantity").cast("long")).alias("transaction_id"), "customer_id", "merchant_id", F.col("revenue").alias("price"),
        F.timestamp_add("SECOND", ((F.col("transaction_id") * 7919 + F.col("line") * 300) % 86400).cast("int"), "ts").alias("ts"), F.get(methods, ((F.col("transaction_id") + F.col("line")) % 5).cast("int")).alias("payment_method"),
        F.concat(F.lit("place_"), (F.col("merchant_id") % 9).cast("string")).alias("location"),
    )


def r(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


FRAME = "(PARTITION BY customer_id ORDER BY s RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
VELOCITY = f"""{PAY}, e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM pay), vel AS (SELECT *, """ + ", ".join(
    f"count(*) OVER {FRAME.format(n)} AS transaction_count_{k}, sum(price) OVER {FRAME.format(n)} AS amount_sum_{k}, len(list_distinct(list(merchant_id) OVER {FRAME.format(n)})) AS distinct_merchants_{k}, len(list_distinct(list(payment_method) OVER {FRAME.format(n)})) AS distinct_payment_methods_{k}"
    for k, n in (("1h", 3600), ("1d", 86400), ("7d", 604800))
) + " FROM e)"
V = [f"{c}_{k}" for k in ("1h", "1d", "7d") for c in ("transaction_count", "amount_sum", "distinct_merchants", "distinct_payment_methods")]


@query(f"WITH {VELOCITY} SELECT transaction_id, " + ", ".join(f"round({c}, 4) AS {c}" if "amount" in c else f"CAST({c} AS INTEGER) AS {c}" if "distinct" in c else c for c in V) + " FROM vel")
def fraud_velocity(spark, sf):
    return r(fraud.velocity(pay(spark, sf)), *[c for c in V if "amount" in c], digits=4).select("transaction_id", *V)


@query(f"""WITH {PAY}, a AS (SELECT *, avg(price) OVER w AS av, max(price) OVER w AS mx, stddev(price) OVER w AS sd, percent_rank() OVER (ORDER BY price) AS pr FROM pay WINDOW w AS (PARTITION BY customer_id))
  SELECT transaction_id, round(price / av, 6) AS amount_deviation_ratio, round((price - av) / nullif(sd, 0), 6) AS amount_zscore, price % 100 = 0 AND price > 100 AS is_round_amount, CAST(round(price * 100) AS BIGINT) % 100 = 99 AS ends_with_99, round(pr, 8) AS amount_percentile FROM a""")
def fraud_amount_patterns(spark, sf):
    made = r(r(fraud.amounts(pay(spark, sf).select("transaction_id", "customer_id", "price")), "amount_deviation_ratio", "amount_zscore"), "amount_percentile", digits=8)
    return made.select("transaction_id", "amount_deviation_ratio", "amount_zscore", "is_round_amount", "ends_with_99", "amount_percentile")


@query(f"""WITH {PAY}, t AS (SELECT *, CAST(hour(ts) AS INTEGER) AS hour, avg(hour(ts)) OVER (PARTITION BY customer_id) AS ah, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY customer_id ORDER BY ts, transaction_id))) AS BIGINT) AS gap FROM pay)
  SELECT transaction_id, hour, hour BETWEEN 9 AND 17 AS is_business_hours, hour BETWEEN 0 AND 5 AS is_unusual_hour, dayofweek(ts) IN (0, 6) AS is_weekend, round(ah, 6) AS avg_hour, round(abs(hour - ah), 6) AS hour_deviation, gap AS seconds_since_last, coalesce(gap < 60, false) AS is_rapid FROM t""")
def fraud_time_patterns(spark, sf):
    return r(fraud.times(pay(spark, sf)), "avg_hour", "hour_deviation").select("transaction_id", "hour", "is_business_hours", "is_unusual_hour", "is_weekend", "avg_hour", "hour_deviation", "seconds_since_last", "is_rapid")


def novelty_sql(column, prefix):
    return f"n_{prefix} AS (SELECT *, CAST(sum(f) OVER w AS BIGINT) AS {prefix}_count, f = 1 AND row_number() OVER w > 1 AS {prefix}_is_new FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY customer_id, {column} ORDER BY ts, transaction_id) = 1 THEN 1 ELSE 0 END AS f FROM pay) WINDOW w AS (PARTITION BY customer_id ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING))"


@query(f"""WITH {PAY}, {novelty_sql("location", "location")}, e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM n_location)
  SELECT transaction_id, location_count, location_is_new, count(*) OVER (PARTITION BY customer_id, location ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS location_transactions_1h, CAST(len(list_distinct(list(location) OVER (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))) AS INTEGER) AS distinct_locations_1h FROM e""")
def fraud_location_patterns(spark, sf):
    return fraud.locations(pay(spark, sf)).select("transaction_id", "location_count", "location_is_new", "location_transactions_1h", "distinct_locations_1h")


@query(f"WITH {PAY}, {novelty_sql('merchant_id', 'merchant')} SELECT transaction_id, merchant_count, merchant_is_new, count(*) OVER m AS merchant_transactions, round(sum(price) OVER m, 7) AS merchant_amount, round(avg(price) OVER m, 7) AS merchant_avg_amount FROM n_merchant WINDOW m AS (PARTITION BY customer_id, merchant_id)")
def fraud_merchant_patterns(spark, sf):
    return r(fraud.merchants(pay(spark, sf)), "merchant_amount", "merchant_avg_amount", digits=7).select("transaction_id", "merchant_count", "merchant_is_new", "merchant_transactions", "merchant_amount", "merchant_avg_amount")


@query(f"WITH {PAY}, {novelty_sql('payment_method', 'payment')} SELECT transaction_id, payment_count, payment_is_new, coalesce(lag(payment_method) OVER (PARTITION BY customer_id ORDER BY ts, transaction_id) <> payment_method, false) AS payment_changed FROM n_payment")
def fraud_payment_patterns(spark, sf):
    return fraud.payments(pay(spark, sf)).select("transaction_id", "payment_count", "payment_is_new", "payment_changed")


@query(f"WITH {PAY} SELECT count(*) AS n, count(*) FILTER (WHERE hour(ts) BETWEEN 0 AND 5) AS unusual, count(DISTINCT customer_id) AS customers FROM pay")
def fraud_comprehensive_patterns(spark, sf):
    return fraud.patterns(pay(spark, sf)).agg(F.count("*").alias("n"), F.count_if("is_unusual_hour").alias("unusual"), F.countDistinct("customer_id").alias("customers"))


SIMPLE = [fraud.Rule("big", "price > 5000", "high"), fraud.Rule("round", "price % 100 = 0", "low"), fraud.Rule("cash", "payment_method = 'cash'", "medium")]


@query(f"""WITH {PAY} SELECT transaction_id, round(CASE WHEN price > 5000 THEN 1.0 ELSE 0 END + CASE WHEN price % 100 = 0 THEN 0.1 ELSE 0 END + CASE WHEN payment_method = 'cash' THEN 0.5 ELSE 0 END, 6) AS fraud_score,
  concat_ws(',', CASE WHEN price > 5000 THEN 'big' END, CASE WHEN price % 100 = 0 THEN 'round' END, CASE WHEN payment_method = 'cash' THEN 'cash' END) AS fraud_alerts FROM pay""".replace("1.0 ELSE", "CAST(1 AS DOUBLE) ELSE"))
def fraud_simple_rules(spark, sf):
    made = fraud.simple_rules(pay(spark, sf), SIMPLE)
    return made.select("transaction_id", F.round("fraud_score", 6).alias("fraud_score"), F.array_join("fraud_alerts", ",").alias("fraud_alerts"))


RULED = f"""{VELOCITY}, ruled AS (SELECT *, price > 10000 AS r1, transaction_count_1h > 5 AS r2, price % 100 = 0 AND price > 500 AS r3, hour(ts) BETWEEN 2 AND 5 AS r4, distinct_payment_methods_1h > 2 AS r5 FROM vel),
  scored AS (SELECT *, CAST(0.7 * r1::INT + 0.3 * r2::INT + 0.1 * r3::INT + 0.3 * r4::INT + 0.7 * r5::INT AS DOUBLE) AS score, concat_ws(',', CASE WHEN r1 THEN 'high_amount_threshold' END, CASE WHEN r2 THEN 'velocity_check_hourly' END, CASE WHEN r3 THEN 'round_amount_pattern' END, CASE WHEN r4 THEN 'unusual_time_pattern' END, CASE WHEN r5 THEN 'multiple_payment_methods' END) AS rules FROM ruled)"""


def ruled(spark, sf):
    return fraud.apply_rules(fraud.velocity(pay(spark, sf), {"1h": "1 hour"}))


@query(f"WITH {RULED} SELECT transaction_id, round(score, 6) AS fraud_score, rules AS triggered_rules, CASE WHEN round(score, 9) >= 0.7 THEN 'CRITICAL' WHEN round(score, 9) >= 0.5 THEN 'HIGH' WHEN round(score, 9) >= 0.3 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'NONE' END AS risk_level FROM scored")
def fraud_rules(spark, sf):
    return ruled(spark, sf).select("transaction_id", F.round("fraud_score", 6).alias("fraud_score"), F.array_join("triggered_rules", ",").alias("triggered_rules"), "risk_level")


@query(f"WITH {RULED} " + " UNION ALL ".join(f"SELECT '{x.name}' AS rule, count(*) FILTER (WHERE r{i}) AS triggers, round(count(*) FILTER (WHERE r{i}) / count(*), 6) AS rate, round(avg(score) FILTER (WHERE r{i}), 6) AS avg_score FROM scored" for i, x in enumerate(fraud.DEFAULT_RULES, 1)))
def fraud_rule_statistics(spark, sf):
    return r(fraud.rule_statistics(ruled(spark, sf)), "rate", "avg_score")


RISK = f"""{PAY}, p AS (SELECT *, avg(price) OVER (PARTITION BY merchant_id) AS av FROM pay), m AS (SELECT merchant_id, count(*) AS n, sum(price) AS rev, avg(price) AS a, stddev(price) AS sd, count(DISTINCT customer_id) AS uc, CAST(date_diff('day', CAST(min(ts) AS DATE), DATE '{AS_OF}') AS INTEGER) AS age,
  avg(CASE WHEN price > 3 * av THEN 1 ELSE 0 END) AS hi, avg(CASE WHEN hour(ts) BETWEEN 0 AND 5 THEN 1 ELSE 0 END) AS un, avg(CASE WHEN price % 100 = 0 AND price > 100 THEN 1 ELSE 0 END) AS ro FROM p GROUP BY 1),
  s AS (SELECT *, coalesce(sd / a, 0) AS vol, CASE WHEN n < 10 THEN 0.8 WHEN n < 50 THEN 0.6 ELSE 1 - percent_rank() OVER (ORDER BY n) END AS volr, CASE WHEN uc / n < 0.1 THEN 0.9 WHEN uc / n < 0.3 THEN 0.6 WHEN uc / n < 0.7 THEN 0.3 ELSE 0.1 END AS divr, CASE WHEN age < 30 THEN 0.8 WHEN age < 90 THEN 0.6 WHEN age < 180 THEN 0.4 ELSE 0.1 END AS newr FROM m),
  t AS (SELECT *, percent_rank() OVER (ORDER BY vol) AS vr FROM s), u AS (SELECT *, round(0.15 * volr + 0.15 * divr + 0.10 * vr + 0.45 * (0.3 * hi + 0.3 * un + 0.4 * ro) + 0.15 * newr, 9) AS risk FROM t)"""


@query(f"""WITH {RISK} SELECT merchant_id, n AS transaction_count, round(rev, 2) AS total_revenue, uc AS unique_customers, age AS merchant_age_days, round(vol, 6) AS amount_volatility, round(CAST(risk AS DOUBLE), 6) AS merchant_risk_score,
  CASE WHEN risk >= 0.8 THEN 'VERY_HIGH' WHEN risk >= 0.6 THEN 'HIGH' WHEN risk >= 0.4 THEN 'MEDIUM' WHEN risk >= 0.2 THEN 'LOW' ELSE 'VERY_LOW' END AS merchant_risk_level,
  concat_ws(',', CASE WHEN n < 10 THEN 'LOW_VOLUME' END, CASE WHEN divr > 0.7 THEN 'LOW_CUSTOMER_DIVERSITY' END, CASE WHEN vr > 0.8 THEN 'HIGH_AMOUNT_VOLATILITY' END, CASE WHEN un > 0.3 THEN 'HIGH_UNUSUAL_HOURS' END, CASE WHEN ro > 0.5 THEN 'HIGH_ROUND_AMOUNTS' END, CASE WHEN age < 30 THEN 'NEW_MERCHANT' END) AS risk_flags FROM u""")
def fraud_merchant_risk(spark, sf):
    made = fraud.merchant_risk(pay(spark, sf), AS_OF, None)
    made = r(r(made, "total_revenue", digits=2), "amount_volatility", "merchant_risk_score")
    return made.select("merchant_id", "transaction_count", "total_revenue", "unique_customers", "merchant_age_days", "amount_volatility", "merchant_risk_score", "merchant_risk_level", F.array_join("risk_flags", ",").alias("risk_flags"))


@query(f"WITH {RISK} SELECT merchant_id, round(CAST(risk AS DOUBLE), 6) AS merchant_risk_score FROM u WHERE risk >= 0.25")
def fraud_high_risk_merchants(spark, sf):
    return fraud.high_risk(fraud.merchant_risk(pay(spark, sf), AS_OF, None), 0.25).select("merchant_id", F.round("merchant_risk_score", 6).alias("merchant_risk_score"))


@query(f"""WITH {PAY}, o AS (SELECT * FROM pay WHERE merchant_id = 3) SELECT 'hour' AS dimension, CAST(hour(ts) AS VARCHAR) AS member, count(*) AS transactions, round(sum(price), 4) AS amount FROM o GROUP BY 2 UNION ALL SELECT 'weekday', dayname(ts), count(*), round(sum(price), 4) FROM o GROUP BY 2
  UNION ALL SELECT 'amount', CASE WHEN price >= 1000 THEN 'over_1000' WHEN price >= 500 THEN '500_1000' WHEN price >= 100 THEN '100_500' WHEN price >= 50 THEN '50_100' ELSE 'under_50' END, count(*), round(sum(price), 4) FROM o GROUP BY 2""")
def fraud_merchant_profile(spark, sf):
    return r(fraud.merchant_profile(pay(spark, sf), 3), "amount", digits=4)


ALERTS = f"""{RULED}, alerts AS (SELECT transaction_id AS alert_id, customer_id, merchant_id, price, ts, payment_method, rules, r1::INT + r2::INT + r3::INT + r4::INT + r5::INT AS k FROM scored WHERE score > 0), q AS (SELECT quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.95) AS p95, quantile_cont(price, 0.99) AS p99 FROM alerts),
  f AS (SELECT a.*, CASE WHEN price >= p99 THEN 1.0 WHEN price >= p95 THEN 0.8 WHEN price >= m * 5 THEN 0.6 WHEN price >= m * 2 THEN 0.4 WHEN price >= m THEN 0.2 ELSE 0.1 END AS fi, CASE WHEN k >= 5 THEN 1.0 WHEN k >= 3 THEN 0.8 WHEN k >= 2 THEN 0.6 WHEN k >= 1 THEN 0.4 ELSE 0.2 END AS pc,
    CASE WHEN mi <= 5 THEN 1.0 WHEN mi <= 15 THEN 0.9 WHEN mi <= 60 THEN 0.7 WHEN mi <= 240 THEN 0.5 WHEN mi <= 1440 THEN 0.3 ELSE 0.1 END AS tsf, CASE WHEN customer_id % 4 = 3 THEN 0.5 ELSE (customer_id % 10) / 10 END AS cr, (merchant_id % 10) / 10 AS mr,
    CASE payment_method WHEN 'credit_card' THEN 0.8 WHEN 'bank_transfer' THEN 0.8 WHEN 'digital_wallet' THEN 0.6 WHEN 'paypal' THEN 0.5 ELSE 0.3 END AS base FROM (SELECT *, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 60 AS mi FROM alerts) a, q),
  h AS (SELECT *, (CASE WHEN rules LIKE '%high_amount%' THEN 0.75 ELSE 0 END + CASE WHEN rules LIKE '%unusual_time%' THEN 0.25 ELSE 0 END) / nullif(CASE WHEN rules LIKE '%high_amount%' THEN 1 ELSE 0 END + CASE WHEN rules LIKE '%unusual_time%' THEN 1 ELSE 0 END, 0) AS ha0 FROM f),
  pr AS (SELECT *, round(CAST(0.25 * fi + 0.20 * cr + 0.15 * mr + 0.15 * pc + 0.10 * coalesce(ha0, 0.5) + 0.10 * tsf + 0.05 * base * CASE WHEN greatest(cr, mr) > 0.8 THEN 1.2 WHEN greatest(cr, mr) > 0.6 THEN 1.1 ELSE 1 END AS DOUBLE), 9) AS score FROM h),
  lv AS (SELECT *, CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM pr), mm AS (SELECT *, CAST(CASE level WHEN 'CRITICAL' THEN 45 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 15 ELSE 5 END + 5 * k AS INTEGER) AS minutes FROM lv)"""


def alerts(spark, sf):
    found = ruled(spark, sf).filter("fraud_score > 0").withColumnRenamed("transaction_id", "alert_id").withColumn("max_severity", F.lit("HIGH"))
    tx = pay(spark, sf)
    customer_risk = tx.select("customer_id").distinct().filter("customer_id % 4 != 3").select("customer_id", ((F.col("customer_id") % 10) / 10).alias("customer_risk"))
    merchant_risk = tx.select("merchant_id").distinct().select("merchant_id", ((F.col("merchant_id") % 10) / 10).alias("merchant_risk"))
    rows = [("high_amount_threshold", "TRUE_POSITIVE")] * 3 + [("high_amount_threshold", "FALSE_POSITIVE")] + [("unusual_time_pattern", "TRUE_POSITIVE")] + [("unusual_time_pattern", "FALSE_POSITIVE")] * 3
    history = spark.createDataFrame(rows, "rule string, resolution string")
    return fraud.prioritize(found, F.lit(AS_OF).cast("timestamp"), customer_risk, merchant_risk, history)


@query(f"WITH {ALERTS} SELECT alert_id, round(score, 6) AS priority_score, level AS alert_priority, minutes AS estimated_minutes, CASE level WHEN 'CRITICAL' THEN 'IMMEDIATE_REVIEW' WHEN 'HIGH' THEN 'REVIEW_WITHIN_1_HOUR' WHEN 'MEDIUM' THEN 'REVIEW_WITHIN_4_HOURS' ELSE 'REVIEW_WITHIN_24_HOURS' END AS first_action FROM mm")
def fraud_alert_priorities(spark, sf):
    return alerts(spark, sf).select("alert_id", F.round("priority_score", 6).alias("priority_score"), "alert_priority", "estimated_minutes", F.get("recommended_actions", F.lit(0)).alias("first_action"))


@query(f"WITH {ALERTS}, b AS (SELECT alert_id, score, ts FROM mm ORDER BY score DESC, ts, alert_id LIMIT 100) SELECT alert_id, round(score, 6) AS priority_score, CAST(row_number() OVER (ORDER BY score DESC, ts, alert_id) AS INTEGER) AS queue_position FROM b")
def fraud_priority_queue(spark, sf):
    return fraud.priority_queue(alerts(spark, sf)).select("alert_id", F.round("priority_score", 6).alias("priority_score"), "queue_position")


@query(f"WITH {ALERTS} SELECT level AS alert_priority, count(*) AS alerts, round(sum(price), 2) AS amount, round(avg(score), 6) AS avg_score, CAST(sum(minutes) AS BIGINT) AS minutes, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM mm GROUP BY 1")
def fraud_alert_summary(spark, sf):
    return r(r(fraud.alert_summary(alerts(spark, sf)), "amount", digits=2), "avg_score", "share")


@query(f"WITH {RULED}, x AS (SELECT unnest(string_split(rules, ',')) AS rule FROM scored WHERE score > 0) SELECT rule, count(*) AS alerts FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def fraud_top_rules(spark, sf):
    return fraud.top_rules(ruled(spark, sf))


@query(f"""WITH {RULED}, c AS (SELECT transaction_id, merchant_id, score, CASE WHEN transaction_id % 3 = 0 THEN NULL ELSE (transaction_id % 100) / 100 END AS p FROM scored), d AS (SELECT *, CASE WHEN p IS NULL THEN score ELSE 0.4 * score + 0.6 * p END AS cs FROM c)
  SELECT transaction_id, round(CAST(cs AS DOUBLE), 6) AS combined_fraud_score, CAST(round(cs, 9) > 0.5 AS INTEGER) AS combined_fraud_prediction, CASE WHEN score > 0 AND coalesce(p > 0.5, false) THEN 'rules_and_ml' WHEN score > 0 THEN 'rules_only' WHEN coalesce(p > 0.5, false) THEN 'ml_only' ELSE 'none' END AS detection_method FROM d""")
def fraud_combined_scores(spark, sf):
    tx = pay(spark, sf).withColumn("ml_fraud_probability", F.when(F.col("transaction_id") % 3 != 0, (F.col("transaction_id") % 100) / 100))
    made = fraud.detect(tx, fraud.merchant_risk(pay(spark, sf), AS_OF, None))
    return made.select("transaction_id", F.round("combined_fraud_score", 6).alias("combined_fraud_score"), (F.round("combined_fraud_score", 9) > 0.5).cast("int").alias("combined_fraud_prediction"), "detection_method")


#: Events twice: every third again, two seconds later.
TWICE = f"{BEHAVIOR}, twice AS (SELECT event_id, user_id, ts, event_type, product_id, value FROM behavior UNION ALL SELECT event_id + 1000000, user_id, ts + INTERVAL 2 SECOND, event_type, product_id, value FROM behavior WHERE event_id % 3 = 0)"


def twice(spark, sf):
    b = behavior(spark, sf).select("event_id", "user_id", "ts", "event_type", "product_id", "value")
    return b.unionByName(b.filter("event_id % 3 = 0").withColumns({"event_id": F.col("event_id") + 1000000, "ts": F.col("ts") + F.expr("INTERVAL 2 SECONDS")}))


KEYS = ["user_id", "event_type", "value"]


@query(f"WITH {TWICE} SELECT event_id FROM twice QUALIFY row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY ts, event_id) = 1")
def dedup_exact_first(spark, sf):
    return dedup.exact(twice(spark, sf), KEYS, "ts", "event_id").select("event_id")


@query(f"WITH {TWICE} SELECT event_id FROM twice QUALIFY row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY ts DESC, event_id DESC) = 1")
def dedup_exact_last(spark, sf):
    return dedup.exact(twice(spark, sf), KEYS, "ts", "event_id", "last").select("event_id")


@query(f"""WITH {TWICE}, x AS (SELECT event_id AS transaction_id, user_id, ts, product_id, value AS amount, CASE WHEN event_id % 2 = 0 THEN 'card' ELSE 'cash' END AS payment_method, CAST(floor(floor(epoch(ts)) / 600) AS BIGINT) AS b FROM twice), y AS (SELECT *, row_number() OVER (PARTITION BY user_id, b, product_id, amount, payment_method ORDER BY ts, transaction_id) AS er,
  lag(amount) OVER w AS pa, lag(product_id) OVER w AS pp, lag(payment_method) OVER w AS pm, floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS gap FROM x WINDOW w AS (PARTITION BY user_id, b ORDER BY ts, transaction_id)),
  z AS (SELECT transaction_id, er, round(CAST(0.4 * coalesce(1 - abs(amount - pa) / nullif(greatest(amount, pa), 0), 0) * CASE WHEN pa IS NULL THEN 0 ELSE 1 END + 0.3 * CASE WHEN product_id = pp THEN 1 ELSE 0 END + 0.2 * CASE WHEN payment_method = pm THEN 1 ELSE 0 END + 0.1 * CASE WHEN gap <= 300 THEN 1 - gap / 300 ELSE 0 END AS DOUBLE), 9) AS sim FROM y)
  SELECT transaction_id, round(sim, 6) AS overall_similarity, CASE WHEN er > 1 THEN 'exact' WHEN sim >= 0.75 THEN 'fuzzy' ELSE 'unique' END AS duplicate_type FROM z""")
def dedup_transactions(spark, sf):
    df = twice(spark, sf).select(F.col("event_id").alias("transaction_id"), "user_id", "ts", "product_id", F.col("value").alias("amount"), F.when(F.col("event_id") % 2 == 0, "card").otherwise("cash").alias("payment_method"))
    return dedup.transactions(df, 0.75).select("transaction_id", F.round("overall_similarity", 6).alias("overall_similarity"), "duplicate_type")


@query(f"""WITH {TWICE}, g AS (SELECT *, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS a, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))) AS s, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id, event_type, product_id ORDER BY ts, event_id))) AS v FROM twice)
  SELECT event_id, coalesce(a <= 1, false) AS is_rapid_fire, coalesce(s <= 30, false) OR coalesce(event_type = 'view' AND product_id IS NOT NULL AND v <= 300, false) AS is_duplicate FROM g""")
def dedup_user_behavior(spark, sf):
    return dedup.behavior(twice(spark, sf)).select("event_id", "is_rapid_fire", "is_duplicate")


@query(f"""WITH {TWICE}, k AS (SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY ts, event_id) = 1), a AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01') AS w, count(*) AS original, count(DISTINCT concat_ws('|', user_id, event_type, value)) AS distinct_keys FROM twice GROUP BY 1), b AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01') AS w, count(*) AS kept FROM k GROUP BY 1)
  SELECT w AS window_start, original, distinct_keys, coalesce(kept, 0) AS kept, original - coalesce(kept, 0) AS removed, round((original - coalesce(kept, 0)) / original, 6) AS duplicate_rate FROM a FULL JOIN b USING (w)""")
def dedup_statistics(spark, sf):
    df = twice(spark, sf)
    made = dedup.statistics(df, dedup.exact(df, KEYS, "ts", "event_id"), KEYS, "1 day")
    return made.select(F.col("window.start").alias("window_start"), "original", "distinct_keys", "kept", "removed", F.round("duplicate_rate", 6).alias("duplicate_rate"))


LATE = f"{BEHAVIOR}, d AS (SELECT event_id, ts, ts + to_seconds(CAST(k * 20 AS INTEGER)) AS processed, k * 20 AS delay FROM behavior)"


@query(f"WITH {LATE} SELECT event_id, CAST(floor(epoch(processed)) - floor(epoch(ts)) AS BIGINT) AS processing_delay_seconds, delay > 900 AS is_late_arrival FROM d")
def late_arrivals_flag(spark, sf):
    df = behavior(spark, sf).select("event_id", "ts", "k")
    return dedup.late(df, F.timestamp_add("SECOND", F.col("k") * 20, "ts")).select("event_id", "processing_delay_seconds", "is_late_arrival")


@query(f"WITH {LATE} SELECT event_id FROM d WHERE delay <= 900")
def late_arrivals_drop(spark, sf):
    return dedup.late(behavior(spark, sf).select("event_id", "ts", "k"), F.timestamp_add("SECOND", F.col("k") * 20, "ts"), strategy="drop").select("event_id")


@query(f"WITH {LATE} SELECT event_id, CASE WHEN delay > 900 THEN 'late' ELSE 'on_time' END AS side FROM d")
def late_arrivals_separate(spark, sf):
    on_time, late = dedup.late(behavior(spark, sf).select("event_id", "ts", "k"), F.timestamp_add("SECOND", F.col("k") * 20, "ts"), strategy="separate")
    return on_time.select("event_id", F.lit("on_time").alias("side")).unionByName(late.select("event_id", F.lit("late").alias("side")))
