"""Registered queries: RFM, lifetime value, cohorts, churn and journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import clv, journey, rfm
from tidemill.plans.bindings import AS_OF, BEHAVIOR, TX, behavior, transactions
from tidemill.plans.registry import query

METRICS = f"""{TX}, m AS (SELECT customer_id, date_diff('day', CAST(max(ts) AS DATE), DATE '{AS_OF}') AS recency_days, count(*) AS frequency, sum(amount) AS monetary,
  CAST(min(ts) AS DATE) AS first_purchase, CAST(max(ts) AS DATE) AS last_purchase, sum(amount) / count(*) AS avg_order_value FROM tx GROUP BY customer_id)"""


def case(table: dict) -> str:
    return "CASE " + " ".join(f"WHEN rfm_score IN ({', '.join(map(repr, codes))}) THEN '{name}'" for name, codes in table.items()) + f" ELSE '{rfm.OTHERWISE}' END"


def scored_sql(tiles: int, high: bool) -> str:
    r, o = ("DESC", "ASC") if high else ("ASC", "DESC")
    return f"""s AS (SELECT *, CAST(r AS VARCHAR) || CAST(f AS VARCHAR) || CAST(mo AS VARCHAR) AS rfm_score, r AS recency_score, f AS frequency_score, mo AS monetary_score FROM (
      SELECT *, CAST(ntile({tiles}) OVER (ORDER BY recency_days {r}, customer_id) AS INTEGER) AS r, CAST(ntile({tiles}) OVER (ORDER BY frequency {o}, customer_id) AS INTEGER) AS f,
      CAST(ntile({tiles}) OVER (ORDER BY monetary {o}, customer_id) AS INTEGER) AS mo FROM m))"""


PROFILES = f"""{METRICS}, {scored_sql(5, True)}, p AS (SELECT *, {case(rfm.SEGMENTS_5)} AS segment,
  CASE WHEN monetary_score >= 4 THEN 'High Value' WHEN monetary_score >= 3 THEN 'Medium Value' ELSE 'Low Value' END AS customer_value_tier,
  CASE WHEN recency_score >= 4 AND frequency_score >= 4 THEN 'Highly Engaged' WHEN recency_score >= 3 AND frequency_score >= 3 THEN 'Moderately Engaged' WHEN recency_score >= 3 THEN 'Recently Active'
    WHEN frequency_score >= 3 THEN 'Frequent but Dormant' ELSE 'Low Engagement' END AS engagement_level FROM s)"""


@query(f"WITH {METRICS} SELECT customer_id, CAST(recency_days AS INTEGER) AS recency_days, frequency, round(monetary, 2) AS monetary, first_purchase, last_purchase, round(avg_order_value, 7) AS avg_order_value FROM m")
def rfm_metrics(spark, sf):
    made = rfm.metrics(transactions(spark, sf), AS_OF)
    return made.withColumns({"monetary": F.round("monetary", 2), "avg_order_value": F.round("avg_order_value", 7)})


@query(f"WITH {METRICS}, {scored_sql(5, True)} SELECT customer_id, recency_score, frequency_score, monetary_score, rfm_score FROM s")
def rfm_customer_scores(spark, sf):
    return rfm.scores(rfm.metrics(transactions(spark, sf), AS_OF)).select("customer_id", "recency_score", "frequency_score", "monetary_score", "rfm_score")


@query(f"WITH {METRICS}, {scored_sql(4, False)} SELECT customer_id, rfm_score, {case(rfm.SEGMENTS_4)} AS segment FROM s")
def rfm_quartile_segments(spark, sf):
    return rfm.segments(rfm.scores(rfm.metrics(transactions(spark, sf), AS_OF), 4, "best_is_low"), 4).select("customer_id", "rfm_score", "segment")


@query(f"WITH {PROFILES} SELECT customer_id, segment, customer_value_tier, engagement_level, CAST(date_diff('day', first_purchase, last_purchase) AS INTEGER) AS customer_lifetime_days, round(frequency / nullif(date_diff('day', first_purchase, last_purchase) / 30, 0), 4) AS purchase_frequency_per_month, date_diff('day', first_purchase, DATE '{AS_OF}') <= 30 AS is_new_customer, segment IN ('At Risk', 'Cannot Lose Them', 'About to Sleep') AS is_at_risk FROM p")
def rfm_customer_profiles(spark, sf):
    made = rfm.profiles(transactions(spark, sf), AS_OF)
    return made.select("customer_id", "segment", "customer_value_tier", "engagement_level", "customer_lifetime_days", F.round("purchase_frequency_per_month", 4).alias("purchase_frequency_per_month"), "is_new_customer", "is_at_risk")


@query(f"""WITH {PROFILES} SELECT segment, count(*) AS customers, round(sum(monetary), 2) AS revenue, round(avg(monetary), 4) AS avg_monetary, round(avg(frequency), 4) AS avg_frequency, round(avg(recency_days), 4) AS avg_recency,
  max(monetary) AS max_monetary, min(monetary) AS min_monetary, round(stddev(monetary), 4) AS stddev_monetary, round(100 * sum(monetary) / sum(sum(monetary)) OVER (), 4) AS revenue_percentage FROM p GROUP BY segment""".replace("max(monetary)", "round(max(monetary), 2)").replace("min(monetary)", "round(min(monetary), 2)"))
def rfm_segment_summary(spark, sf):
    made = rfm.segment_summary(rfm.profiles(transactions(spark, sf), AS_OF))
    return made.select("segment", "customers", *[F.round(c, 2 if c in ("revenue", "max_monetary", "min_monetary") else 4).alias(c) for c in made.columns[2:]])


@query(f"""WITH {PROFILES}, c AS (SELECT customer_id, round(CAST(0.3 * recency_score + 0.3 * frequency_score + 0.4 * monetary_score AS DOUBLE), 6) AS composite_score FROM p), k AS (SELECT *, percent_rank() OVER (ORDER BY composite_score) AS customer_rank FROM c)
  SELECT customer_id, composite_score, round(customer_rank, 8) AS customer_rank FROM k WHERE customer_rank >= 0.8""")
def rfm_high_value_customers(spark, sf):
    return rfm.high_value(rfm.profiles(transactions(spark, sf), AS_OF)).select("customer_id", "composite_score", F.round("customer_rank", 8).alias("customer_rank"))


@query(f"WITH {PROFILES} SELECT segment, " + "CASE segment " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in rfm.ACTIONS.items()) + " END AS recommended_action, count(*) AS n FROM p GROUP BY segment")
def rfm_recommended_actions(spark, sf):
    return rfm.actions(rfm.profiles(transactions(spark, sf), AS_OF)).groupBy("segment", "recommended_action").agg(F.count("*").alias("n"))


BATCH = f"""{TX}, m AS (SELECT customer_id, date_diff('day', CAST(max(ts) AS DATE), DATE '{AS_OF}') AS recency_days, count(DISTINCT transaction_id) AS frequency, sum(amount) AS monetary FROM tx
  WHERE CAST(ts AS DATE) >= DATE '{AS_OF}' - INTERVAL 365 DAY AND CAST(ts AS DATE) <= DATE '{AS_OF}' GROUP BY customer_id), {scored_sql(5, True)}, g AS (SELECT *, CASE WHEN r >= 4 AND f >= 4 AND mo >= 4 THEN 'Champions' WHEN f >= 4 AND mo >= 4 THEN 'Loyal Customers'
  WHEN r >= 4 AND (f >= 3 OR mo >= 3) THEN 'Potential Loyalists' WHEN r >= 4 AND f <= 2 AND mo <= 2 THEN 'New Customers' WHEN r >= 3 AND f >= 2 AND mo >= 2 THEN 'Promising' WHEN r >= 3 AND f >= 3 AND mo >= 3 THEN 'Need Attention'
  WHEN r <= 2 AND f >= 3 AND mo >= 3 THEN 'About to Sleep' WHEN r <= 2 AND f >= 2 AND mo >= 3 THEN 'At Risk' WHEN r <= 2 AND f <= 2 AND mo >= 4 THEN 'Cannot Lose Them' WHEN r <= 2 AND f <= 2 AND mo <= 2 THEN 'Hibernating' ELSE 'Others' END AS customer_segment FROM s)"""


@query(f"WITH {BATCH} SELECT customer_id, frequency, round(monetary, 2) AS monetary, round(CAST(0.3 * r + 0.4 * f + 0.3 * mo AS DOUBLE), 2) AS customer_value_score, customer_segment FROM g")
def rfm_batch_scores(spark, sf):
    made = rfm.batch_segments(rfm.batch_metrics(transactions(spark, sf), AS_OF, 365))
    return made.select("customer_id", "frequency", F.round("monetary", 2).alias("monetary"), "customer_value_score", "customer_segment")


@query(f"WITH {BATCH} SELECT customer_segment, count(*) AS customers, round(sum(monetary), 2) AS revenue, round(avg(recency_days), 4) AS avg_recency, round(100 * count(*) / sum(count(*)) OVER (), 2) AS customer_percentage, round(100 * sum(monetary) / sum(sum(monetary)) OVER (), 2) AS revenue_percentage FROM g GROUP BY 1")
def rfm_batch_statistics(spark, sf):
    made = rfm.batch_statistics(rfm.batch_segments(rfm.batch_metrics(transactions(spark, sf), AS_OF, 365)))
    return made.withColumns({"revenue": F.round("revenue", 2), "avg_recency": F.round("avg_recency", 4)})


CLV = f"""{TX}, h AS (SELECT customer_id, sum(amount) AS total_revenue, count(*) AS total_orders, avg(amount) AS avg_order_value, CAST(min(ts) AS DATE) AS first_purchase, CAST(max(ts) AS DATE) AS last_purchase, stddev(amount) AS sd,
  date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days FROM tx GROUP BY customer_id), c AS (SELECT *, total_revenue * 0.2 AS historical_clv FROM h)"""


@query(f"""WITH {CLV} SELECT customer_id, round(total_revenue, 2) AS total_revenue, total_orders, round(historical_clv, 4) AS historical_clv, CAST(days AS INTEGER) AS customer_lifespan_days,
  round(CASE WHEN days > 0 THEN total_orders / (days / 30) ELSE total_orders END, 4) AS purchase_frequency, round(CASE WHEN total_orders > 1 THEN days / (total_orders - 1) ELSE 0 END, 4) AS days_between_orders,
  round(1 - coalesce(sd, 0) / avg_order_value, 6) AS order_value_consistency FROM c""")
def clv_historical(spark, sf):
    made = clv.historical(transactions(spark, sf))
    return made.select("customer_id", F.round("total_revenue", 2).alias("total_revenue"), "total_orders", F.round("historical_clv", 4).alias("historical_clv"), "customer_lifespan_days", *[F.round(c, 4).alias(c) for c in ("purchase_frequency", "days_between_orders")], F.round("order_value_consistency", 6).alias("order_value_consistency"))


MONTHS = f"""(12 * (year(DATE '{AS_OF}') - year(first_purchase)) + month(DATE '{AS_OF}') - month(first_purchase) + CASE WHEN day(DATE '{AS_OF}') = day(first_purchase) OR (last_day(first_purchase) = first_purchase AND last_day(DATE '{AS_OF}') = DATE '{AS_OF}') THEN 0 ELSE (day(DATE '{AS_OF}') - day(first_purchase)) / 31 END)"""


@query(f"""WITH {CLV}, f AS (SELECT *, {MONTHS} AS months FROM c) SELECT customer_id, CAST(date_diff('day', last_purchase, DATE '{AS_OF}') AS INTEGER) AS recency_days, round(months, 6) AS months_since_first_purchase,
  round(CASE WHEN months > 0 THEN total_orders / months ELSE total_orders END, 7) AS purchase_velocity, CASE WHEN months <= 3 THEN 'New' WHEN months <= 12 THEN 'Growing' WHEN months <= 24 THEN 'Mature' ELSE 'Veteran' END AS customer_maturity FROM f""")
def clv_features(spark, sf):
    made = clv.features(clv.historical(transactions(spark, sf)), AS_OF)
    return made.select("customer_id", "recency_days", F.round("months_since_first_purchase", 6).alias("months_since_first_purchase"), F.round("purchase_velocity", 7).alias("purchase_velocity"), "customer_maturity")


@query(f"WITH {CLV} SELECT count(*) AS customers, round(avg(historical_clv), 4) AS avg_clv, round(max(historical_clv), 4) AS max_clv, round(min(historical_clv), 4) AS min_clv, round(stddev(historical_clv), 4) AS stddev_clv, round(sum(historical_clv), 2) AS total_clv, round(sum(total_revenue), 2) AS total_revenue FROM c")
def clv_summary(spark, sf):
    made = clv.summary(clv.historical(transactions(spark, sf)))
    return made.select("customers", *[F.round(c, 2 if c.startswith("total") else 4).alias(c) for c in made.columns[1:]])


@query(f"WITH {CLV} SELECT customer_id, round(historical_clv, 4) AS historical_clv FROM c ORDER BY c.historical_clv DESC, customer_id LIMIT 20")
def clv_top_customers(spark, sf):
    return clv.top(clv.historical(transactions(spark, sf))).select("customer_id", F.round("historical_clv", 4).alias("historical_clv"))


@query(f"""WITH {PROFILES}, v AS (SELECT customer_id, sum(amount) * 0.2 / 1000 AS predicted_clv FROM tx GROUP BY 1)
  SELECT CASE WHEN segment = 'Champions' AND predicted_clv > 1000 THEN 'High Value Aligned' WHEN segment = 'Lost' AND predicted_clv < 100 THEN 'Low Value Aligned' WHEN segment IN ('Champions', 'Loyal Customers') AND predicted_clv < 500 THEN 'Segment Mismatch - Low CLV'
    WHEN segment IN ('Lost', 'Hibernating') AND predicted_clv > 800 THEN 'Segment Mismatch - High CLV' ELSE 'Standard Alignment' END AS clv_segment_alignment,
  CASE WHEN segment = 'Cannot Lose Them' THEN 'Critical' WHEN segment = 'At Risk' THEN 'High' WHEN segment IN ('Champions', 'Loyal Customers') THEN 'Medium' ELSE 'Low' END AS retention_priority, count(*) AS n FROM v LEFT JOIN p USING (customer_id) GROUP BY 1, 2""")
def clv_rfm_integration(spark, sf):
    tx = transactions(spark, sf)
    value = clv.historical(tx).select("customer_id", (F.col("historical_clv") / 1000).alias("predicted_clv"))
    return clv.with_segments(value, rfm.profiles(tx, AS_OF)).groupBy("clv_segment_alignment", "retention_priority").agg(F.count("*").alias("n"))


def cohort_sql(label: str) -> str:
    return f"""WITH {TX}, f AS (SELECT *, min(ts) OVER (PARTITION BY customer_id) AS first FROM tx) SELECT {label.format('first')} AS cohort, {label.format('ts')} AS period, date_diff('month', first, ts) AS months_since,
      count(*) AS orders, count(DISTINCT customer_id) AS customers, round(sum(amount), 2) AS revenue FROM f GROUP BY 1, 2, 3"""


def cohort(spark, sf, unit):
    return clv.cohorts(transactions(spark, sf), unit).withColumn("revenue", F.round("revenue", 2))


@query(cohort_sql("strftime({}, '%Y-%m')"))
def cohort_monthly(spark, sf):
    return cohort(spark, sf, "month")


@query(cohort_sql("year({0}) || '-Q' || quarter({0})"))
def cohort_quarterly(spark, sf):
    return cohort(spark, sf, "quarter")


@query(cohort_sql("strftime({}, '%Y')"))
def cohort_yearly(spark, sf):
    return cohort(spark, sf, "year")


@query(f"""WITH c AS ({cohort_sql("strftime({}, '%Y')").replace("date_diff('month', first, ts) AS months_since,", "")}), d AS (SELECT cohort, period, customers FROM (SELECT cohort, period, customers FROM (WITH {TX}, f AS (SELECT *, min(ts) OVER (PARTITION BY customer_id) AS first FROM tx)
  SELECT strftime(first, '%Y') AS cohort, strftime(ts, '%Y') AS period, count(DISTINCT customer_id) AS customers FROM f GROUP BY 1, 2)))
  SELECT cohort, period, customers, first_value(customers) OVER w AS cohort_size, round(100 * customers / first_value(customers) OVER w, 4) AS retention FROM d WINDOW w AS (PARTITION BY cohort ORDER BY period)""")
def cohort_retention(spark, sf):
    yearly = transactions(spark, sf).withColumn("amount", F.lit(0.0))
    first = clv.cohorts(yearly.withColumn("ts", F.date_trunc("year", "ts")), "year")
    return clv.retention(first).drop("months_since")


@query(f"WITH {METRICS} SELECT customer_id, CAST(recency_days AS INTEGER) AS recency, frequency, round(monetary, 2) AS monetary, CAST(recency_days > 30 AS INTEGER) AS label FROM m")
def churn_features(spark, sf):
    return clv.churn_features(transactions(spark, sf), AS_OF).withColumn("monetary", F.round("monetary", 2))


SESSIONS = f"""{BEHAVIOR}, b AS (SELECT *, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) <= 1800 THEN 0 ELSE 1 END AS starts FROM behavior WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  sess AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM b), j AS (SELECT *, CAST(user_id AS VARCHAR) || '_' || CAST(session_no AS VARCHAR) AS session_id FROM sess)"""


@query(f"WITH {SESSIONS} SELECT event_id, session_no, session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS INTEGER) AS touchpoint_order FROM j")
def journey_touchpoints(spark, sf):
    return journey.touchpoints(journey.sessions(behavior(spark, sf))).select("event_id", "session_no", "session_id", "touchpoint_order")


@query(f"""WITH {BEHAVIOR}, d AS (SELECT CAST(ts AS DATE) AS session_id, user_id, max(CAST(event_type = 'view' AS INTEGER)) AS a, max(CAST(event_type = 'click' AS INTEGER)) AS b, max(CAST(event_type = 'signup' AS INTEGER)) AS c, max(CAST(event_type = 'purchase' AS INTEGER)) AS d FROM behavior GROUP BY 1, 2)
  SELECT 1 AS step_no, 'view' AS step, CAST(sum(a) AS BIGINT) AS sessions FROM d WHERE a = 1 UNION ALL SELECT 2, 'click', CAST(sum(b) AS BIGINT) FROM d WHERE a = 1 UNION ALL SELECT 3, 'signup', CAST(sum(c) AS BIGINT) FROM d WHERE a = 1 UNION ALL SELECT 4, 'purchase', CAST(sum(d) AS BIGINT) FROM d WHERE a = 1""")
def journey_funnel(spark, sf):
    days = behavior(spark, sf).withColumn("session_id", F.concat_ws("_", "user_id", F.to_date("ts").cast("string")))
    return journey.funnel(days, ["view", "click", "signup", "purchase"])


@query(f"""WITH {BEHAVIOR}, d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CAST(event_type = 'view' AS INTEGER)) AS a, max(CAST(event_type = 'purchase' AS INTEGER)) AS b FROM behavior GROUP BY 1, 2)
  SELECT count(*) AS starts, CAST(sum(b) AS BIGINT) AS conversions, round(sum(b) / count(*), 6) AS conversion_rate FROM d WHERE a = 1""")
def journey_conversion_rate(spark, sf):
    days = behavior(spark, sf).withColumn("session_id", F.concat_ws("_", "user_id", F.to_date("ts").cast("string")))
    return journey.conversion_rate(days, "view", "purchase").withColumn("conversion_rate", F.round("conversion_rate", 6))
