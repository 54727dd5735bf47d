"""Registered queries: data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import quality as dq
from tidemill.plans.bindings import BEHAVIOR, TX, behavior, table, transactions
from tidemill.plans.registry import query

NOW = "TIMESTAMP '1999-06-01 00:00:00'"
#: Orders as stream payloads, with gaps and wrong values from the keys.
PAYLOAD = f"""{TX}, pl AS (SELECT CASE WHEN transaction_id % 50 = 0 THEN 'short' ELSE 'transaction-' || CAST(transaction_id AS VARCHAR) END AS transaction_id, transaction_id AS k, CASE WHEN transaction_id % 40 = 0 THEN NULL ELSE customer_id + 1 END AS user_id, CASE WHEN transaction_id % 30 = 0 THEN -1.0 ELSE amount / 30 END AS total_amount,
  ts + to_hours(CAST(transaction_id % 24 AS INTEGER)) AS ts, list_extract(['credit_card', 'debit_card', 'paypal', 'cash', 'barter'], CAST(transaction_id % 5 AS INTEGER) + 1) AS payment_method, CASE WHEN transaction_id % 20 = 0 THEN 'EURO' ELSE 'EUR' END AS currency, CASE WHEN transaction_id % 9 = 0 THEN ' ' WHEN transaction_id % 9 = 1 THEN NULL ELSE 'Berlin' END AS location,
  CASE WHEN transaction_id % 7 = 0 THEN NULL ELSE transaction_id % 100 END AS product_id, status AS category FROM tx)"""


def payload(spark, sf):
    df = transactions(spark, sf)
    k = F.col("transaction_id")
    methods = F.array(*map(F.lit, ("credit_card", "debit_card", "paypal", "cash", "barter")))
    return df.select(
        F.when(k % 50 == 0, "short").otherwise(F.concat(F.lit("transaction-"), k.cast("string"))).alias("transaction_id"), k.alias("k"), F.when(k % 40 != 0, F.col("customer_id") + 1).alias("user_id"), F.when(k % 30 == 0, -1.0).otherwise(F.col("amount") / 30).alias("total_amount"),
        F.timestamp_add("HOUR", (k % 24).cast("int"), "ts").alias("ts"), F.get(methods, (k % 5).cast("int")).alias("payment_method"), F.when(k % 20 == 0, "EURO").otherwise("EUR").alias("currency"), F.when(k % 9 == 0, " ").when(k % 9 != 1, "Berlin").alias("location"),
        F.when(k % 7 != 0, k % 100).alias("product_id"), F.col("status").alias("category"),
    )


def r(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


RULES = ["length(transaction_id) >= 10", "user_id > 0", "total_amount > 0", "total_amount <= 10000", f"ts >= {NOW} - INTERVAL 1 HOUR", "payment_method IN ('credit_card', 'debit_card', 'paypal', 'bank_transfer', 'cash')", "length(currency) = 3", "location IS NULL OR trim(location) <> ''"]
VALID = PAYLOAD + ", va AS (SELECT *, " + ", ".join(f"coalesce({c}, false) AS f{i}" for i, c in enumerate(RULES)) + " FROM pl), vb AS (SELECT *, f0 AND f1 AND f2 AND f5 AND f6 AS validation_passed FROM va)"


@query(f"WITH {VALID} SELECT k, validation_passed, " + ", ".join(f"f{i} AS rule_{c.name}" for i, c in enumerate(dq.CHECKS["transaction"])) + " FROM vb")
def quality_validate(spark, sf):
    return dq.validate(payload(spark, sf), dq.CHECKS["transaction"], NOW).select("k", "validation_passed", *[f"rule_{c.name}" for c in dq.CHECKS["transaction"]])


@query(f"WITH {VALID} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {f}) AS passed, count(*) FILTER (WHERE NOT {f}) AS failed, round(count(*) FILTER (WHERE {f}) / count(*), 6) AS pass_rate FROM vb" for n, f in [(c.name, f"f{i}") for i, c in enumerate(dq.CHECKS["transaction"])] + [("validation_passed", "validation_passed")]))
def quality_validation_summary(spark, sf):
    return r(dq.validation_summary(dq.validate(payload(spark, sf), dq.CHECKS["transaction"], NOW)), "pass_rate")


OUT = """st AS (SELECT avg(total_amount) AS m, stddev(total_amount) AS sd, quantile_cont(total_amount, 0.25) AS a, quantile_cont(total_amount, 0.75) AS b FROM pl), o AS (SELECT pl.*, (total_amount - m) / sd AS z, coalesce(abs((total_amount - m) / sd) > 3, false) OR coalesce(total_amount < a - 1.5 * (b - a) OR total_amount > b + 1.5 * (b - a), false) AS outl FROM pl, st),
  an AS (SELECT *, hour(ts) >= 23 OR hour(ts) <= 5 AS tmp, total_amount IS NULL OR total_amount <= 0 AS biz FROM o)"""


@query(f"WITH {PAYLOAD}, {OUT} SELECT k, round(z, 6) AS total_amount_zscore, outl AS anomaly_statistical, tmp AS anomaly_temporal, biz AS anomaly_business, outl OR tmp OR biz AS is_anomaly FROM an")
def quality_anomalies(spark, sf):
    return r(dq.anomalies(payload(spark, sf)), "total_amount_zscore").select("k", "total_amount_zscore", "anomaly_statistical", "anomaly_temporal", "anomaly_business", "is_anomaly")


@query(f"WITH {PAYLOAD}, {OUT} SELECT k, concat_ws(',', CASE WHEN outl THEN 'statistical' END, CASE WHEN tmp THEN 'temporal' END, CASE WHEN biz THEN 'business' END) AS anomaly_types FROM an WHERE outl OR tmp OR biz")
def quality_anomaly_alerts(spark, sf):
    return dq.anomaly_alerts(dq.anomalies(payload(spark, sf))).select("k", F.array_join("anomaly_types", ",").alias("anomaly_types"))


@query(f"WITH {BEHAVIOR}, w AS (SELECT event_id, value, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01') AS w FROM behavior), z AS (SELECT event_id, (value - avg(value) OVER p) / nullif(stddev(value) OVER p, 0) AS z FROM w WINDOW p AS (PARTITION BY w)) SELECT event_id, round(z, 6) AS window_zscore, coalesce(abs(z) > 3, false) AS is_anomaly FROM z")
def quality_window_outliers(spark, sf):
    return r(dq.window_outliers(behavior(spark, sf), "value", "1 day"), "window_zscore").select("event_id", "window_zscore", "is_anomaly")


@query(f"WITH {BEHAVIOR}, m AS (SELECT user_id, date_trunc('minute', ts) AS m, count(*) AS n FROM behavior GROUP BY 1, 2), a AS (SELECT user_id, m, n > 1.2 * avg(n) OVER (PARTITION BY user_id) AS b FROM m) SELECT event_id, b AS anomaly_burst FROM behavior JOIN a ON a.user_id = behavior.user_id AND a.m = date_trunc('minute', ts)")
def quality_burst(spark, sf):
    return dq.burst(behavior(spark, sf), factor=1.2).select("event_id", "anomaly_burst")


@query(f"""WITH {BEHAVIOR}, s AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM behavior), n AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pv FROM s)
  SELECT event_id, n > 1.5 * avg(n) OVER (PARTITION BY user_id) AS anomaly_frequency, coalesce(value / nullif(pv, 0) > 5, false) AS anomaly_spike FROM n""")
def quality_pattern_deviations(spark, sf):
    return dq.deviations(behavior(spark, sf), count_factor=1.5).select("event_id", "anomaly_frequency", "anomaly_spike")


FLAGS = {
    "transaction_id": ("length(transaction_id) >= 10", 2.0), "user_id": ("user_id IS NOT NULL", 2.0), "total_amount": ("total_amount IS NOT NULL", 2.0), "currency": ("length(currency) = 3", 1.5), "payment_method": ("length(payment_method) >= 3", 1.5),
    "ts": ("ts IS NOT NULL", 2.0), "product_id": ("product_id IS NOT NULL", 1.0), "location": ("location IS NOT NULL", 0.5), "customer_tier": ("false", 0.5), "category": ("category IS NOT NULL AND trim(category) <> ''", 1.0),
}
DONE = PAYLOAD + ", cp AS (SELECT *, round(CAST((" + " + ".join(f"{w} * CAST(coalesce({c}, false) AS INTEGER)" for c, w in FLAGS.values()) + ") / 14.0 AS DOUBLE), 9) AS score FROM pl)"
CATEGORY = "CASE WHEN score >= 0.98 THEN 'excellent' WHEN score >= 0.95 THEN 'good' WHEN score >= 0.90 THEN 'fair' ELSE 'poor' END"


@query(f"WITH {DONE} SELECT k, round(score, 6) AS completeness_score, {CATEGORY} AS completeness_category, score >= 0.9 AS completeness_passed FROM cp")
def quality_completeness(spark, sf):
    return r(dq.completeness(payload(spark, sf), dq.FIELDS["transaction"]), "completeness_score").select("k", "completeness_score", "completeness_category", "completeness_passed")


@query(f"WITH {PAYLOAD} " + " UNION ALL ".join(f"SELECT '{n}' AS field, {str(f.required).lower()} AS required, count(*) FILTER (WHERE {c}) AS complete, round(count(*) FILTER (WHERE {c}) / count(*), 6) AS share, count(*) FILTER (WHERE {'true' if n == 'customer_tier' else n + ' IS NULL'}) AS nulls, count(*) FILTER (WHERE {'false' if n in ('customer_tier',) else f'trim(CAST({n} AS VARCHAR)) = ' + chr(39) * 2}) AS empty FROM pl" for (n, (c, _)), f in zip(FLAGS.items(), dq.FIELDS["transaction"], strict=True)))
def quality_completeness_report(spark, sf):
    return r(dq.completeness_report(dq.completeness(payload(spark, sf), dq.FIELDS["transaction"]), dq.FIELDS["transaction"]), "share")


@query(f"""WITH {VALID}, {OUT}, c AS (SELECT k, round(CAST((""" + " + ".join(f"{w} * CAST(coalesce({c}, false) AS INTEGER)" for c, w in FLAGS.values()) + """) / 14.0 AS DOUBLE), 9) AS score FROM pl), q AS (SELECT vb.k, validation_passed AS v, score >= 0.9 AS cpass, outl OR tmp OR biz AS a, score FROM vb JOIN an ON an.k = vb.k JOIN c ON c.k = vb.k),
  g AS (SELECT *, CASE WHEN v AND cpass AND NOT a THEN 100 WHEN v AND cpass AND a THEN 75 WHEN v AND NOT cpass THEN 50 WHEN NOT v THEN 25 ELSE 0 END AS s FROM q)
  SELECT CASE WHEN s >= 90 THEN 'excellent' WHEN s >= 75 THEN 'good' WHEN s >= 50 THEN 'fair' WHEN s >= 25 THEN 'poor' ELSE 'critical' END AS quality_level, count(*) AS rows, round(avg(s), 6) AS avg_score, round(avg(score), 6) AS avg_completeness, count(*) FILTER (WHERE a) AS anomalies, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM g GROUP BY 1""")
def quality_assessment(spark, sf):
    return r(dq.quality_dashboard(dq.assess(payload(spark, sf), "transaction", NOW)), "avg_score", "avg_completeness", "share")


def numbers(c):
    m = f"avg(x_{c})"
    return f"round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev({c}), 6) AS stddev, round(kurtosis_pop({c}), 4) AS kurtosis, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75, count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives" if m else ""


@query("SELECT 'c_acctbal' AS \"column\", count(c_acctbal) AS count, count(*) - count(c_acctbal) AS nulls, count(DISTINCT c_acctbal) AS \"distinct\", " + numbers("c_acctbal") + ", NULL::DOUBLE AS avg_length FROM customer UNION ALL SELECT 'c_name', count(c_name), count(*) - count(c_name), count(DISTINCT c_name), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, round(avg(length(c_name)), 6) FROM customer")
def quality_profile(spark, sf):
    made = dq.profile(table(spark, sf, "customer"), ["c_acctbal", "c_name"])
    made = r(r(made, "min", "max", "mean", "stddev", "q25", "median", "q75", "avg_length"), "kurtosis", digits=4)
    return made.select("column", "count", "nulls", "distinct", "min", "max", "mean", "stddev", "kurtosis", "q25", "median", "q75", "zeros", "negatives", "avg_length")


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def quality_top_values(spark, sf):
    return r(dq.top_values(table(spark, sf, "orders"), "o_orderpriority"), "share")


@query("SELECT round(avg(CAST(regexp_matches(url, '^[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$') AS INTEGER)), 6) AS email, round(avg(CAST(regexp_matches(url, '^https?://') AS INTEGER)), 6) AS url, round(avg(CAST(regexp_matches(url, '^-?\\d+(\\.\\d+)?$') AS INTEGER)), 6) AS numeric, 0.0::DOUBLE AS uuid, 'url' AS pattern FROM pages")
def quality_value_patterns(spark, sf):
    return r(dq.detect_patterns(table(spark, sf, "pages"), "url"), "email", "url", "numeric", "uuid")


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(COLS) for b in COLS[i + 1 :]))
def quality_correlations(spark, sf):
    return r(dq.correlations(table(spark, sf, "lineitem"), COLS), "r")


@query(f"""WITH {PAYLOAD} SELECT 'complete' AS rule, round((count(user_id) / count(*) + count(product_id) / count(*)) / 2, 6) AS score, (count(user_id) / count(*) + count(product_id) / count(*)) / 2 >= 0.95 AS passed FROM pl UNION ALL SELECT 'unique', round(count(DISTINCT transaction_id) / count(*), 6), count(DISTINCT transaction_id) / count(*) >= 0.95 FROM pl
  UNION ALL SELECT 'valid', round(avg(CAST(regexp_matches(currency, '^[A-Z]{{3}}$') AS INTEGER)), 6), avg(CAST(regexp_matches(currency, '^[A-Z]{{3}}$') AS INTEGER)) >= 0.9 FROM pl UNION ALL SELECT 'consistent', round(avg(CAST(total_amount > 0 AS INTEGER)), 6), avg(CAST(total_amount > 0 AS INTEGER)) >= 0.95 FROM pl
  UNION ALL SELECT 'timely', round(avg(CAST(ts >= {NOW} - INTERVAL 24 HOUR AS INTEGER)), 6), avg(CAST(ts >= {NOW} - INTERVAL 24 HOUR AS INTEGER)) >= 0.95 FROM pl UNION ALL SELECT 'accurate', round(avg(CAST(payment_method IN ('cash', 'paypal') AS INTEGER)), 6), avg(CAST(payment_method IN ('cash', 'paypal') AS INTEGER)) >= 0.95 FROM pl""")
def quality_table_rules(spark, sf):
    known = spark.createDataFrame([("cash",), ("paypal",)], "payment_method string")
    rules = [
        {"name": "complete", "type": "completeness", "columns": ["user_id", "product_id"]}, {"name": "unique", "type": "uniqueness", "columns": ["transaction_id"]}, {"name": "valid", "type": "validity", "columns": ["currency"], "pattern": "^[A-Z]{3}$", "threshold": 0.9},
        {"name": "consistent", "type": "consistency", "condition": "total_amount > 0"}, {"name": "timely", "type": "timeliness", "columns": ["ts"], "max_age_hours": 24}, {"name": "accurate", "type": "accuracy", "columns": ["payment_method"], "reference": known},
    ]
    return r(dq.table_rules(payload(spark, sf), rules, "1999-06-01 00:00:00"), "score")


@query("""WITH p AS (SELECT * FROM (VALUES ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), ('phone', '\\b\\d{3}[-.]?\\d{3}[-.]?\\d{4}\\b'), ('ssn', '\\b\\d{3}-\\d{2}-\\d{4}\\b'), ('credit_card', '\\b(?:\\d{4}[- ]?){3}\\d{4}\\b')) t(kind, pattern)), m AS (SELECT kind, avg(CAST(coalesce(regexp_matches(text, pattern), false) AS INTEGER)) AS share FROM documents, p GROUP BY 1)
  SELECT 'text' AS "column", kind, round(share, 6) AS share, share > 0.1 AS flagged FROM m""")
def quality_pii(spark, sf):
    return r(dq.detect_pii(table(spark, sf, "documents"), ["text"]), "share")


@query("SELECT 'null' AS \"check\", 'o_custkey' AS \"column\", count(*) FILTER (WHERE o_custkey IS NULL) AS failures FROM orders UNION ALL SELECT 'duplicate', 'o_custkey,o_orderdate', count(*) - count(DISTINCT (o_custkey, o_orderdate)) FROM orders UNION ALL SELECT 'range', 'o_totalprice', count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000) FROM orders UNION ALL SELECT 'form', 'o_orderpriority', count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]')) FROM orders")
def quality_table_checks(spark, sf):
    return dq.check_table(table(spark, sf, "orders"), ["o_custkey"], ["o_custkey", "o_orderdate"], {"o_totalprice": (1000, 400000)}, {"o_orderpriority": "^[1-3]"})


@query(f"WITH {PAYLOAD} SELECT k, CASE WHEN user_id IS NULL AND (total_amount < 0 OR total_amount > 10000) THEN 'user_id is null; total_amount out of range' WHEN user_id IS NULL THEN 'user_id is null' WHEN total_amount < 0 OR total_amount > 10000 THEN 'total_amount out of range' END AS quality_checks FROM pl")
def quality_messages(spark, sf):
    return dq.messages(payload(spark, sf), ["user_id"], "total_amount", 0, 10000).select("k", "quality_checks")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def quality_group_counts(spark, sf):
    return dq.group_counts(table(spark, sf, "events"), "event_type")
