"""Registered queries: models, monitoring, cases, sources and the table store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import cases, clv, ml
from tidemill.plans.bindings import AS_OF, TX, behavior, table, transactions
from tidemill.plans.queries_fraud import PAY, pay
from tidemill.plans.registry import query
from tidemill.sources import catalog, readers, retention
from tidemill.sources.tablestore import TableStore
from tidemill.streaming import runs


def r(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query()
def churn_model(spark, sf):
    """AUC of the churn model on held-out customers; quiet for 180 days counts as churned."""
    features = clv.churn_features(transactions(spark, sf), AS_OF, 180)
    train, test = ml.split(features, "customer_id")
    return spark.createDataFrame([("auc", ml.auc(ml.train_churn(train).transform(test)))], "metric string, value double")


@query()
def clv_prediction(spark, sf):
    features = clv.features(clv.historical(transactions(spark, sf)), AS_OF)
    model, _ = ml.train_clv(features)
    return ml.predict_clv(features, model).select("customer_id", "predicted_clv", "clv_confidence")


@query()
def clv_model_metrics(spark, sf):
    features = clv.features(clv.historical(transactions(spark, sf)), AS_OF)
    return spark.createDataFrame(sorted(ml.train_clv(features)[1].items()), "metric string, value double")


@query(f"""WITH {PAY}, e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM pay), f AS (SELECT *, count(*) OVER w AS n, sum(price) OVER w AS a, price / avg(price) OVER (PARTITION BY customer_id) AS d FROM e WINDOW w AS (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))
  SELECT transaction_id, n AS transactions_1h, round(a, 4) AS amount_1h, round(d, 6) AS amount_deviation, CAST(d > 3 OR n > 2 AND hour(ts) BETWEEN 0 AND 5 AS INTEGER) AS is_fraud FROM f""")
def fraud_model_features(spark, sf):
    return r(r(ml.fraud_features(pay(spark, sf)), "amount_1h", digits=4), "amount_deviation").select("transaction_id", "transactions_1h", "amount_1h", "amount_deviation", "is_fraud")


@query()
def fraud_model_ensemble(spark, sf):
    return ml.train_fraud(ml.fraud_features(pay(spark, sf)))[1]


@query()
def fraud_model_predictions(spark, sf):
    features = ml.written_features(ml.fraud_features(pay(spark, sf)))
    return ml.predict_fraud(features, ml.fraud_pipeline().fit(features)).select("transaction_id", "fraud_probability", "fraud_prediction")


@query()
def fraud_feature_importance(spark, sf):
    return ml.importances(ml.fraud_pipeline().fit(ml.written_features(ml.fraud_features(pay(spark, sf)))), spark)


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev({c}), 6) AS stddev, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem" for c in ("l_quantity", "l_extendedprice")) + ")")
def model_reference_statistics(spark, sf):
    made = ml.reference_statistics(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return r(made, "mean", "stddev", "min", "max", "q25", "median", "q75")


@query("""WITH a AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'), b AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'), """ + ", ".join(f"{c} AS (SELECT '{c}' AS feature, (SELECT avg({c}) FROM a) AS am, (SELECT stddev({c}) FROM a) AS asd, (SELECT quantile_cont({c}, 0.5) FROM a) AS amd, (SELECT avg({c}) FROM b) AS bm, (SELECT stddev({c}) FROM b) AS bsd, (SELECT quantile_cont({c}, 0.5) FROM b) AS bmd)" for c in ("l_quantity", "l_extendedprice", "l_discount")) + """,
  x AS (SELECT * FROM l_quantity UNION ALL SELECT * FROM l_extendedprice UNION ALL SELECT * FROM l_discount), s AS (SELECT feature, least(1.0, 0.5 * abs(bm - am) / asd + 0.3 * (1 - least(asd, bsd) / greatest(asd, bsd)) + 0.2 * coalesce(abs(bmd - amd) / nullif(abs(amd), 0), 0)) AS v FROM x)
  SELECT feature, round(v, 6) AS drift_score, v > 0.1 AS drifted FROM s""")
def model_drift(spark, sf):
    df = table(spark, sf, "lineitem")
    at = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return r(ml.drift(df.filter(at), df.filter(~at), ["l_quantity", "l_extendedprice", "l_discount"]), "drift_score")


@query(f"""WITH {TX}, p AS (SELECT transaction_id, CAST(amount > 250000 AS INTEGER) AS p, CAST(status = 'F' AS INTEGER) AS y FROM tx), c AS (SELECT count(*) FILTER (WHERE p = 1 AND y = 1) AS tp, count(*) FILTER (WHERE p = 1 AND y = 0) AS fp, count(*) FILTER (WHERE p = 0 AND y = 1) AS fn, count(*) FILTER (WHERE p = 0 AND y = 0) AS tn FROM p)
  SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def model_evaluation(spark, sf):
    tx = transactions(spark, sf)
    predictions, actuals = tx.select("transaction_id", (F.col("amount") > 250000).cast("int").alias("prediction")), tx.select("transaction_id", (F.col("status") == "F").cast("int").alias("actual"))
    return r(ml.evaluate(predictions, actuals), "accuracy", "precision", "recall", "f1")


@query()
def model_traffic_split(spark, sf):
    return ml.route(transactions(spark, sf), "customer_id", {"v1": 0.8, "v2": 0.2}).groupBy("model_version").agg(F.count("*").alias("n"), F.countDistinct("customer_id").alias("customers"))


@query(f"WITH {TX}, f AS (SELECT o_orderkey AS transaction_id, CAST(o_orderkey % 2 AS INTEGER) AS y FROM orders WHERE o_orderkey % 5 = 0) SELECT transaction_id, coalesce(y, 0) AS is_fraud FROM tx LEFT JOIN f USING (transaction_id) WHERE CAST(ts AS DATE) >= DATE '{AS_OF}' - INTERVAL 90 DAY AND CAST(ts AS DATE) <= DATE '{AS_OF}'")
def model_feedback_training_data(spark, sf):
    feedback = table(spark, sf, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("transaction_id"), (F.col("o_orderkey") % 2).cast("int").alias("is_fraud"))
    return ml.with_feedback(transactions(spark, sf), feedback, AS_OF).select("transaction_id", "is_fraud")


CASES = f"""{TX}, cs AS (SELECT transaction_id AS case_id, amount, ts AS opened, list_extract(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], CAST(transaction_id % 4 AS INTEGER) + 1) AS priority, list_extract(['open', 'in_progress', 'closed', 'escalated', 'closed'], CAST(transaction_id % 5 AS INTEGER) + 1) AS status,
  CASE WHEN transaction_id % 5 IN (2, 4) THEN ts + to_hours(CAST(transaction_id % 50 AS INTEGER)) END AS closed, CASE WHEN transaction_id % 3 = 0 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END AS resolution FROM tx)"""


def case_table(spark, sf):
    k = F.col("transaction_id")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (k % n).cast("int"))
    return transactions(spark, sf).select(
        k.alias("case_id"), "amount", F.col("ts").alias("opened"), pick(("CRITICAL", "HIGH", "MEDIUM", "LOW"), 4).alias("priority"), pick(("open", "in_progress", "closed", "escalated", "closed"), 5).alias("status"),
        F.when((k % 5).isin(2, 4), F.timestamp_add("HOUR", (k % 50).cast("int"), "ts")).alias("closed"), F.when(k % 3 == 0, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE").alias("resolution"),
    )


@query(f"WITH {CASES} SELECT case_id, priority, status FROM cs WHERE status IN ('open', 'in_progress', 'under_review', 'escalated') ORDER BY CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, opened, case_id LIMIT 50")
def case_queue(spark, sf):
    return cases.queue(case_table(spark, sf)).select("case_id", "priority", "status")


@query(f"""WITH {CASES}, x AS (SELECT *, (epoch(closed) - epoch(opened)) / 3600 AS h FROM cs) SELECT priority, count(*) AS cases, count(closed) AS resolved, round(avg(h), 6) AS avg_hours, round(avg(CASE WHEN closed IS NOT NULL THEN CAST(h <= CASE priority WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 24 ELSE 72 END AS INTEGER) END), 6) AS in_time FROM x GROUP BY 1""")
def case_service_levels(spark, sf):
    return r(cases.service_levels(case_table(spark, sf)), "avg_hours", "in_time")


@query(f"WITH {CASES} SELECT resolution, count(*) AS cases, round(sum(amount), 2) AS amount, round(avg(amount), 5) AS avg_amount FROM cs WHERE closed IS NOT NULL GROUP BY 1")
def case_financial_impact(spark, sf):
    return r(r(cases.financial_impact(case_table(spark, sf)), "amount", digits=2), "avg_amount", digits=5)


FEEDBACK = f"{TX}, fb AS (SELECT transaction_id, amount, transaction_id % 3 <> 0 AS fp, 'inv_' || CAST(transaction_id % 6 AS VARCHAR) AS investigator, (transaction_id % 10) / 10 AS confidence, CASE WHEN transaction_id % 2 = 0 THEN 'looks quite normal' ELSE 'ok' END AS comment, CASE WHEN transaction_id % 4 = 0 THEN ['velocity', 'amount'] WHEN transaction_id % 4 = 1 THEN ['amount'] ELSE ['time'] END AS rules FROM tx)"


def feedback_table(spark, sf):
    k = F.col("transaction_id")
    rules = F.when(k % 4 == 0, F.array(F.lit("velocity"), F.lit("amount"))).when(k % 4 == 1, F.array(F.lit("amount"))).otherwise(F.array(F.lit("time")))
    return transactions(spark, sf).select("transaction_id", "amount", (k % 3 != 0).alias("is_false_positive"), F.concat(F.lit("inv_"), (k % 6).cast("string")).alias("investigator"), ((k % 10) / 10).alias("confidence"), F.when(k % 2 == 0, "looks quite normal").otherwise("ok").alias("comment"), rules.alias("rules"))


@query(f"""WITH {FEEDBACK}, e AS (SELECT fp, 'amount' AS dimension, CASE WHEN amount >= 100000 THEN 'over_100k' WHEN amount >= 10000 THEN '10k_100k' WHEN amount >= 1000 THEN '1k_10k' ELSE 'under_1k' END AS member FROM fb UNION ALL SELECT fp, 'rule', unnest(rules) FROM fb)
  SELECT dimension, member, count(*) AS alerts, count(*) FILTER (WHERE fp) AS false_positives, round(count(*) FILTER (WHERE fp) / count(*), 6) AS rate FROM e GROUP BY 1, 2""")
def case_false_positives(spark, sf):
    return r(cases.false_positives(feedback_table(spark, sf)), "rate")


@query(f"WITH {FEEDBACK} SELECT investigator, count(*) AS feedback, round(avg(confidence), 6) AS avg_confidence, round(avg(CAST(fp AS INTEGER)), 6) AS false_positive_share, count(*) FILTER (WHERE length(comment) > 10) AS with_comment FROM fb GROUP BY 1")
def case_feedback_quality(spark, sf):
    return r(cases.feedback_quality(feedback_table(spark, sf)), "avg_confidence", "false_positive_share")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1996, 1998) AND month(o_orderdate) = 3 GROUP BY 1")
def lake_partitioned_table(spark, sf):
    """Written by year, month and day, read back with partition filters."""
    at = runs.folder(spark, "lake")
    readers.write_partitioned(transactions(spark, sf), at, "transactions")
    return readers.read_partitioned(spark, at, {"year": [1996, 1998], "month": 3}, ["year", "transaction_id"]).groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT fmt, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer, (VALUES ('csv'), ('json'), ('orc')) f(fmt) GROUP BY 1")
def lake_file_formats(spark, sf):
    at = runs.folder(spark, "formats")
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    out = []
    for fmt in ("csv", "json", "orc"):
        df.write.format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(f"{at}/{fmt}")
        out.append(readers.read_files(spark, f"{at}/{fmt}", fmt, schema=df.schema, stamp=True).select(F.lit(fmt).alias("fmt"), "c_acctbal"))
    return out[0].unionByName(out[1]).unionByName(out[2]).groupBy("fmt").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def lake_json_payloads(spark, sf):
    raw = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"))
    return readers.parse(raw, readers.struct({"k": "int"})).select(F.col("kafka_key").cast("long").alias("event_id"), "k")


def stored(spark, sf):
    """A table with five versions: half of the customers, the rest, a merge, a delete, and a rewrite."""
    store = TableStore(spark, runs.folder(spark, "store"))
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    store.create("customers", df.schema)
    store.append("customers", df.filter("c_custkey % 2 = 0"))
    store.append("customers", df.filter("c_custkey % 2 = 1"))
    store.merge("customers", df.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])
    store.delete("customers", "c_custkey % 10 = 1")
    store.optimize("customers", z_order=["c_custkey", "c_acctbal"])
    return store


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 1")
def lake_table_latest(spark, sf):
    return stored(spark, sf).read("customers")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def lake_time_travel(spark, sf):
    return stored(spark, sf).read("customers", version=1)


@query("SELECT * FROM (VALUES (0, 'CREATE', 0), (1, 'APPEND', 1), (2, 'APPEND', 2), (3, 'MERGE', 1), (4, 'DELETE', 1), (5, 'OPTIMIZE', 1)) t(version, operation, folders)".replace("t(version, operation, folders)", "t(v, operation, f)").replace("SELECT *", "SELECT CAST(v AS BIGINT) AS version, operation, CAST(f AS BIGINT) AS folders"))
def lake_table_history(spark, sf):
    return stored(spark, sf).history("customers").select("version", "operation", "folders")


@query("SELECT CAST(count(*) FILTER (WHERE d <= 365) AS BIGINT) AS hot, CAST(count(*) FILTER (WHERE d > 365 AND d <= 1500) AS BIGINT) AS warm, CAST(count(*) FILTER (WHERE d > 1500) AS BIGINT) AS expired, CAST(count(*) FILTER (WHERE d <= 1500) AS BIGINT) AS kept FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS d FROM orders)")
def lake_retention(spark, sf):
    store = TableStore(spark, runs.folder(spark, "retention"))
    store.append("orders", transactions(spark, sf))
    counts = store.retain("orders", "ts", 365, 1500, AS_OF, f"{store.root}/archive")
    return store.read("orders").agg(*[F.lit(counts[k]).cast("long").alias(k) for k in ("hot", "warm", "expired")], F.count("*").alias("kept"))


@query("SELECT * FROM (VALUES ('silver', 1), ('gold', 2), ('report', 2), ('dashboard', 3)) t(asset, distance)")
def lake_lineage(spark, sf):
    edges = spark.createDataFrame([("bronze", "silver", "clean"), ("silver", "gold", "join"), ("silver", "report", "sum"), ("gold", "dashboard", "view"), ("dashboard", "silver", "feedback")], catalog.EDGE)
    return catalog.reachable(edges, "bronze")


@query("SELECT * FROM (VALUES ('orders'), ('customer')) t(name)")
def lake_catalog_search(spark, sf):
    found = None
    for n in ("orders", "customer", "part"):
        e = catalog.entry(table(spark, sf, n), n, f"{sf}/{n}.parquet", tags=["sales"] if n == "orders" else [])
        found = e if found is None else found.unionByName(e)
    return catalog.search(found, "custkey").select("name")


@query("SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS segments FROM customer")
def lake_observed_metrics(spark, sf):
    from tidemill.operators.quality import null_metrics

    return null_metrics(table(spark, sf, "customer"), "nulls", ["c_acctbal", "c_name"]).agg(F.count("*").alias("n"), F.countDistinct("c_mktsegment").alias("segments"))


@query("SELECT user_id, sum(value) AS v FROM events GROUP BY 1".replace("sum(value)", "round(sum(value), 6)"))
def batch_amount_by_user(spark, sf):
    return behavior(spark, sf).groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("v"))


@query("""WITH c AS (SELECT l_returnflag AS category, count(*) AS n, avg(l_extendedprice) AS a FROM lineitem WHERE l_quantity > 10 GROUP BY 1), j AS (SELECT count(*) AS m FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey) SELECT category, n, round(a, 5) AS avg_price, m AS joined FROM c, j""")
def spark_batch_floor(spark, sf):
    """Filter, group and self equi-join: the shape of the one batch figure that was published."""
    made = table(spark, sf, "lineitem").filter("l_quantity > 10").groupBy(F.col("l_returnflag").alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 5).alias("avg_price"))
    o = table(spark, sf, "orders").select("o_orderkey")
    return made.withColumn("joined", o.join(o.withColumnRenamed("o_orderkey", "k"), F.col("o_orderkey") == F.col("k")).agg(F.count("*")).scalar())


@query("SELECT count(*) AS n, count(*) AS same FROM lineitem")
def fraud_model_reloaded(spark, sf):
    """A model that was saved and loaded again predicts what it predicted before."""
    at = runs.folder(spark, "model")
    features = ml.fraud_features(pay(spark, sf))
    model = ml.fraud_pipeline("logistic_regression").fit(features)
    ml.save_model(model, at)
    made = lambda m, name: ml.predict_fraud(features, m).select("transaction_id", F.col("fraud_probability").alias(name))
    both = made(model, "a").join(made(ml.load_model(at), "b"), "transaction_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("a") - F.col("b")) < 1e-9).alias("same"))


@query("SELECT * FROM (VALUES (1, 'retired', 0.0), (2, 'active', 0.75), (3, 'active', 0.25)) t(version, status, traffic)".replace("SELECT *", "SELECT CAST(version AS BIGINT) AS version, status, CAST(traffic AS DOUBLE) AS traffic"))
def model_registry(spark, sf):
    registry = ml.ModelRegistry(TableStore(spark, runs.folder(spark, "registry")))
    for i in range(3):
        registry.register("fraud", f"/models/{i}", {"auc": 0.9 + i / 100})
    registry.deploy("fraud", {1: 1.0})
    registry.deploy("fraud", {2: 3.0, 3: 1.0})
    return registry.versions("fraud").select("version", "status", "traffic")


@query("SELECT 'customers' AS \"table\", count(*) AS rows FROM customer WHERE c_custkey % 10 <> 1 UNION ALL SELECT 'orders', count(*) FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') <= 1500")
def lake_maintenance(spark, sf):
    """Retention, compaction and vacuum of all tables of a store."""
    store = stored(spark, sf)
    store.append("orders", transactions(spark, sf))
    report = store.maintain(("retain", "optimize", "vacuum"), retention_hours=0, rules={"orders": ("ts", 365, 1500)}, as_of=AS_OF)
    return report.filter("job = 'vacuum' AND outcome = 'done'").select("table", "rows")


@query("SELECT fmt, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer, (VALUES ('csv'), ('json'), ('parquet')) f(fmt) GROUP BY 1")
def report_exports(spark, sf):
    at = runs.folder(spark, "exports")
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.array("c_mktsegment").alias("segments"))
    out = None
    for fmt in ("csv", "json", "parquet"):
        readers.export(df, f"{at}/{fmt}", fmt)
        made = readers.read_files(spark, f"{at}/{fmt}", fmt, schema=df.drop("segments").schema if fmt != "csv" else "c_custkey long, c_acctbal double, segments string", transform=lambda x, fmt=fmt: x.select(F.lit(fmt).alias("fmt"), "c_acctbal"))
        out = made if out is None else out.unionByName(made)
    return out.groupBy("fmt").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT CASE WHEN d > 2555 THEN 'delete' WHEN d > 2190 THEN 'archive' WHEN d <= 30 THEN 'hot' WHEN d <= 90 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS rows FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS d FROM orders) GROUP BY 1")
def lake_retention_tiers(spark, sf):
    return retention.distribution(transactions(spark, sf), retention.rule_for("transactions"), "1998-08-02", "ts")


@query("SELECT 'orders' AS \"table\", count(*) AS rows, CAST(1 AS BIGINT) AS version, 'sales' AS owner, 'o_orderpriority' AS partitioned_by, true AS has_files FROM orders")
def lake_table_description(spark, sf):
    """Rows, version, properties and partitions of a table, and whether its files are found and measured."""
    store = TableStore(spark, runs.folder(spark, "description"))
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    store.create("orders", df.schema, ["o_orderpriority"], {"owner": "sales"})
    store.append("orders", df)
    d = store.describe("orders")
    return spark.createDataFrame([("orders", d["rows"], d["version"], d["properties"]["owner"], ",".join(d["partitions"]), d["files"] > 0 and d["bytes"] > 0)], "table string, rows long, version long, owner string, partitioned_by string, has_files boolean")


@query("SELECT * FROM (VALUES (1, 2), (2, 1)) t(distance, assets)".replace("SELECT *", "SELECT CAST(distance AS INTEGER) AS distance, CAST(assets AS BIGINT) AS assets"))
def lake_impact(spark, sf):
    edges = spark.createDataFrame([("orders", "revenue", "sum"), ("orders", "baskets", "group"), ("revenue", "dashboard", "view")], catalog.EDGE)
    return catalog.impact(edges, "orders")
