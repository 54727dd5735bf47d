"""Small fixtures with known rows, errors, invariants and plans."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import ranking, scalars
from tidemill.operators import attribution, clv, dedup, enrich, fraud, journey, joins, ml, product, quality, revenue, rfm
from tidemill.plans.bindings import behavior, transactions
from tidemill.sources import catalog, readers
from tidemill.sources.tablestore import ConcurrentCommit, TableStore
from tidemill.streaming import runs

AT = dt.datetime(2025, 1, 1, 10, 0)


def at(minutes):
    return AT + dt.timedelta(minutes=minutes)


@pytest.fixture
def journeys(spark):
    rows = [("sess1", "user1", "page_view", at(0)), ("sess1", "user1", "add_to_cart", at(5)), ("sess1", "user1", "purchase", at(10)), ("sess2", "user2", "page_view", at(60)), ("sess2", "user2", "add_to_cart", at(65)), ("sess3", "user3", "page_view", at(120))]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, session_id string, user_id string, event_type string, ts timestamp")


def test_touchpoints_and_funnel(journeys):
    made = journey.touchpoints(journeys).orderBy("event_id").collect()
    assert [r["touchpoint_order"] for r in made[:3]] == [1, 2, 3]
    assert [r["sessions"] for r in journey.funnel(journeys, ["page_view", "add_to_cart", "purchase"]).orderBy("step_no").collect()] == [3, 2, 1]
    assert journey.conversion_rate(journeys, "page_view", "purchase").first()["conversion_rate"] == pytest.approx(1 / 3)
    assert journey.conversion_rate(journeys, "nothing", "purchase").first()["conversion_rate"] == 0.0


def test_simple_fraud_rules(spark):
    rows = [("txn1", "user1", 100.0, 1), ("txn2", "user1", 1500.0, 1), ("txn3", "user2", 50.0, 10), ("txn4", "user3", 200.0, 1), ("txn5", "user4", 3000.0, 2)]
    df = spark.createDataFrame(rows, "transaction_id string, user_id string, amount double, quantity int")
    made = fraud.simple_rules(df, [fraud.Rule("high_value", "amount > 1000", "high"), fraud.Rule("bulk", "quantity > 5", "medium")])
    got = {r["transaction_id"]: (r["fraud_score"], r["fraud_alerts"]) for r in made.collect()}
    assert got["txn2"] == (1.0, ["high_value"]) and got["txn3"] == (0.5, ["bulk"]) and got["txn1"] == (0.0, [])


def test_rfm_single_purchase_has_no_monthly_frequency(spark):
    df = spark.createDataFrame([(1, AT, 10.0), (2, AT, 20.0), (2, at(60 * 24 * 30), 5.0)], "customer_id long, ts timestamp, amount double")
    got = {r["customer_id"]: r for r in rfm.profiles(df, "2025-03-01").collect()}
    assert got[1]["purchase_frequency_per_month"] is None and got[2]["purchase_frequency_per_month"] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        rfm.scores(df, orientation="sideways")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "customer_id long, ts timestamp, amount double")
    assert rfm.profiles(empty, "2025-03-01").count() == 0
    assert clv.historical(empty).count() == 0
    assert clv.cohorts(empty).count() == 0


def test_statistical_outlier(spark):
    df = spark.createDataFrame([(float(x),) for x in [100, 105, 95, 110, 90, 100, 101, 99, 103, 97, 1000]], "price double")
    assert [r["price"] for r in quality.outliers(df, "price").filter("price_outlier").collect()] == [1000.0]


@pytest.mark.parametrize(("text", "want"), [("1 hour", 3600), ("30 seconds", 30), ("2 days", 172800), ("1 week", 604800)])
def test_durations(text, want):
    assert scalars.seconds(text) == want


@pytest.mark.parametrize("text", ["", "soon", "5", "5 parsecs", "-1 hour"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        scalars.seconds(text)


def test_bad_arguments(spark, sf):
    tx = transactions(spark, sf)
    for wrong in (lambda: scalars.period(F.col("ts"), "eon"), lambda: attribution.weight("guess"), lambda: dedup.exact(tx, ["customer_id"], "ts", "transaction_id", "middle"), lambda: enrich.anonymize(tx, ["status"], "burn"), lambda: dedup.late(tx, F.current_timestamp(), strategy="ask")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(ValueError):
        revenue.forecast(revenue.daily(tx.withColumn("revenue", F.col("amount")).limit(5)))


def test_enrichment_of_nulls(spark):
    df = spark.createDataFrame([(None, None, "books", None, None, None, None, None, None)], "customer_tier string, customer_lifetime_value double, category string, product_id long, price double, location string, total_amount double, quantity int, payment_method string").withColumn("ts", F.lit(None).cast("timestamp"))
    got = enrich.transactions(df).first()
    assert got["customer_tier_normalized"] == "Unknown" and got["sub_category"] is None and got["main_category"] == "books"
    assert got["revenue_impact"] == 0.0 and got["popularity_score"] == 0 and got["risk_score"] == 0 and got["transaction_size"] == "Micro"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0, 5000), st.integers(0, 30), st.one_of(st.none(), st.sampled_from(["", "x", "x/y", "New York City"]))), min_size=1, max_size=20))
def test_enrichment_keeps_rows_and_columns(spark, values):
    df = spark.createDataFrame([(i, a, q, t) for i, (a, q, t) in enumerate(values)], "id long, total_amount double, quantity int, location string")
    df = df.withColumns({"price": F.col("total_amount"), "product_id": F.col("id"), "category": F.col("location"), "customer_tier": F.col("location"), "customer_lifetime_value": F.col("total_amount"), "payment_method": F.lit("cash"), "ts": F.lit(AT)})
    made = enrich.transactions(df)
    assert made.count() == len(values) and set(df.columns) <= set(made.columns)
    for r in made.collect():
        assert r["revenue_impact"] == pytest.approx(0.2 * r["total_amount"])
        assert r["transaction_size"] == ("Large" if r["total_amount"] >= 200 else "Medium" if r["total_amount"] >= 50 else "Small" if r["total_amount"] >= 10 else "Micro")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=60), st.integers(1, 7))
def test_distributed_ranks_are_those_of_windows(spark, values, tiles):
    from pyspark.sql import Window as W

    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    want = {r["id"]: (r["t"], r["n"], r["p"]) for r in df.select("id", F.ntile(tiles).over(W.orderBy("v", "id")).alias("t"), F.row_number().over(W.orderBy("v", "id")).alias("n"), F.percent_rank().over(W.orderBy("v")).alias("p")).collect()}
    made = ranking.with_percent_rank(ranking.with_row_number(ranking.with_ntiles(df, tiles, "id", {"t": (F.col("v"), False)}), "n", F.col("v"), "id"), "p", F.col("v"))
    assert {r["id"]: (r["t"], r["n"], r["p"]) for r in made.collect()} == want


def test_attribution_weights_add_up(spark):
    touches = spark.createDataFrame([(i, 1, f"c{i}", "x", at(i)) for i in range(4)], "touchpoint_id long, user_id long, channel string, campaign_id string, ts timestamp")
    conversions = spark.createDataFrame([(9, 1, at(60), 100.0), (8, 1, at(2), 50.0)], "conversion_id long, user_id long, conversion_ts timestamp, conversion_value double")
    paths = attribution.paths(touches, conversions)
    assert paths.filter("conversion_id = 9").count() == 4 and paths.filter("conversion_id = 8").count() == 3
    for model in attribution.MODELS:
        total = attribution.attributed(paths, model, normalize=True).groupBy("conversion_id").agg(F.sum("attribution_weight").alias("w")).collect()
        assert all(r["w"] == pytest.approx(1.0) for r in total)


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 1)], "k long, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 2, "c")], "k long, u long, v string")
    got = {(r["k"], r["t"]): r["v"] for r in joins.as_of_join(left, right, "k", "t", "u", ["v"]).collect()}
    assert got == {(1, 10): "b", (1, 5): "a", (2, 1): None}


def test_baskets_without_repeats(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 7)], "transaction_id long, product_id long")
    assert [r["items"] for r in product.baskets(df).collect()] == [[5, 6]]


def test_rows_of_trailing_spans_travel_once(spark, sf, capsys):
    tx = transactions(spark, sf).withColumnRenamed("amount", "price").withColumn("merchant_id", F.col("transaction_id") % 5)
    fraud.velocity(tx).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan


def test_accuracy_of_rules_is_of_the_row(spark):
    """Also where an alert's id repeats; a rule without history does not count, and none known is 0.5."""
    rows = [(1, ["a", "b"]), (1, ["b", "new"]), (2, ["new"]), (3, [])]
    alerts = spark.createDataFrame([(i, 1, 1, 10.0, at(0), "cash", "HIGH", r) for i, r in rows], "alert_id long, customer_id long, merchant_id long, price double, ts timestamp, payment_method string, max_severity string, triggered_rules array<string>")
    history = spark.createDataFrame([("a", "TRUE_POSITIVE"), ("b", "FALSE_POSITIVE"), (None, "TRUE_POSITIVE")], "rule string, resolution string")
    made = fraud.prioritize(alerts, F.lit(at(0)), history=history)
    assert sorted((r["alert_id"], r["triggered_rules"], r["historical_accuracy_factor"]) for r in made.collect()) == [(1, ["a", "b"], 0.5), (1, ["b", "new"], 0.0), (2, ["new"], 0.5), (3, [], 0.5)]


def test_equal_revenues_are_ties_in_any_order_of_addition(spark):
    rows = [(1, 0.3), (1, 0.2), (1, 0.1), (2, 0.1), (2, 0.2), (2, 0.3)]  # 0.6 and 0.6000000000000001
    made = revenue.concentration(spark.createDataFrame(rows, "customer_id long, revenue double").coalesce(1), "customer_id")
    assert {r["customer_id"]: r["row_rank"] for r in made.collect()} == {1: 1, 2: 2}


def test_itemsets_grow_by_rounds(spark, monkeypatch):
    """As FP-growth finds them, without its trees; a long basket, and rare items that go first."""
    from collections import Counter
    from itertools import combinations

    from pyspark.ml.fpm import FPGrowth

    monkeypatch.setattr(FPGrowth, "fit", lambda *_: pytest.fail("all trees of a partition in memory"))
    every = [[1, 2, 3, 4], [1, 2, 3], [1, 2, 4, 9], [2, 3], list(range(1, 9)), list(range(100, 160))]
    count = Counter(x for b in every for n in range(1, 5 if len(b) > 9 else 9) for x in combinations(b, n))
    sets, rules = product.frequent_itemsets(spark.createDataFrame(list(enumerate(every)), "transaction_id long, items array<long>"), 0.3, 0.5)
    want = {x: n for x, n in count.items() if n >= 2}
    assert {tuple(r["items"]): r["freq"] for r in sets.collect()} == want and max(map(len, want)) == 4
    shares = {(tuple(a for a in x if a != b), b): n / want[tuple(a for a in x if a != b)] for x, n in want.items() if len(x) > 1 for b in x}
    got = {(tuple(r["antecedent"]), r["consequent"][0]): r for r in rules.collect()}
    assert {k: r["confidence"] for k, r in got.items()} == pytest.approx({k: c for k, c in shares.items() if c >= 0.5})
    assert all(r["lift"] == pytest.approx(r["confidence"] / (want[k[1],] / 6)) for k, r in got.items())


def test_item_similarity_of_users_with_many_products(spark):
    rows = [(u, p, 1.0 + (u * p) % 5) for u in (1, 2) for p in range(520)] + [(3, 0, 2.0), (3, 1, 3.0)]
    got = {(r["product_a"], r["product_b"]): (r["common"], r["similarity"]) for r in product.item_similarity(spark.createDataFrame(rows, "customer_id long, product_id long, rating double")).collect()}
    rating = {(u, p): x for u, p, x in rows}
    norm = {p: sum(rating.get((u, p), 0) ** 2 for u in (1, 2, 3)) ** 0.5 for p in range(520)}
    assert set(got) == {(p, q) for q in range(520) for p in range(q)} and got[0, 1][0] == 3 and got[7, 300][0] == 2
    for p, q in ((0, 1), (7, 300), (18, 519), (250, 251)):
        dot = sum(rating.get((u, p), 0) * rating.get((u, q), 0) for u in (1, 2, 3))
        assert got[p, q][1] == pytest.approx(dot / (norm[p] * norm[q]))


def test_item_similarity_of_products_with_many_users(spark, monkeypatch):
    monkeypatch.setattr(product, "PRODUCT_USERS", 7)
    rows = [(u, p, 1.0 + (u + p) % 3) for u in range(30) for p in range(6) if (u * p) % 4 < 3]
    got = {(r["product_a"], r["product_b"]): r["common"] for r in product.item_similarity(spark.createDataFrame(rows, "customer_id long, product_id long, rating double")).collect()}
    users = {p: {u for u, q, _ in rows if q == p} for p in range(6)}
    assert got == {(p, q): len(users[p] & users[q]) for q in range(6) for p in range(q)}


def test_content_profiles_of_lines(spark):
    made = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (2, 1, "x"), (2, 3, "x"), (None, 2, "y")], "customer_id long, product_id long, category string")
    features = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "product_id long, category string")
    assert {(r["category"], tuple(r["products"]), r["users"]) for r in product.content_profiles(features, made).collect()} == {("x", (1,), 2), ("y", (2,), 0), (None, (3,), 1)}


def test_plans(spark, sf, capsys):
    """No Python in plans, filters and columns at the scan."""
    made = fraud.apply_rules(fraud.velocity(transactions(spark, sf).withColumnsRenamed({"amount": "price"}).withColumn("merchant_id", F.lit(1)), {"1h": "1 hour"}))
    made.explain()
    assert "Python" not in capsys.readouterr().out
    enrich.date_range(transactions(spark, sf), "ts", "1997-01-01").select("amount").explain()
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate" in plan.replace("o_orderdate:timestamp_ntz,o_totalprice:double", "o_totalprice:double,o_orderdate")


def test_table_store(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    store.append("t", df)
    store.merge("t", spark.createDataFrame([(2, "B"), (3, "C")], "id long, v string"), ["id"])
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a"), (2, "B"), (3, "C")]
    with pytest.raises(ValueError):
        store.append("t", df.withColumn("w", F.lit(1)))
    store.append("t", spark.createDataFrame([(4, "d", 1)], "id long, v string, w int"), merge_schema=True)
    assert store.read("t").filter("w IS NULL").count() == 3 and store.read("t", version=0).columns == ["id", "v"]
    store.delete("t", "id = 1")
    store.restore("t", 0)
    assert store.read("t").count() == 2 and [r["operation"] for r in store.history("t").collect()][0] == "RESTORE 0"
    with pytest.raises(ConcurrentCommit):
        store._commit("t", store.log("t")[-1])
    gone = store.vacuum("t", retention_hours=0)
    assert gone and store.read("t").count() == 2
    with pytest.raises(ValueError):
        store.read("t", version=1)
    assert store.erase("t", "v", "a") and store.read("t").count() == 1 and store.describe("t")["rows"] == 1


def test_partition_advice_and_unknown_sink(spark, sf):
    assert readers.partition_advice("transactions", 1000) == ["year", "month"]
    assert readers.partition_advice("user_events", 20_000_000) == ["year", "month", "day", "event_type"]
    with pytest.raises(ValueError):
        readers.write_stream(runs.stream_table(spark, sf, "events", "ts"), "fax", "/nowhere")
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, "jdbc:none", "SELECT 1", "id")


def test_lineage_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", ""), ("b", "a", ""), ("b", "c", "")], catalog.EDGE)
    assert {r["asset"]: r["distance"] for r in catalog.reachable(edges, "a").collect()} == {"b": 1, "c": 2}
    assert {r["asset"] for r in catalog.reachable(edges, "c", downstream=False).collect()} == {"a", "b"}


def test_consumers(spark, sf):
    consumers = runs.Consumers()
    consumers.register("events", lambda: runs.stream_table(spark, sf, "events", "ts").writeStream.format("noop").option("checkpointLocation", runs.folder(spark, "c")).trigger(availableNow=True).start())
    assert consumers.health("events")["state"] == "not started"
    consumers.start("events").awaitTermination()
    assert consumers.health("events")["state"] == "stopped" and consumers.restart_failed() == []
    with pytest.raises(ValueError):
        consumers.register("events", lambda: None)


def test_drift_of_the_same_data_is_zero(spark, sf):
    df = behavior(spark, sf)
    assert ml.drift(df, df, ["value"]).first()["drift_score"] == pytest.approx(0.0, abs=1e-9)


def test_fraud_learners_have_their_full_size(spark, sf, monkeypatch):
    forest, boosted = (ml.fraud_pipeline(k).getStages()[-1] for k in ("random_forest", "gradient_boosting"))
    assert (forest.getNumTrees(), forest.getMaxDepth(), boosted.getMaxIter(), boosted.getMaxDepth()) == (100, 10, 100, 5)
    made, kinds = ml.fraud_pipeline, []
    monkeypatch.setattr(ml, "fraud_pipeline", lambda kind="random_forest": kinds.append(kind) or made(kind))
    from tidemill.plans.all_queries import QUERIES

    QUERIES["fraud_model_predictions"](spark, sf)
    rows = [(i, i % 50, f"m{i % 3}", 10.0 + i % 7 * 100, at(60 * i)) for i in range(300)]
    tx = spark.createDataFrame(rows, "transaction_id long, customer_id long, payment_method string, price double, ts timestamp").withColumn("is_fraud", (F.col("price") > 500).cast("int"))
    features = ml.fraud_features(tx)
    assert ml.cross_validate(features, "random_forest", 2) > 0.9 and ml.cross_validate(features, "logistic_regression", 2) > 0.9
    assert kinds == ["random_forest", "random_forest", "logistic_regression"]


def test_affinity_and_cross_sell_are_of_whole_products(spark, sf):
    from collections import Counter, defaultdict
    from itertools import combinations

    from tidemill.plans.all_queries import QUERIES

    found = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        found[r[0]].add(r[1])
    count = Counter(x for b in found.values() if len(b) > 1 for n in range(1, len(b) + 1) for x in combinations(sorted(b), n))
    affinity, cross = {}, Counter()
    for x, n in count.items():
        for b in x if n > 1 and len(x) > 1 else ():
            rest = tuple(a for a in x if a != b)
            share = n / count[rest]
            for a in rest if share >= 0.05 else ():
                affinity[a, b] = max(affinity.get((a, b), 0), share)
                cross[a, b] += share > 0.1
    assert {(r["product_a"], r["product_b"]): r["max_confidence"] for r in QUERIES["product_affinity"](spark, sf).collect()} == pytest.approx(affinity, abs=1e-6)  # the query rounds
    assert Counter((r["product"], r["recommended"]) for r in QUERIES["product_cross_sell"](spark, sf).collect()) == +cross


def test_ranges_of_equal_values_are_cut(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("v"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("few"))
    for name, share in (("v", 0.9), ("few", 0.25)):  # nine in ten are equal; a quarter is null
        made = ranking.ranged(rows, F.col(name), "id")
        assert share * 20_000 > 10 * max(r["count"] for r in made.groupBy("_range").count().collect())
        got = [r["id"] for r in ranking.with_row_number(rows, "n", F.col(name), "id").orderBy("n").collect()]
        want = sorted(range(20_000), key=lambda i: ((1 if i % 10 else i), i) if name == "v" else ((i if i % 4 else -1), i))
        assert got == want


def test_traffic_goes_by_the_hash_of_the_key(spark):
    xxhash = pytest.importorskip("xxhash")
    shares = {"v1": 0.5, "v2": 0.2, "v3": 0.3}
    got = {r["k"]: r["model_version"] for r in ml.route(spark.range(-2000, 2000).withColumnRenamed("id", "k"), "k", shares).collect()}

    def version(key):
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        at = (h - (1 << 64) if h >> 63 else h) % 10_000 / 10_000
        return "v1" if at < 0.5 else "v2" if at < 0.7 else "v3"

    assert got == {k: version(k) for k in range(-2000, 2000)}


def test_streamed_detection_sees_across_batches_and_takes_refreshed_scores(spark, tmp_path):
    from tidemill.streaming import detection

    rows = [(i, 1 + i % 2, 7, 10.0 * i, at(20 * i), "paypal" if i % 3 else "cash") for i in range(12)]
    schema = "transaction_id long, customer_id long, merchant_id long, price double, ts timestamp, payment_method string"
    for i in range(0, 12, 4):
        spark.createDataFrame(rows[i : i + 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    asked = []

    def scores():
        asked.append(1)
        return spark.createDataFrame([(7, len(asked) / 10, "LOW")], "merchant_id long, merchant_risk_score double, merchant_risk_level string")

    rules = (fraud.Rule("burst", "transaction_count_1d > 3", "HIGH"),)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    detection.detect(stream, f"file://{tmp_path}", f"file://{tmp_path}/check", rules, scores, {"1d": "1 day"}).awaitTermination()
    got = {r["transaction_id"]: r for r in detection.scored(spark, f"file://{tmp_path}").collect()}
    whole = {r["transaction_id"]: r for r in fraud.detect(spark.createDataFrame(rows, schema), None, rules, {"1d": "1 day"}).collect()}
    assert len(got) == 12 and all(got[i]["transaction_count_1d"] == whole[i]["transaction_count_1d"] and got[i]["fraud_score"] == whole[i]["fraud_score"] for i in range(12))
    assert len({got[i]["merchant_risk_score"] for i in range(12)}) == 3


def test_retention_rules():
    from tidemill.sources import retention

    assert retention.problems(retention.RULES) == [] and not retention.rule_for("anything").enabled
    assert retention.problems({"t": retention.Rule(30, 30, 10, None, 5, "ts")}) == ["t: hot (30 days) must be less than warm (30 days)", "t: warm (30 days) must be less than cold (10 days)", "t: cold (10 days) must be less than delete (5 days)"]


def test_options_of_connectors():
    got = readers.kafka_options("a:9092", "orders", startingOffsets="earliest", maxOffsetsPerTrigger=100)
    assert got == {"kafka.bootstrap.servers": "a:9092", "subscribe": "orders", "failOnDataLoss": "false", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "100"}


def test_jdbc_reads_in_parts(spark):
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = "jdbc:derby:memory:shop;create=true"
    try:
        spark.range(100).selectExpr("CAST(id AS INT) AS id", "CAST(id * 2 AS DOUBLE) AS v").write.format("jdbc").option("url", url).option("dbtable", "T").mode("overwrite").save()
    except Exception as e:
        if "driver" in str(e).lower():
            pytest.skip("no embedded database on the class path")
        raise
    got = readers.read_jdbc(spark, url, "SELECT * FROM T WHERE \"id\" >= 20", "id", (20, 100), 4)
    assert got.rdd.getNumPartitions() == 4 and sorted(r["v"] for r in got.collect()) == [2.0 * i for i in range(20, 100)]
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, url, "SELECT * FROM T", "id")


def test_scores_are_refreshed_when_they_are_old(spark, tmp_path):
    from tidemill.streaming import detection

    now, made = [0.0], []

    def make():
        made.append(1)
        return spark.createDataFrame([(len(made),)], "n int")

    scores = detection.Refreshed(make, f"file://{tmp_path}", 60, clock=lambda: now[0])
    seen = []
    for t in (0, 30, 60, 61, 100, 200):
        now[0] = t
        seen.append(scores().first()["n"])
    assert seen == [1, 1, 1, 2, 2, 3]
    model = detection.Refreshed(lambda: made.append(1) or len(made), "", 10, write=False, clock=lambda: now[0])
    assert model() == model()


def test_greatest_products_are_those_of_all_pairs(spark, monkeypatch):
    """Blocks and tiles that most users leave early; equal scores, fewer items than asked for, and no comparison of all pairs."""
    import numpy as np
    from pyspark.ml.recommendation import ALSModel

    monkeypatch.setattr(ALSModel, "recommendForAllUsers", lambda *_: pytest.fail("all users with all products"))
    for name, n in {"BLOCK_USERS": 40, "BLOCK_ITEMS": 50, "TILE_USERS": 7, "TILE_ITEMS": 16}.items():
        monkeypatch.setattr(product, name, n)
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(100, 4)).astype(np.float32), (rng.normal(size=(300, 4)) * rng.gamma(1, 1, (300, 1))).astype(np.float32)
    v[200:210], u[5] = v[:10], 0
    table = lambda x: spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id int, features array<float>")
    for items in (v, v[:3]):
        made = product.greatest_products(table(u), table(items), 5).collect()
        exact = u.astype(float) @ items.astype(float).T
        want = {(i, k + 1): (int(j), exact[i, j]) for i in range(len(u)) for k, j in enumerate(np.lexsort((np.arange(len(items)), -exact[i]))[:5])}
        assert len(made) == len(want)
        got = {(r["id"], r["rank"]): (r["item"], r["score"]) for r in made}
        assert {k: i for k, (i, _) in got.items()} == {k: i for k, (i, _) in want.items()}
        assert [got[k][1] for k in want] == pytest.approx([s for _, s in want.values()])
    rows = [(c, p, 1 + c * p % 5) for c in range(12) for p in range(c % 4, 20, 3)]
    ranks = product.recommend(spark.createDataFrame(rows, "customer_id long, product_id long, rating int"), top=4).groupBy("customer_id").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert len(ranks) == 12 and all(r["r"] == [1, 2, 3, 4] for r in ranks)


def test_all_patterns_write_the_rows_alone(spark, tmp_path):
    """What is written before amounts are ranked has no column of another pattern, and limits are searched once a row."""
    rows = [(i, i % 3, i % 4, float(i % 5 * 100 + 50), at(i), "cash", "x") for i in range(40)]
    tx = spark.createDataFrame(rows, "transaction_id long, customer_id long, merchant_id long, price double, ts timestamp, payment_method string, location string")
    seen, real = [], fraud.written
    with pytest.MonkeyPatch.context() as m:
        m.setattr(fraud, "written", lambda df, label: seen.append(df.columns) or real(df, label))
        made = fraud.patterns(tx)
    assert seen == [tx.columns] and made.count() == 40
    prices = sorted(r["price"] for r in made.collect())
    assert {r["price"]: round(r["amount_percentile"] * 39) for r in made.collect()} == {p: prices.index(p) for p in prices}
    assert str(ranking.place(tx.withColumn("_limits", ranking.limits(tx, [F.col("price")], "transaction_id", 64)), F.col("price"), "transaction_id", 0, 64)).count("filter(") <= 2
