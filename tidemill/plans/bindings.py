"""The logical tables of the operators, bound to the star schema; and the same as SQL, for WITH clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that operators with relative time are asked about.
AS_OF = "2001-08-02"
EVENTS_AS_OF = "2024-01-31"
CHANNELS = ("search_paid", "search_organic", "social_paid", "social_organic", "email", "display", "affiliate", "direct", "referral")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("payment_method"), F.col("o_orderstatus").alias("status"),
    )


TX = "tx AS (SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderdate AS ts, o_totalprice AS amount, o_orderpriority AS payment_method, o_orderstatus AS status FROM orders)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line, with product and merchant."""
    item = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("merchant_id"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("revenue"), F.col("l_discount").alias("discount"),
        F.col("l_shipdate").cast("timestamp").alias("ship_ts"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))
    orders = transactions(spark, sf_dir).select("transaction_id", "customer_id", "ts", "payment_method", "status")
    return item.join(orders, "transaction_id").join(part, "product_id")


LINES = """lines AS (SELECT l_orderkey AS transaction_id, l_linenumber AS line, l_partkey AS product_id, l_suppkey AS merchant_id, l_quantity AS quantity,
  l_extendedprice / l_quantity AS price, l_extendedprice AS revenue, l_discount AS discount, l_shipdate AS ship_ts, o_custkey AS customer_id, o_orderdate AS ts,
  o_orderpriority AS payment_method, o_orderstatus AS status, p_brand AS brand, p_type AS category
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer, with country and region; a city and coordinates made from the key."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    made = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return made.select(
        F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.concat(F.lit("CITY_"), (F.col("c_custkey") % 7).cast("string")).alias("city"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), (F.col("c_custkey") % 120 - 60).cast("double").alias("latitude"), (F.col("c_custkey") % 300 - 150).cast("double").alias("longitude"),
    )


CUSTOMERS = """customers AS (SELECT c_custkey AS customer_id, n_name AS country, r_name AS region, 'CITY_' || CAST(c_custkey % 7 AS VARCHAR) AS city, c_mktsegment AS segment, c_acctbal AS balance,
  CAST(c_custkey % 120 - 60 AS DOUBLE) AS latitude, CAST(c_custkey % 300 - 150 AS DOUBLE) AS longitude
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream; the funnel's names for its types, channel and page from the payload."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"), F.get(F.array(*map(F.lit, CHANNELS)), k % 9).alias("channel"), (k % 5).alias("product_id")
    )


BEHAVIOR = f"""behavior AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  list_extract([{", ".join(repr(c) for c in CHANNELS)}], CAST(json_extract(props, '$.k') AS INTEGER) % 9 + 1) AS channel, CAST(json_extract(props, '$.k') AS INTEGER) % 5 AS product_id FROM events)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with what the enrichers of transactions read."""
    who = customers(spark, sf_dir).select("customer_id", F.col("segment").alias("customer_tier"), F.col("balance").alias("customer_lifetime_value"), F.col("region").alias("location"))
    made = lines(spark, sf_dir).join(who, "customer_id")
    return made.select(
        "transaction_id", "line", "customer_id", "product_id", "customer_tier", "customer_lifetime_value", F.concat("category", F.lit("/"), "brand").alias("category"),
        "price", F.col("quantity").cast("int").alias("quantity"), F.col("revenue").alias("total_amount"), F.timestamp_add("HOUR", F.expr("cast(transaction_id % 24 as int)"), "ts").alias("ts"), "location", "payment_method",
    )


WIDE = f"""{LINES}, {CUSTOMERS}, wide AS (SELECT transaction_id, line, customer_id, product_id, segment AS customer_tier, balance AS customer_lifetime_value, category || '/' || brand AS category,
  price, CAST(quantity AS INTEGER) AS quantity, revenue AS total_amount, ts + to_hours(CAST(transaction_id % 24 AS INTEGER)) AS ts, region AS location, payment_method
  FROM lines JOIN customers USING (customer_id))"""
