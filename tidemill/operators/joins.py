"""Joins: intervals, latest profiles, sessions, windows, ranges and as-of; with streaming forms where they exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.scalars import bands, epoch, ratio, seconds
from tidemill.operators.journey import sessions


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, before: str, after: str, how: str = "inner", watermark: str | None = None) -> DataFrame:
    """right within [left_ts - before, left_ts + after] of the same keys; columns are prefixed a_ and b_.

    The keys make it an equi-join with a range condition. With `watermark` both sides are streams with it.
    """
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    if watermark:
        a, b = a.withWatermark(f"a_{left_ts}", watermark), b.withWatermark(f"b_{right_ts}", watermark)
    near = [f"a_{k} = b_{k}" for k in keys] + [f"b_{right_ts} >= a_{left_ts} - INTERVAL {seconds(before)} SECONDS", f"b_{right_ts} <= a_{left_ts} + INTERVAL {seconds(after)} SECONDS"]
    return a.join(b, F.expr(" AND ".join(near)), how)


def correlate(left: DataFrame, right: DataFrame, keys: list[str], span: str = "15 minutes", how: str = "inner", watermark: str | None = None) -> DataFrame:
    """Both sides within `span` of each other, and the seconds between them."""
    made = interval_join(left, right, keys, "ts", "ts", span, span, how, watermark)
    return made.withColumn("time_difference_seconds", F.abs(epoch(F.col("a_ts")) - epoch(F.col("b_ts"))))


def purchase_after_behavior(tx: DataFrame, events: DataFrame, span: str = "10 minutes", watermark: str | None = None) -> DataFrame:
    """Transactions up to `span` after an event of the same user (user_id, ts, product_id; intent score of the event)."""
    made = interval_join(events, tx, ["user_id"], "ts", "ts", "0 seconds", span, "inner", watermark)
    minutes = (epoch(F.col("b_ts")) - epoch(F.col("a_ts"))) / 60.0
    match = F.col("a_product_id") == F.col("b_product_id")
    speed = F.when(minutes <= 5, "Immediate").when(minutes <= 30, "Quick").when(minutes <= 120, "Considered").otherwise("Delayed")
    return made.withColumns(
        {
            "time_to_purchase_minutes": minutes, "product_match": match, "intent_to_purchase_score": F.col("a_purchase_intent_score") + F.when(match, 20).otherwise(0),
            "conversion_path": F.concat(F.col("a_event_type"), F.lit(" -> purchase")), "purchase_velocity": speed,
        }
    )


def user_journey(events: DataFrame, tx: DataFrame, span: str = "4 hours", watermark: str | None = None) -> DataFrame:
    """Every event with the purchases in the time after it, if any: a left outer interval join."""
    made = interval_join(events, tx, ["user_id"], "ts", "ts", "0 seconds", span, "left_outer", watermark)
    hours = (epoch(F.col("b_ts")) - epoch(F.col("a_ts"))) / 3600.0
    bought = F.col("b_event_id").isNotNull()
    score = F.when(~bought, 0).when(hours <= 0.5, 100).when(hours <= 1, 80).when(hours <= 2, 60).when(hours <= 3, 40).otherwise(20)
    impact = F.when(F.col("a_event_type") == "signup", 5).when(F.col("a_event_type") == "click", 3).when(F.col("a_event_type") == "view", 1).otherwise(0)
    return made.withColumns({"led_to_purchase": bought, "time_to_purchase_hours": hours, "journey_effectiveness": score, "product_correlation": F.coalesce(F.col("a_product_id") == F.col("b_product_id"), F.lit(False)), "journey_stage_impact": impact})


def event_sequence(events: DataFrame) -> DataFrame:
    """The number of each event of its user: batch only, streams number in foreachBatch."""
    return events.withColumn("event_sequence", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))


def latest(updates: DataFrame, key: str, ts: str) -> DataFrame:
    """The last row of each key, by one aggregation."""
    rest = [c for c in updates.columns if c != key]
    made = updates.groupBy(key).agg(F.max(F.struct(ts, *[c for c in rest if c != ts])).alias("_row"))
    return made.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def with_profile(tx: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Transactions with the latest profile of their user. Catalyst broadcasts the profiles if they are small, else sorts.

    updates: user_id, ts, tier, registered, last_login, orders, lifetime_value, spent.
    """
    made = tx.join(latest(updates, "user_id", "ts").withColumnRenamed("ts", "profile_ts"), "user_id", "left")
    tenure, away = F.datediff(as_of, "registered"), F.datediff(as_of, "last_login")
    upgrade = F.when((F.col("tier") == "Bronze") & (F.col("spent") > 500) | (F.col("tier") == "Silver") & (F.col("spent") > 1000) | (F.col("tier") == "Gold") & (F.col("spent") > 2000), True).otherwise(False)
    segment = F.when(tenure < 30, "New").when(away > 90, "At Risk").when(F.col("orders") > 10, "Loyal").when(F.col("lifetime_value") > 1000, "VIP").otherwise("Regular")
    return made.withColumns({"customer_tenure_days": tenure, "days_since_last_login": away, "tier_upgrade_eligible": upgrade, "customer_segment": segment, "profile_freshness_hours": (epoch(as_of) - epoch(F.col("profile_ts"))) / 3600.0})


def session_purchases(events: DataFrame, tx: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions with the purchases between their first event and one gap after their last."""
    spans = sessions(events, gap).groupBy("user_id", "session_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("events"), F.max("purchase_intent_score").alias("intent"), F.collect_set("product_id").alias("products"))
    buys = tx.select(F.col("user_id").alias("_user"), F.col("ts").alias("purchase_ts"), F.col("event_id").alias("purchase_id"), F.col("product_id").alias("_product"))
    made = spans.join(buys, F.expr(f"user_id = _user AND purchase_ts >= start AND purchase_ts <= end + INTERVAL {seconds(gap)} SECONDS"), "left")
    return made.withColumns({"within_session_purchase": F.col("purchase_id").isNotNull(), "session_conversion_score": F.col("intent") + F.when(F.col("purchase_id").isNotNull(), 50).otherwise(0), "session_product_match": F.coalesce(F.array_contains("products", F.col("_product")), F.lit(False))}).drop("_user", "_product", "products")


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: int, keys: list[str] | None = None) -> DataFrame:
    """left.value in [right.low, right.high): an equi-join on buckets of `width` that each interval is laid out over, then the exact test."""
    bucket = lambda c: F.floor(F.col(c) / width)
    spans = right.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    made = left.withColumn("_bucket", bucket(value)).join(spans, ["_bucket", *(keys or [])])
    return made.filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_bucket")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it: one sort of both tables together, no pairs."""
    l = left.withColumns({"_t": F.col(left_ts), "_side": F.lit(1)})
    r = right.select(F.col(key), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    made = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return made.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def window_alerts(tx: DataFrame, events: DataFrame, span: str = "5 minutes") -> DataFrame:
    """Full outer join of two tables' windows with alert flags (tx: ts, amount, risk; events: ts, score)."""
    a = tx.groupBy(F.window("ts", span)).agg(F.count("*").alias("volume"), F.sum("amount").alias("amount"), F.sum(F.when(F.col("risk") >= 3, 1).otherwise(0)).alias("risky"))
    b = events.groupBy(F.window("ts", span)).agg(F.count("*").alias("events"), F.avg("score").alias("engagement"))
    made = a.join(b, "window", "full_outer").fillna(0, ["volume", "risky", "events"])
    return made.withColumns(
        {
            "volume_alert": F.when(F.col("volume") < 10, "LOW").when(F.col("volume") > 1000, "HIGH").otherwise("NORMAL"),
            "risk_alert": F.col("risky") > 5,
            "engagement_alert": F.when(F.col("engagement") < 30, "LOW").when(F.col("engagement") > 80, "HIGH").otherwise("NORMAL"),
        }
    )
