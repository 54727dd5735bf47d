"""Windowed KPIs that run on batches and on streams.

Each function takes `streaming`: streams get a watermark and approximate distinct counts, batches exact ones;
everything else is the same plan. Order-dependent firsts and lasts are min_by and max_by on time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import bands, ratio


def distinct(c: str, streaming: bool) -> Column:
    return F.approx_count_distinct(c) if streaming else F.countDistinct(c)


def marked(df: DataFrame, ts: str, delay: str, streaming: bool) -> DataFrame:
    return df.withWatermark(ts, delay) if streaming else df


def flat(df: DataFrame) -> DataFrame:
    """The window as window_start and window_end."""
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in df.columns if c != "window"])


def kpis(tx: DataFrame, span: str = "5 minutes", slide: str = "1 minute", delay: str = "2 minutes", streaming: bool = False) -> DataFrame:
    """Sliding sales KPIs by location (ts, location, amount, quantity, customer_id, payment_method, risk)."""
    made = marked(tx, "ts", delay, streaming).groupBy(F.window("ts", span, slide), "location").agg(
        F.count("*").alias("transactions"), F.sum("amount").alias("revenue"), F.avg("amount").alias("avg_order_value"), F.max("amount").alias("max_order"), F.min("amount").alias("min_order"),
        distinct("customer_id", streaming).alias("customers"), F.sum("quantity").alias("items"), F.count_if(F.col("risk") >= 3).alias("high_risk"), F.count_if(F.col("payment_method") == "credit_card").alias("credit_card"),
    )
    n = F.col("transactions")
    return flat(made).withColumns({"revenue_per_customer": ratio(F.col("revenue"), F.col("customers")), "items_per_order": ratio(F.col("items"), n), "high_risk_pct": 100 * ratio(F.col("high_risk"), n), "credit_card_pct": 100 * ratio(F.col("credit_card"), n)})


def behavior(events: DataFrame, span: str = "10 minutes", slide: str = "2 minutes", delay: str = "3 minutes", streaming: bool = False) -> DataFrame:
    """Sliding counts of each user's events and what they convert to."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    made = marked(events, "ts", delay, streaming).groupBy(F.window("ts", span, slide), "user_id").agg(
        F.count("*").alias("events"), kind("view").alias("views"), kind("click").alias("clicks"), kind("signup").alias("signups"), kind("purchase").alias("purchases"), F.sum("value").alias("value"), distinct("product_id", streaming).alias("products"),
    )
    made = flat(made).withColumns({"conversion_rate": ratio(F.col("purchases"), F.col("views")), "signup_conversion_rate": ratio(F.col("purchases"), F.col("signups"))})
    return made.withColumn("activity_intensity", bands(F.col("events"), [(20, "Very High"), (10, "High"), (5, "Medium")], "Low"))


def products(tx: DataFrame, span: str = "15 minutes", slide: str = "5 minutes", delay: str = "2 minutes", streaming: bool = False) -> DataFrame:
    """Sliding sales of each product (ts, product_id, category, amount, quantity, customer_id)."""
    made = marked(tx, "ts", delay, streaming).groupBy(F.window("ts", span, slide), "product_id", "category").agg(
        F.sum("quantity").alias("units"), F.sum("amount").alias("revenue"), distinct("customer_id", streaming).alias("buyers"), F.count("*").alias("orders"), F.avg("amount").alias("avg_amount"),
    )
    score = (0.3 * F.col("units") + 0.5 * F.col("revenue") + 0.2 * F.col("buyers")).cast("int")
    return flat(made).withColumns({"performance_score": score, "velocity_category": bands(F.col("units"), [(50, "Fast"), (20, "Medium"), (5, "Slow")], "Very Slow")})


def session_metrics(made: DataFrame) -> DataFrame:
    seconds = F.col("last_ts").cast("timestamp").cast("long") - F.col("first_ts").cast("timestamp").cast("long")
    made = made.withColumn("duration_seconds", seconds)
    made = made.withColumn("engagement_per_minute", ratio(F.col("engagement"), F.col("duration_seconds") / 60))
    return made.withColumns({"session_quality": bands(F.col("engagement"), [(300, "Excellent"), (150, "Good"), (50, "Fair")], "Poor"), "funnel_progression": F.concat_ws(" -> ", "entry_event", "exit_event")})


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "3 minutes", streaming: bool = False, tumbling: bool = False) -> DataFrame:
    """Sessions of each user by inactivity (or tumbling windows of that length), with first and last event by time."""
    span = F.window("ts", gap) if tumbling else F.session_window("ts", gap)
    made = marked(events, "ts", delay, streaming).groupBy(span.alias("window"), "user_id").agg(
        F.count("*").alias("events"), F.sum("engagement_score").alias("engagement"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("event_type", F.struct("ts", "event_id")).alias("entry_event"), F.max_by("event_type", F.struct("ts", "event_id")).alias("exit_event"),
    )
    return session_metrics(flat(made))


def by_category(events: DataFrame, span: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes", streaming: bool = False) -> DataFrame:
    """Sliding totals by type and channel."""
    made = marked(events, "ts", delay, streaming).groupBy(F.window("ts", span, slide), "event_type", "channel").agg(F.count("*").alias("events"), F.sum("value").alias("value"), distinct("user_id", streaming).alias("users"))
    return flat(made)


def event_category(df: DataFrame) -> DataFrame:
    """event_type_category: what an event is part of."""
    kind = F.col("event_type")
    name = F.when(kind.isin("view", "page_view", "product_view"), "browsing").when(kind.isin("add_to_cart", "remove_from_cart", "click"), "cart").when(kind.isin("purchase", "checkout"), "conversion").when(kind == "search", "discovery").otherwise("other")
    return df.withColumn("event_type_category", name)
