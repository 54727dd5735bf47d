"""Customer lifetime value, cohorts and churn features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import period, ratio

MARGIN = 0.2


def historical(tx: DataFrame, margin: float = MARGIN, customer: str = "customer_id", ts: str = "ts", amount: str = "amount") -> DataFrame:
    made = tx.groupBy(F.col(customer).alias("customer_id")).agg(
        F.sum(amount).alias("total_revenue"), F.count("*").alias("total_orders"), F.avg(amount).alias("avg_order_value"), F.min(F.to_date(ts)).alias("first_purchase"),
        F.max(F.to_date(ts)).alias("last_purchase"), F.stddev(amount).alias("order_value_stddev"),
    )
    days, orders = F.datediff("last_purchase", "first_purchase"), F.col("total_orders")
    return made.withColumns(
        {
            "historical_clv": F.col("total_revenue") * margin,
            "customer_lifespan_days": days,
            "purchase_frequency": F.when(days > 0, ratio(orders, days / 30)).otherwise(orders.cast("double")),
            "days_between_orders": F.when(orders > 1, ratio(days, orders - 1)).otherwise(F.lit(0.0)),
            "order_value_consistency": F.when(F.col("avg_order_value") > 0, 1 - ratio(F.coalesce("order_value_stddev", F.lit(0.0)), F.col("avg_order_value"))).otherwise(F.lit(0.0)),
        }
    )


def features(clv: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("date")
    months = F.months_between(now, "first_purchase")
    maturity = F.when(months <= 3, "New").when(months <= 12, "Growing").when(months <= 24, "Mature").otherwise("Veteran")
    return clv.withColumns(
        {
            "recency_days": F.datediff(now, "last_purchase"),
            "months_since_first_purchase": months,
            "purchase_velocity": F.when(months > 0, ratio(F.col("total_orders"), months)).otherwise(F.col("total_orders").cast("double")),
            "revenue_trend": F.when(months > 0, ratio(F.col("total_revenue"), months)).otherwise(F.col("total_revenue")),
            "customer_maturity": maturity,
        }
    )


def summary(clv: DataFrame) -> DataFrame:
    c = "historical_clv"
    return clv.agg(F.count("*").alias("customers"), F.avg(c).alias("avg_clv"), F.max(c).alias("max_clv"), F.min(c).alias("min_clv"), F.stddev(c).alias("stddev_clv"), F.sum(c).alias("total_clv"), F.sum("total_revenue").alias("total_revenue"))


def top(clv: DataFrame, n: int = 20) -> DataFrame:
    """The report of the n customers of greatest value."""
    return clv.orderBy(F.desc("historical_clv"), "customer_id").limit(n)


def with_segments(clv: DataFrame, rfm: DataFrame, value: str = "predicted_clv") -> DataFrame:
    """CLV with the segment of each customer, how both fit, and how urgent it is to keep the customer."""
    made = clv.join(rfm.select("customer_id", "segment"), "customer_id", "left")
    s, v = F.col("segment"), F.col(value)
    fit = (
        F.when((s == "Champions") & (v > 1000), "High Value Aligned").when((s == "Lost") & (v < 100), "Low Value Aligned")
        .when(s.isin("Champions", "Loyal Customers") & (v < 500), "Segment Mismatch - Low CLV").when(s.isin("Lost", "Hibernating") & (v > 800), "Segment Mismatch - High CLV").otherwise("Standard Alignment")
    )
    urgency = F.when(s == "Cannot Lose Them", "Critical").when(s == "At Risk", "High").when(s.isin("Champions", "Loyal Customers"), "Medium").otherwise("Low")
    return made.withColumns({"clv_segment_alignment": fit, "retention_priority": urgency})


def cohorts(tx: DataFrame, unit: str = "month") -> DataFrame:
    """Cohort (period of the first purchase) by period of purchase: rows, customers, revenue, and months since.

    The first purchase comes from a window, so the transactions are shuffled once, by customer.
    """
    from pyspark.sql import Window as W

    first = F.min("ts").over(W.partitionBy("customer_id"))
    made = tx.withColumn("_first", first).select("customer_id", "amount", period(F.col("_first"), unit).alias("cohort"), period(F.col("ts"), unit).alias("period"), F.floor(F.months_between(F.date_trunc("month", "ts"), F.date_trunc("month", "_first"))).cast("long").alias("months_since"))
    return made.groupBy("cohort", "period", "months_since").agg(F.count("*").alias("orders"), F.countDistinct("customer_id").alias("customers"), F.sum("amount").alias("revenue"))


def retention(cohorted: DataFrame) -> DataFrame:
    """Share of each cohort's customers that bought in each later period."""
    from pyspark.sql import Window as W

    size = F.first("customers").over(W.partitionBy("cohort").orderBy("period"))
    return cohorted.select("cohort", "period", "months_since", "customers", size.alias("cohort_size"), F.round(100 * ratio(F.col("customers"), size), 4).alias("retention"))


def churn_features(tx: DataFrame, as_of: str, quiet_days: int = 30) -> DataFrame:
    """One aggregation for label and features: churned after quiet_days without a purchase."""
    now = F.lit(as_of).cast("date")
    made = tx.groupBy("customer_id").agg(F.datediff(now, F.max(F.to_date("ts"))).alias("recency"), F.countDistinct("transaction_id").alias("frequency"), F.sum("amount").alias("monetary"))
    return made.withColumn("label", (F.col("recency") > quiet_days).cast("int"))
