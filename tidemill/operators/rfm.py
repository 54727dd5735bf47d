"""RFM segmentation: metrics, scores, segments and reports.

Scores follow the documented intent: the highest score is the best (`orientation="best_is_high"`); the
literal form, in which 1 is the best, is `orientation="best_is_low"`. The segment map is stored after its
repeated keys were resolved, the last one winning. Tiles of equal values are told apart by the customer id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.ranking import with_ntiles, with_percent_rank
from tidemill.functions.scalars import bands, ratio

# Scores of each segment, for five and for four tiles.
SEGMENTS_5 = {
    "Champions": ("555", "554", "544", "545", "454", "455", "445"),
    "Loyal Customers": ("543", "444", "435", "355", "354", "345", "344", "335"),
    "New Customers": ("551", "552", "541", "542", "533", "532", "531", "521", "515", "514", "513", "425", "424", "413", "414", "415", "315", "314", "313"),
    "Promising": ("512", "511", "422", "421", "412", "411", "311"),
    "Need Attention": ("323", "233", "232"),
    "About to Sleep": ("331", "321", "312", "221", "213", "222", "132"),
    "Cannot Lose Them": ("145", "135", "125", "124"),
    "Hibernating": ("332", "322", "231", "241", "251", "155", "154", "144", "214", "215", "115", "114", "113"),
    "Lost": ("111", "112", "121", "131", "141", "151"),
}
SEGMENTS_4 = {
    "Champions": ("444", "443", "434"),
    "Loyal Customers": ("343", "344", "334"),
    "Potential Loyalists": ("234", "244"),
    "New Customers": ("424", "414", "441", "431", "421", "411"),
    "Promising": ("314", "313", "312", "311"),
    "Need Attention": ("232", "231", "242", "241"),
    "About to Sleep": ("222", "221", "212", "211"),
    "At Risk": ("144", "143", "134", "133"),
    "Cannot Lose Them": ("124", "123"),
    "Hibernating": ("132", "131", "122", "121"),
    "Lost": ("111", "112", "113", "114"),
}
# What to do about each segment.
ACTIONS = {
    "Champions": "Reward them. Can be early adopters of new products. Will promote your brand.",
    "Loyal Customers": "Upsell higher value products. Ask for reviews. Engage them.",
    "Potential Loyalists": "Offer membership/loyalty program. Recommend related products.",
    "New Customers": "Provide on-boarding support. Give them early success, start building relationship.",
    "Promising": "Create brand awareness. Offer free trials.",
    "Need Attention": "Make limited time offers. Recommend based on past purchases. Reactivate them.",
    "About to Sleep": "Share valuable resources. Recommend popular products. Reconnect with them.",
    "At Risk": "Send personalized emails. Offer renewals. Provide helpful resources.",
    "Cannot Lose Them": "Win them back via renewals or newer products. Don't lose them to competition. Talk to them.",
    "Hibernating": "Offer other product categories. Special customer reactivation campaigns.",
    "Lost": "Revive interest with reach out campaign. Ignore otherwise.",
}
OTHERWISE = "Need Attention"
# Tiers by the monetary score, and levels by the least scores of recency and frequency, the first that holds.
TIERS = [(4, "High Value"), (3, "Medium Value")]
LOW_TIER = "Low Value"
LEVELS = (("Highly Engaged", 4, 4), ("Moderately Engaged", 3, 3), ("Recently Active", 3, 0), ("Frequent but Dormant", 0, 3), ("Low Engagement", 0, 0))


def metrics(tx: DataFrame, as_of: str, customer: str = "customer_id", ts: str = "ts", amount: str = "amount") -> DataFrame:
    """One aggregation: recency_days, frequency, monetary, first and last purchase, avg_order_value."""
    made = tx.groupBy(F.col(customer).alias("customer_id")).agg(
        F.datediff(F.lit(as_of).cast("date"), F.max(F.to_date(ts))).alias("recency_days"), F.count("*").alias("frequency"), F.sum(amount).alias("monetary"),
        F.min(F.to_date(ts)).alias("first_purchase"), F.max(F.to_date(ts)).alias("last_purchase"),
    )
    return made.withColumn("avg_order_value", ratio(F.col("monetary"), F.col("frequency")))


def scores(rfm: DataFrame, tiles: int = 5, orientation: str = "best_is_high") -> DataFrame:
    """recency_score, frequency_score, monetary_score and rfm_score; numbered by ranges, not in one task."""
    if orientation not in ("best_is_high", "best_is_low"):
        raise ValueError(f"not an orientation: {orientation!r}")
    high = orientation == "best_is_high"
    values = {"recency_score": (F.col("recency_days"), high), "frequency_score": (F.col("frequency"), not high), "monetary_score": (F.col("monetary"), not high)}
    made = with_ntiles(rfm, tiles, "customer_id", values)
    return made.withColumn("rfm_score", F.concat(*[F.col(f"{x}_score").cast("string") for x in ("recency", "frequency", "monetary")]))


def segments(scored: DataFrame, tiles: int = 5) -> DataFrame:
    """segment, by a lookup that is part of the plan: no join is needed for a table of this size."""
    table = SEGMENTS_5 if tiles == 5 else SEGMENTS_4
    out = None
    for name, codes in table.items():
        out = F.when(F.col("rfm_score").isin(*codes), name) if out is None else out.when(F.col("rfm_score").isin(*codes), name)
    return scored.withColumn("segment", out.otherwise(OTHERWISE))


def classes(df: DataFrame) -> DataFrame:
    """The customer's value by what they spend, and how engaged they are by how lately and how often they buy."""
    levels = [F.when((F.col("recency_score") >= r) & (F.col("frequency_score") >= f), name) for name, r, f in LEVELS]
    return df.withColumns({"customer_value_tier": bands(F.col("monetary_score"), TIERS, LOW_TIER), "engagement_level": F.coalesce(*levels, F.lit(LEVELS[-1][0]))})


def profiles(tx: DataFrame, as_of: str, **columns: str) -> DataFrame:
    """Metrics, scores, segments and classes; frequency a month is null for a single day of purchases."""
    made = classes(segments(scores(metrics(tx, as_of, **columns))))
    days = F.datediff("last_purchase", "first_purchase")
    return made.withColumns(
        {
            "customer_lifetime_days": days,
            "purchase_frequency_per_month": ratio(F.col("frequency"), days / 30),
            "is_new_customer": F.datediff(F.lit(as_of).cast("date"), "first_purchase") <= 30,
            "is_at_risk": F.col("segment").isin("At Risk", "Cannot Lose Them", "About to Sleep"),
        }
    )


def segment_summary(profiled: DataFrame) -> DataFrame:
    made = profiled.groupBy("segment").agg(
        F.count("*").alias("customers"), F.sum("monetary").alias("revenue"), F.avg("monetary").alias("avg_monetary"), F.avg("frequency").alias("avg_frequency"), F.avg("recency_days").alias("avg_recency"),
        F.max("monetary").alias("max_monetary"), F.min("monetary").alias("min_monetary"), F.stddev("monetary").alias("stddev_monetary"),
    )
    return made.withColumn("revenue_percentage", 100 * ratio(F.col("revenue"), F.sum("revenue").over(W.partitionBy())))


def high_value(profiled: DataFrame, share: float = 0.2) -> DataFrame:
    """The best `share` by 0.3 R + 0.3 F + 0.4 M."""
    made = profiled.withColumn("composite_score", F.round(0.3 * F.col("recency_score") + 0.3 * F.col("frequency_score") + 0.4 * F.col("monetary_score"), 6))
    return with_percent_rank(made, "customer_rank", F.col("composite_score")).filter(F.col("customer_rank") >= 1 - share)


def actions(profiled: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return profiled.withColumn("recommended_action", F.try_element_at(table, F.col("segment")))


def batch_metrics(tx: DataFrame, as_of: str, lookback_days: int) -> DataFrame:
    """The variant of the batch job: only the last days, distinct transactions, weighted value score."""
    last = tx.filter((F.to_date("ts") >= F.date_sub(F.lit(as_of).cast("date"), lookback_days)) & (F.to_date("ts") <= F.lit(as_of).cast("date")))
    made = last.groupBy("customer_id").agg(F.datediff(F.lit(as_of).cast("date"), F.max(F.to_date("ts"))).alias("recency_days"), F.countDistinct("transaction_id").alias("frequency"), F.sum("amount").alias("monetary"))
    scored = scores(made)
    return scored.withColumn("customer_value_score", F.round(0.3 * F.col("recency_score") + 0.4 * F.col("frequency_score") + 0.3 * F.col("monetary_score"), 2))


def batch_segments(scored: DataFrame) -> DataFrame:
    """First condition that holds."""
    r, f, m = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    name = (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions").when((f >= 4) & (m >= 4), "Loyal Customers").when((r >= 4) & ((f >= 3) | (m >= 3)), "Potential Loyalists")
        .when((r >= 4) & (f <= 2) & (m <= 2), "New Customers").when((r >= 3) & (f >= 2) & (m >= 2), "Promising").when((r >= 3) & (f >= 3) & (m >= 3), "Need Attention")
        .when((r <= 2) & (f >= 3) & (m >= 3), "About to Sleep").when((r <= 2) & (f >= 2) & (m >= 3), "At Risk").when((r <= 2) & (f <= 2) & (m >= 4), "Cannot Lose Them")
        .when((r <= 2) & (f <= 2) & (m <= 2), "Hibernating").otherwise("Others")
    )
    return scored.withColumn("customer_segment", name)


def batch_statistics(segmented: DataFrame) -> DataFrame:
    made = segmented.groupBy("customer_segment").agg(F.count("*").alias("customers"), F.sum("monetary").alias("revenue"), F.avg("recency_days").alias("avg_recency"))
    every = W.partitionBy()
    return made.withColumns({"customer_percentage": F.round(100 * ratio(F.col("customers"), F.sum("customers").over(every)), 2), "revenue_percentage": F.round(100 * ratio(F.col("revenue"), F.sum("revenue").over(every)), 2)})
