"""Deduplication and late data, in batch; the streaming package has the forms that keep state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.scalars import epoch, ratio, seconds

# Weights of the four similarities.
SIMILARITY = {"amount": 0.4, "product": 0.3, "payment": 0.2, "time": 0.1}


def exact(df: DataFrame, keys: list[str], ts: str, tie: str, keep: str = "first") -> DataFrame:
    """One row of each key, the first or last by time."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep first or last, not {keep!r}")
    order = [F.asc(ts), F.asc(tie)] if keep == "first" else [F.desc(ts), F.desc(tie)]
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def transactions(df: DataFrame, threshold: float = 0.95, tie: str = "transaction_id") -> DataFrame:
    """Rows with a label: exact (repeats user, product, amount and payment in 10 minutes), fuzzy (like the row before), or unique.

    Likeness to the previous row of the user in the same 10 minutes: amount 0.4, product 0.3, payment 0.2, time within 5 minutes 0.1.
    """
    bucket = F.floor(epoch(F.col("ts")) / 600)
    made = df.withColumn("_bucket", bucket)
    same = W.partitionBy("user_id", "_bucket", "product_id", "amount", "payment_method").orderBy("ts", tie)
    made = made.withColumn("exact_rank", F.row_number().over(same))
    w = W.partitionBy("user_id", "_bucket").orderBy("ts", tie)
    prior = {c: F.lag(c).over(w) for c in ("amount", "product_id", "payment_method", "ts")}
    gap = epoch(F.col("ts")) - epoch(prior["ts"])
    likeness = {
        "amount": F.coalesce(1 - ratio(F.abs(F.col("amount") - prior["amount"]), F.greatest(F.col("amount"), prior["amount"])), F.lit(0.0)),
        "product": F.when(F.col("product_id") == prior["product_id"], 1.0).otherwise(0.0),
        "payment": F.when(F.col("payment_method") == prior["payment_method"], 1.0).otherwise(0.0),
        "time": F.when(gap <= 300, 1 - gap / 300.0).otherwise(0.0),
    }
    made = made.withColumn("overall_similarity", F.round(sum((likeness[k] * w_ for k, w_ in SIMILARITY.items()), F.lit(0.0)), 9))
    label = F.when(F.col("exact_rank") > 1, "exact").when(F.col("overall_similarity") >= threshold, "fuzzy").otherwise("unique")
    return made.withColumn("duplicate_type", label).drop("_bucket")


def behavior(df: DataFrame, spacing: str = "30 seconds", view_spacing: str = "5 minutes", tie: str = "event_id") -> DataFrame:
    """Rows with is_rapid_fire (within a second of the user's last) and is_duplicate: the same event (and product) again within the spacing."""
    gap = lambda *keys: epoch(F.col("ts")) - epoch(F.lag("ts").over(W.partitionBy(*keys).orderBy("ts", tie)))
    made = df.withColumns({"_any": gap("user_id"), "_same": gap("user_id", "event_type"), "_view": gap("user_id", "event_type", "product_id")})
    view = (F.col("event_type") == "view") & F.col("product_id").isNotNull() & (F.col("_view") <= seconds(view_spacing))
    return made.withColumns({"is_rapid_fire": F.coalesce(F.col("_any") <= 1, F.lit(False)), "is_duplicate": F.coalesce((F.col("_same") <= seconds(spacing)) | view, F.lit(False))}).drop("_any", "_same", "_view")


def statistics(before: DataFrame, after: DataFrame, keys: list[str], span: str = "5 minutes") -> DataFrame:
    """Rows of each window before and after, and the share that went: a full outer join of two window counts."""
    distinct = F.countDistinct(F.concat_ws("|", *keys))
    a = before.groupBy(F.window("ts", span)).agg(F.count("*").alias("original"), distinct.alias("distinct_keys"))
    b = after.groupBy(F.window("ts", span)).agg(F.count("*").alias("kept"))
    made = a.join(b, "window", "full_outer").fillna(0)
    return made.withColumns({"removed": F.col("original") - F.col("kept"), "duplicate_rate": ratio(F.col("original") - F.col("kept"), F.col("original"))})


def late(df: DataFrame, processed: Column, ts: str = "ts", grace: str = "15 minutes", strategy: str = "flag") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Rows that were processed later than `grace` after their time: flagged, dropped, or apart (on time, late)."""
    made = df.withColumns({"processing_delay_seconds": epoch(processed) - epoch(F.col(ts)), "is_late_arrival": processed > F.col(ts) + F.expr(f"INTERVAL {seconds(grace)} SECONDS")})
    if strategy == "flag":
        return made
    if strategy == "drop":
        return made.filter("NOT is_late_arrival")
    if strategy == "separate":
        return made.filter("NOT is_late_arrival"), made.filter("is_late_arrival")
    raise ValueError(f"not a strategy: {strategy!r}")
