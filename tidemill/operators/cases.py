"""Investigation: case queues, service levels, feedback and what fraud costs, over tables of cases and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import bands, epoch, ratio

OPEN = ("open", "in_progress", "under_review", "escalated")
ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def active(cases: DataFrame) -> DataFrame:
    return cases.filter(F.col("status").isin(*OPEN))


def queue(cases: DataFrame, most: int = 50, status: str | None = None, priority: str | None = None) -> DataFrame:
    """The report of the first cases by priority, then age."""
    made = active(cases) if status is None else cases.filter(F.col("status") == status)
    made = made if priority is None else made.filter(F.col("priority") == priority)
    rank = F.lit(9)
    for k, v in ORDER.items():
        rank = F.when(F.col("priority") == k, v).otherwise(rank)
    return made.withColumn("_rank", rank).orderBy("_rank", "opened", "case_id").limit(most).drop("_rank")


def service_levels(cases: DataFrame, hours: dict[str, float] | None = None) -> DataFrame:
    """Cases, resolved cases, hours to resolution and the share in time, by priority."""
    hours = hours or {"CRITICAL": 1, "HIGH": 4, "MEDIUM": 24, "LOW": 72}
    spent = (epoch(F.col("closed")) - epoch(F.col("opened"))) / 3600.0
    limit = F.lit(None).cast("double")
    for k, v in hours.items():
        limit = F.when(F.col("priority") == k, float(v)).otherwise(limit)
    made = cases.withColumns({"_spent": spent, "_in_time": F.when(F.col("closed").isNotNull(), (spent <= limit).cast("int"))})
    return made.groupBy("priority").agg(F.count("*").alias("cases"), F.count("closed").alias("resolved"), F.avg("_spent").alias("avg_hours"), F.avg("_in_time").alias("in_time"))


def financial_impact(cases: DataFrame) -> DataFrame:
    """Amounts of resolved cases by what they turned out to be."""
    return cases.filter("closed IS NOT NULL").groupBy("resolution").agg(F.count("*").alias("cases"), F.sum("amount").alias("amount"), F.avg("amount").alias("avg_amount"))


def false_positives(feedback: DataFrame) -> DataFrame:
    """False alarms by amount band and by rule (dimension, member): all feedback once, exploded into both."""
    band = bands(F.col("amount"), [(100000, "over_100k"), (10000, "10k_100k"), (1000, "1k_10k")], "under_1k")
    members = F.concat(F.array(F.struct(F.lit("amount").alias("dimension"), band.alias("member"))), F.transform("rules", lambda r: F.struct(F.lit("rule").alias("dimension"), r.alias("member"))))
    each = feedback.select("is_false_positive", F.inline(members))
    made = each.groupBy("dimension", "member").agg(F.count("*").alias("alerts"), F.count_if("is_false_positive").alias("false_positives"))
    return made.withColumn("rate", ratio(F.col("false_positives"), F.col("alerts")))


def feedback_quality(feedback: DataFrame) -> DataFrame:
    """Feedback by investigator: how much, how sure, and how often of the opinion of most."""
    return feedback.groupBy("investigator").agg(F.count("*").alias("feedback"), F.avg("confidence").alias("avg_confidence"), F.avg(F.col("is_false_positive").cast("int")).alias("false_positive_share"), F.count_if(F.length("comment") > 10).alias("with_comment"))
