"""Customer journeys: sessions, touchpoints, funnels and conversion rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.scalars import epoch, ratio, seconds


def sessions(events: DataFrame, gap: str = "30 minutes", user: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """session_no and session_id: a new session starts after a longer gap. One shuffle by user; both windows share its order."""
    w = W.partitionBy(user).orderBy(ts, tie)
    starts = F.coalesce(epoch(F.col(ts)) - epoch(F.lag(ts).over(w)) > seconds(gap), F.lit(True)).cast("int")
    made = events.withColumn("_starts", starts).withColumn("session_no", F.sum("_starts").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_starts")
    return made.withColumn("session_id", F.concat_ws("_", F.col(user).cast("string"), F.col("session_no").cast("string")))


def touchpoints(events: DataFrame, session: str = "session_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    return events.withColumn("touchpoint_order", F.row_number().over(W.partitionBy(session).orderBy(ts, tie)))


def funnel(events: DataFrame, steps: list[str], session: str = "session_id") -> DataFrame:
    """step_no, step, sessions: sessions with that event among those with the first step's; the order of events is free.

    One aggregation by session (a flag a step), then one row; not a job a step.
    """
    flags = [F.max((F.col("event_type") == s).cast("int")).alias(f"_{i}") for i, s in enumerate(steps)]
    each = events.groupBy(session).agg(*flags).filter("_0 = 1")
    counts = each.agg(*[F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"_{i}") for i in range(len(steps))])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(s).alias("step"), F.col(f"_{i}").alias("sessions")) for i, s in enumerate(steps)])
    return counts.select(F.inline(rows))


def conversion_rate(events: DataFrame, start: str, end: str, session: str = "session_id") -> DataFrame:
    """starts, conversions and their ratio, 0 without starts."""
    has = lambda kind: F.max((F.col("event_type") == kind).cast("int"))
    each = events.groupBy(session).agg(has(start).alias("a"), has(end).alias("b")).filter("a = 1")
    made = each.agg(F.count("*").alias("starts"), F.coalesce(F.sum("b"), F.lit(0)).alias("conversions"))
    return made.withColumn("conversion_rate", F.coalesce(ratio(F.col("conversions"), F.col("starts")), F.lit(0.0)))
