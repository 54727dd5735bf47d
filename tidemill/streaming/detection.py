"""Streams of payments: fraud detection into tables, exact duplicates, and windows out of the ordinary."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemill.functions.scalars import ratio
from tidemill.operators import fraud

#: The longest trailing span of the rules, for which earlier payments are looked up.
SPAN = "7 days"


class Refreshed:
    """A frame, such as the scores of merchants, that is made and written anew when it is asked for after more than `seconds`.

    In between, the one that was written last is read. What is asked for its own sake only (a model to serve, say) can be any value
    if `write` is False.
    """

    def __init__(self, make: Callable[[], DataFrame], root: str, seconds: float, write: bool = True, clock: Callable[[], float] = time.monotonic):
        self.make, self.root, self.seconds, self.write, self.clock = make, root.rstrip("/"), seconds, write, clock
        self.at: float | None = None
        self.number = 0
        self.value = None

    def __call__(self):
        now = self.clock()
        if self.at is None or now - self.at > self.seconds:
            made = self.make()
            if self.write:
                path = f"{self.root}/version={self.number}"
                made.write.mode("overwrite").parquet(path)
                made = made.sparkSession.read.schema(made.schema).parquet(path)
            self.value, self.at, self.number = made, now, self.number + 1
        return self.value


def detect(
    payments: DataFrame, root: str, checkpoint: str, rules: tuple[fraud.Rule, ...] = fraud.DEFAULT_RULES, merchant_scores: Callable[[], DataFrame] | None = None, spans: dict[str, str] | None = None, longest: str = SPAN, trigger: str | None = None
) -> StreamingQuery:
    """Rules, scores and verdicts of each micro-batch of payments, written below root/scored; without a trigger interval it takes what there is and ends.

    Each batch is written below root/history, and read with the earlier payments of its customers in the longest span,
    so that velocities see across batches. Folders are named by batch and overwritten, so a batch that is repeated leaves no
    row twice. merchant_scores is called for each batch: scores that are refreshed meanwhile are used from then on.
    """
    spark, schema = payments.sparkSession, payments.schema
    kept = T.StructType([*schema, T.StructField("batch", T.LongType())])

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/history/batch={number}")
        every = spark.read.schema(kept).parquet(f"{root}/history")
        new = every.filter(F.col("batch") == number)
        since = new.agg(F.min("ts") - F.expr(f"INTERVAL {longest}")).scalar()
        past = every.filter((F.col("batch") < number) & (F.col("ts") >= since)).join(new.select("customer_id").distinct(), "customer_id", "left_semi")
        made = fraud.detect(past.unionByName(new), merchant_scores() if merchant_scores else None, rules, spans)
        made.filter(F.col("batch") == number).drop("batch").write.mode("overwrite").parquet(f"{root}/scored/batch={number}")

    writer = payments.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def scored(spark, root: str) -> DataFrame:
    """All that detect() has written so far."""
    return spark.read.parquet(f"{root}/scored")


def kpis(found: DataFrame, span: str = "1 hour") -> DataFrame:
    """Payments, alerts, their amounts and rates by window, from what detect() has written."""
    alert = F.size("triggered_rules") > 0
    made = found.groupBy(F.window("ts", span).alias("w")).agg(F.count("*").alias("transactions"), F.count_if(alert).alias("alerts"), F.sum(F.when(alert, F.col("price"))).alias("alert_amount"), F.max("fraud_score").alias("max_score"))
    return made.select(F.col("w.start").alias("window_start"), "transactions", "alerts", F.coalesce("alert_amount", F.lit(0.0)).alias("alert_amount"), "max_score", ratio(F.col("alerts"), F.col("transactions")).alias("alert_rate"))


def distinct_payments(payments: DataFrame, keys: list[str], span: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """The first payment of equal keys in each span of time; state is kept for the span only."""
    made = payments.withColumn("_slot", F.window(ts, span)["start"])
    return made.withWatermark(ts, span).dropDuplicatesWithinWatermark([*keys, "_slot"]).drop("_slot")


def anomalous_windows(events: DataFrame, column: str, span: str = "1 hour", limit: float = 3.0, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each window's mean, spread and farthest value in units of the spread, flagged beyond the limit; windows are emitted when the watermark has passed them."""
    v = F.col(column)
    made = events.withWatermark(ts, delay).groupBy(F.window(ts, span).alias("w")).agg(F.count("*").alias("events"), F.avg(v).alias("mean"), F.stddev(v).alias("spread"), F.max(v).alias("high"), F.min(v).alias("low"))
    farthest = ratio(F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low")), F.col("spread"))
    return made.select(F.col("w.start").alias("window_start"), "events", "mean", "spread", farthest.alias("farthest"), F.coalesce(farthest > limit, F.lit(False)).alias("is_anomalous"))
