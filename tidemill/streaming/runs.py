"""Running streams: draining a folder, state that deduplicates, upserts by micro-batch, and a manager of queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemill.sources.tablestore import TableStore


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; local sessions without one use a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/tidemill-{spark.sparkContext.applicationId}"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str, ts: str) -> DataFrame:
    """A table's file as a stream, its time as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").load(sf_dir).withColumn(ts, F.col(ts).cast("timestamp"))


def drain(df: DataFrame, name: str) -> DataFrame:
    """Runs an append-mode stream over all there is, into Parquet, and reads the result; exactly once by the sink's log."""
    spark = df.sparkSession
    out = folder(spark, name)
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start(f"{out}/data").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def upsert(df: DataFrame, store: TableStore, table: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's last row of a key is merged into the table; a batch that is repeated merges the same rows again."""

    def merge(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in (*keys, order)]
        last = batch.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_r")).select(*keys, f"_r.{order}", *[f"_r.{c}" for c in rest]).select(*batch.columns)
        if store.exists(table):
            store.merge(table, last, keys)
        else:
            store.append(table, last)

    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def distinct_events(df: DataFrame, keys: list[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark; state is kept for `delay` only."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rapid_fire(df: DataFrame, user: str = "user_id", ts: str = "ts", least_seconds: float = 1.0) -> DataFrame:
    """event_id and whether less than `least_seconds` passed since the user's previous event of any batch: one time of state a user."""
    state = T.StructType([T.StructField("last", T.DoubleType())])

    def each(key, frames, held):
        import pandas as pd

        last = held.get[0] if held.exists else None
        rows = pd.concat(list(frames)).sort_values([ts, "event_id"])
        at = rows[ts].astype("int64") / (1e9 if str(rows[ts].dtype).endswith("[ns]") or "[ns," in str(rows[ts].dtype) else 1e6)
        before = at.shift(1)
        if last is not None:
            before.iloc[0] = last
        held.update((float(max(at.iloc[-1], last or at.iloc[-1])),))
        yield pd.DataFrame({"event_id": rows["event_id"].astype("int64"), "is_rapid_fire": ((at - before) < least_seconds).fillna(False).astype(bool)})

    return df.select(user, ts, "event_id").groupBy(user).applyInPandasWithState(each, "event_id long, is_rapid_fire boolean", state, "append", "NoTimeout")


class Consumers:
    """Named streams: registered as functions that start them, started, checked and restarted."""

    def __init__(self):
        self.starts: dict[str, Callable[[], StreamingQuery]] = {}
        self.queries: dict[str, StreamingQuery] = {}

    def register(self, name: str, start: Callable[[], StreamingQuery]) -> None:
        if name in self.starts:
            raise ValueError(f"a consumer is named {name}")
        self.starts[name] = start

    def start(self, name: str) -> StreamingQuery:
        self.queries[name] = self.starts[name]()
        return self.queries[name]

    def health(self, name: str) -> dict:
        """running, failed or stopped, with the last progress."""
        q = self.queries.get(name)
        if q is None:
            return {"name": name, "state": "not started"}
        p = q.lastProgress or {}
        state = "running" if q.isActive else "failed" if q.exception() else "stopped"
        return {"name": name, "state": state, "batch": p.get("batchId"), "input_rows_per_second": p.get("inputRowsPerSecond"), "processed_rows_per_second": p.get("processedRowsPerSecond"), "duration_ms": (p.get("durationMs") or {}).get("triggerExecution")}

    def restart_failed(self) -> list[str]:
        """Starts what has failed again, from its checkpoint."""
        failed = [n for n in self.queries if self.health(n)["state"] == "failed"]
        for n in failed:
            self.start(n)
        return failed

    def stop(self) -> None:
        for q in self.queries.values():
            if q.isActive:
                q.stop()
