"""Sources and sinks: files, JDBC, Kafka where its connector is there, streams, and partitioned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "timestamp": T.TimestampType()}


def struct(columns: dict[str, str]) -> T.StructType:
    """A schema by type names, without a session."""
    return T.StructType([T.StructField(c, KINDS[k]) for c, k in columns.items()])


# Payloads of the two main streams.
TRANSACTION = struct({"transaction_id": "string", "user_id": "string", "product_id": "string", "price": "double", "quantity": "int", "ts": "timestamp", "user_location": "string", "device_info": "string", "payment_method": "string", "currency": "string"})
BEHAVIOR = struct({"event_id": "string", "user_id": "string", "session_id": "string", "event_type": "string", "ts": "timestamp", "page_url": "string", "user_location": "string", "device_info": "string", "user_agent": "string", "event_properties": "string"})
# Partition columns of each type of data, and the column that dates come from.
PARTITIONS = {
    "transactions": (("year", "month", "day"), "ts"), "user_events": (("year", "month", "day", "event_type"), "ts"), "product_updates": (("category", "year", "month"), "ts"),
    "analytics_results": (("result_type", "year", "month"), "ts"), "customer_profiles": (("segment", "region"), None),
}


Transform = Callable[[DataFrame], DataFrame]


def read_files(spark: SparkSession, paths: str | list[str], fmt: str = "parquet", schema: T.StructType | str | None = None, stamp: bool = False, transform: Transform | None = None, **options) -> DataFrame:
    """parquet, orc, csv (with header), json and text files; stamp adds the file each row came from, transform is applied last. Spark reads them in parallel."""
    reader = spark.read.format(fmt).options(**({"header": True} | options if fmt == "csv" else options))
    df = (reader.schema(schema) if schema else reader).load(paths)
    df = df.withColumn("source_file", F.col("_metadata.file_path")) if stamp else df
    return transform(df) if transform else df


def export(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite", compression: str | None = None) -> None:
    """A report as json, csv (with header), parquet or orc files, by all tasks; nested columns go to csv as JSON."""
    if fmt not in ("json", "csv", "parquet", "orc"):
        raise ValueError(f"not a format for exports: {fmt!r}")
    if fmt == "csv":
        df = df.withColumns({f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType)})
    writer = df.write.mode(mode).format(fmt).options(**({"header": True} if fmt == "csv" else {}))
    (writer.option("compression", compression) if compression else writer).save(path)


def read_jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 4, **options) -> DataFrame:
    """A query on a database; with a partition column and its bounds, in parallel."""
    if (partition_column is None) != (bounds is None):
        raise ValueError("a partition column needs bounds, and bounds a column")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) AS q").options(**options)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def kafka_options(servers: str, topic: str, **options) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "failOnDataLoss": "false"} | {k: str(v) for k, v in options.items()}


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType, streaming: bool = True, **options) -> DataFrame:
    """The payload of a topic with its Kafka columns; needs Spark's Kafka connector on the class path."""
    options = kafka_options(servers, topic, **({"startingOffsets": "latest"} if streaming else {"startingOffsets": "earliest", "endingOffsets": "latest"}) | options)
    raw = (spark.readStream if streaming else spark.read).format("kafka").options(**options).load()
    return parse(raw, schema)


def parse(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the JSON in `value`; key, topic, partition, offset and time of the message where the frame has them."""
    kept = [F.col(a).alias(b) for a, b in (("key", "kafka_key"), ("topic", "topic"), ("partition", "partition"), ("offset", "offset"), ("timestamp", "kafka_timestamp")) if a in raw.columns]
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("_p"), *kept).select("_p.*", *[c for c in ("kafka_key", "topic", "partition", "offset", "kafka_timestamp") if any(c in str(k) for k in kept)])


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None, ts: str | None = None, watermark: str | None = None, transform: Transform | None = None) -> DataFrame:
    """A folder as a stream; timestamps without zone become timestamps, which watermarks need. transform is applied last."""
    reader = spark.readStream.format(fmt).schema(schema)
    df = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)
    if ts:
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    df = df.withWatermark(ts, watermark) if watermark else df
    return transform(df) if transform else df


def write_stream(df: DataFrame, fmt: str, checkpoint: str, path: str | None = None, mode: str = "append", trigger: str | None = None, partitions: list[str] | None = None, name: str | None = None) -> StreamingQuery:
    """Starts a stream; without a trigger interval it takes what there is and ends."""
    if fmt not in ("console", "memory", "parquet", "json", "csv", "orc", "kafka", "delta"):
        raise ValueError(f"not a sink: {fmt!r}")
    writer = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    writer = writer.partitionBy(*partitions) if partitions else writer
    writer = writer.queryName(name) if name else writer
    return writer.start(path) if path else writer.start()


def with_dates(df: DataFrame, data_type: str) -> tuple[DataFrame, list[str]]:
    """df with the year, month and day that its type is partitioned by, and the partition columns."""
    columns, ts = PARTITIONS[data_type]
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth}
    made = df.withColumns({c: parts[c](ts) for c in columns if c in parts and c not in df.columns}) if ts else df
    return made, list(columns)


def write_partitioned(df: DataFrame, path: str, data_type: str, mode: str = "append", sort: list[str] | None = None) -> None:
    """Parquet by the partition columns of the type, one shuffle by them, sorted inside; AQE splits what is too large."""
    made, columns = with_dates(df, data_type)
    made = made.hint("rebalance", *columns)
    made = made.sortWithinPartitions(*columns, *(sort or []))
    made.write.mode(mode).option("compression", "snappy").partitionBy(*columns).parquet(path)


def read_partitioned(spark: SparkSession, path: str, partitions: dict[str, object] | None = None, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Equality or membership for each partition column, and the columns asked for; both reach the scan.

    With a schema no file is opened to find it; without one, files of different schemas are merged.
    """
    df = spark.read.schema(schema).parquet(path) if schema else spark.read.option("mergeSchema", True).parquet(path)
    for name, value in (partitions or {}).items():
        df = df.filter(F.col(name).isin(*value) if isinstance(value, list | tuple | set) else F.col(name) == value)
    return df.select(*columns) if columns else df


def partition_advice(data_type: str, rows_a_day: int) -> list[str]:
    """Partition columns by volume: fewer levels below a million rows a day, all from ten million on."""
    columns = list(PARTITIONS[data_type][0])
    if rows_a_day < 1_000_000:
        return columns[:1] if PARTITIONS[data_type][1] is None else [c for c in columns if c not in ("day",)]
    return columns if rows_a_day >= 10_000_000 else [c for c in columns if c != "event_type"]


def z_value(columns: list[Column], bits: int = 16) -> Column:
    """Interleaved bits of non-negative integers below 2^bits: rows near in all columns are near in it."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for j, c in enumerate(columns):
            bit = F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, i * len(columns) + j))
    return out
