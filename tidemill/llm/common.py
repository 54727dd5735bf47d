"""What the training-data operators share: tables, shared storage, words and batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the complement of the words `[^\x20\x09-\x0D]+`; bytes.split() cuts at the same characters.
SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set, else a temporary folder (local sessions only)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        at = f"file://{tempfile.gettempdir()}/tidemill-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", at) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        return at
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def materialize(df: DataFrame, label: str, partition_by: str | None = None, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later stages start from files that outlive executors."""
    at = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def placed(docs: DataFrame) -> DataFrame:
    """Each row of docs as _row, a struct of all its columns, with the place where it is written: _file and _at, the row in the file.

    What does not come straight from files is written first. Whatever the columns of docs are named, they clash with nothing here.
    """
    boxed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    if "_metadata" not in {c.lower() for c in docs.columns}:
        with contextlib.suppress(AnalysisException):
            return docs.select(boxed, *place)
    return materialize(docs.select(boxed), "placed").select("_row", *place)


def discard(df: DataFrame) -> None:
    """Deletes the files that a materialized table was read from, when nothing reads them any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(conf).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more: first Python's references to them go, which takes a moment, then the JVM's."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors when they would not find it by themselves."""
    root = Path(__file__).resolve().parents[2]
    known = {os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")] if p}
    sc = spark.sparkContext
    if str(root) in known or any(os.path.exists(f"{p}/tidemill/llm/common.py") for p in known) or getattr(sc, "_tidemill_shipped", False):
        return
    made = Path(tempfile.mkdtemp()) / "tidemill_pkg.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in (root / "tidemill").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(made))
    sc._tidemill_shipped = True


def map_batches(df: DataFrame, f, schema: str, keep: bool = False) -> DataFrame:
    """df.mapInArrow, with this package on the executors. Workers drop what earlier stages kept on them, unless `keep`."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        return f(batches)

    return df.mapInArrow(f if keep else run, schema)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    rare = SPACES.replace("\n", "")
    text = F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.translate(text, rare, " " * len(rare))).otherwise(text)
    return F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body's lambdas use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The column's texts one by one, null as empty, without a Python copy of the whole batch."""
    for x in batch.column(batch.schema.get_field_index(column)):
        yield x.as_py() or ""


def trim() -> None:
    """Gives memory that a worker has freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class WordCache(dict):
    """word -> compute(word), of bounded size: what was not asked for since the last `most` new words goes."""

    def __init__(self, compute, most: int = 400_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, word):
        out = self.old.get(word)
        if out is None:
            out = self.compute(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


def forget() -> None:
    """Drops what on_worker() has kept on this worker process, and gives its memory back."""
    if store := sys.__dict__.get("_tidemill_worker"):
        store.clear()
        trim()


def on_worker(key: str, make):
    """A value made once for each Python worker process and kept for its later tasks."""
    store = sys.__dict__.setdefault("_tidemill_worker", {})
    if key not in store:
        store[key] = make()
    return store[key]
