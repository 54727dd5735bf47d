"""Versioned tables without a table format on the class path: Parquet folders and a log of JSON files.

Every commit writes a folder of its own and then the log entry that names the folders of the version, by
an atomic create that fails if another writer was there first. Readers see whole versions. All file access is
Spark's file system interface, so tables can be in any store that Spark reads.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.readers import z_value


class ConcurrentCommit(RuntimeError):
    """Another writer committed the version first; read again and retry."""


class TableStore:
    """Tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, at: str) -> Any:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self) -> Any:
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, at: str) -> list[tuple[str, int, int]]:
        """Name, bytes and modification time of what is directly in a folder."""
        fs, path = self._fs(), self._path(at)
        return [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)] if fs.exists(path) else []

    def _commit(self, table: str, entry: dict) -> int:
        at = f"{self.root}/{table}/_log/{entry['version']:020d}.json"
        try:
            out = self._fs().create(self._path(at), False)
        except Exception as e:
            raise ConcurrentCommit(f"{table} already has version {entry['version']}") from e
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return entry["version"]

    def log(self, table: str) -> list[dict]:
        """All commits, the first one first."""
        rows = self.spark.read.text(f"{self.root}/{table}/_log", wholetext=True).collect() if self.exists(table) else []  # a few hundred bytes a version
        return sorted((json.loads(r["value"]) for r in rows), key=lambda e: e["version"])

    def exists(self, table: str) -> bool:
        return bool(self._list(f"{self.root}/{table}/_log"))

    def _entry(self, table: str, version: int | None = None, timestamp: float | None = None) -> dict:
        entries = self.log(table)
        if version is not None:
            entries = [e for e in entries if e["version"] == version]
        if timestamp is not None:
            entries = [e for e in entries if e["time"] <= timestamp]
        if not entries:
            raise ValueError(f"{table} has no version {version if version is not None else timestamp or ''}".strip())
        return entries[-1]

    def create(self, table: str, schema: T.StructType, partitions: list[str] | None = None, properties: dict[str, str] | None = None) -> int:
        if self.exists(table):
            raise ValueError(f"{table} exists")
        return self._commit(table, {"version": 0, "time": time.time(), "operation": "CREATE", "folders": [], "schema": schema.json(), "partitions": partitions or [], "properties": properties or {}, "rows": 0})

    def _write(self, table: str, df: DataFrame, operation: str, keep: list[str], before: dict | None, rows: int | None = None) -> int:
        folder = f"data/{uuid.uuid4().hex}"
        partitions = (before or {}).get("partitions", [])
        writer = df.write
        (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{self.root}/{table}/{folder}")
        schema = df.schema if not keep else merged(T.StructType.fromJson(json.loads(before["schema"])), df.schema)
        entry = {"version": before["version"] + 1 if before else 0, "time": time.time(), "operation": operation, "folders": [*keep, folder], "schema": schema.json(), "partitions": partitions, "properties": (before or {}).get("properties", {})}
        # Rows of the folder that was written, from its files' footers; those of the folders that are kept are known.
        entry["rows"] = (before["rows"] if keep else 0) + self.spark.read.schema(df.schema).parquet(f"{self.root}/{table}/{folder}").count()
        return self._commit(table, entry)

    def _read(self, table: str, entry: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        if not entry["folders"]:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{f}") for f in entry["folders"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(*schema.names)

    def read(self, table: str, version: int | None = None, timestamp: float | None = None) -> DataFrame:
        """The last version, or that of a number or a time."""
        return self._read(table, self._entry(table, version, timestamp))

    def append(self, table: str, df: DataFrame, merge_schema: bool = False) -> int:
        """New columns are only taken with merge_schema; rows of other versions have nulls in them."""
        if not self.exists(table):
            return self._write(table, df, "APPEND", [], None)
        before = self._entry(table)
        known = T.StructType.fromJson(json.loads(before["schema"]))
        new = [c for c in df.columns if c not in known.names]
        if new and not merge_schema:
            raise ValueError(f"{table} has no columns {new}")
        return self._write(table, df, "APPEND", before["folders"], before)

    def overwrite(self, table: str, df: DataFrame) -> int:
        return self._write(table, df, "OVERWRITE", [], self._entry(table) if self.exists(table) else None)

    def merge(self, table: str, updates: DataFrame, keys: list[str], columns: list[str] | None = None) -> int:
        """Rows with a key of the updates take their values (or those of `columns`), others stay, new keys are added. One full outer join."""
        before = self._entry(table)
        old = self._read(table, before)
        a, b = old.withColumn("_old", F.lit(True)).alias("a"), updates.withColumn("_new", F.lit(True)).alias("b")
        both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
        replaced = set(columns or [c for c in updates.columns if c not in keys])

        def value(c: str):
            if c not in updates.columns:
                return F.col(f"a.{c}").alias(c)
            if c in replaced or c in keys:
                return F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
            return F.when(F.col("a._old"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)

        return self._write(table, both.select(*[value(c) for c in old.columns]), "MERGE", [], before)

    def delete(self, table: str, condition: str) -> int:
        before = self._entry(table)
        return self._write(table, self._read(table, before).filter(f"NOT coalesce({condition}, false)"), "DELETE", [], before)

    def restore(self, table: str, version: int) -> int:
        entry, last = self._entry(table, version), self._entry(table)
        return self._commit(table, entry | {"version": last["version"] + 1, "time": time.time(), "operation": f"RESTORE {version}"})

    def history(self, table: str, most: int = 20) -> DataFrame:
        rows = [(e["version"], e["time"], e["operation"], len(e["folders"]), e["rows"]) for e in reversed(self.log(table))][:most]
        return self.spark.createDataFrame(rows, "version long, time double, operation string, folders long, rows long")

    def optimize(self, table: str, target_mb: int = 128, z_order: list[str] | None = None) -> int:
        """The same rows in files of about target_mb, laid out by the interleaved ranks of the z_order columns if given."""
        before = self._entry(table)
        df = self._read(table, before)
        n = max(1, -(-self.describe(table)["bytes"] // (target_mb << 20)))
        if z_order:
            cuts = [df.agg(F.percentile_approx(F.col(c).cast("double"), [i / 64 for i in range(1, 64)])).scalar() for c in z_order]
            rank = lambda i, c: F.size(F.filter(f"_q{i}", lambda x: x < F.col(c).cast("double")))
            ranks = [rank(i, c) for i, c in enumerate(z_order)]
            made = df.withColumns({f"_q{i}": q for i, q in enumerate(cuts)}).withColumn("_z", z_value(ranks, 6))
            df = made.repartitionByRange(n, "_z").sortWithinPartitions("_z").select(*df.columns)
        else:
            df = df.repartition(n)
        return self._write(table, df, "OPTIMIZE", [], before)

    def describe(self, table: str) -> dict:
        """Version, rows, columns, files and bytes of the last version."""
        entry = self._entry(table)
        files = []
        for folder in entry["folders"]:
            walk = self._fs().listFiles(self._path(f"{self.root}/{table}/{folder}"), True)
            while walk.hasNext():
                f = walk.next()
                if f.getPath().getName().endswith(".parquet"):
                    files.append(f.getLen())
        return {"version": entry["version"], "rows": entry["rows"], "columns": T.StructType.fromJson(json.loads(entry["schema"])).names, "files": len(files), "bytes": sum(files), "small_files": sum(x < 32 << 20 for x in files), "partitions": entry["partitions"], "properties": entry["properties"]}

    def vacuum(self, table: str, retention_hours: float = 168, dry_run: bool = False) -> list[str]:
        """Folders that only versions older than the retention use; they go unless it is a dry run, and those versions' log entries with them."""
        entries, limit = self.log(table), time.time() - retention_hours * 3600
        kept = [e for e in entries if e["time"] >= limit or e is entries[-1]]
        used = {f for e in kept for f in e["folders"]}
        gone = sorted({f for e in entries for f in e["folders"]} - used)
        if not dry_run:
            for e in entries:
                if e not in kept:
                    self._fs().delete(self._path(f"{self.root}/{table}/_log/{e['version']:020d}.json"), False)
            for f in gone:
                self._fs().delete(self._path(f"{self.root}/{table}/{f}"), True)
        return gone

    def retain(self, table: str, ts: str, hot_days: int, keep_days: int, as_of: str, archive: str | None = None) -> dict[str, int]:
        """Counts of hot, warm and expired rows; the expired ones are archived, if a folder is given, and deleted."""
        df = self.read(table)
        age = F.datediff(F.lit(as_of).cast("date"), F.to_date(ts))
        counts = df.agg(F.count_if(age <= hot_days).alias("hot"), F.count_if((age > hot_days) & (age <= keep_days)).alias("warm"), F.count_if(age > keep_days).alias("expired")).first().asDict()
        if counts["expired"]:
            if archive:
                df.filter(age > keep_days).write.mode("append").option("compression", "zstd").parquet(archive)
            self.delete(table, f"datediff(DATE '{as_of}', to_date({ts})) > {keep_days}")
        return counts

    def erase(self, table: str, column: str, value: object) -> int:
        """Deletes a person's rows; vacuum() then removes them from storage."""
        return self.delete(table, f"{column} = " + (f"'{value}'" if isinstance(value, str) else str(value)))

    def tables(self) -> list[str]:
        return sorted(name for name, _, _ in self._list(self.root) if self.exists(name))

    def maintain(self, jobs: tuple[str, ...] = ("optimize", "vacuum"), target_mb: int = 128, retention_hours: float = 168, rules: dict[str, tuple[str, int, int]] | None = None, as_of: str | None = None) -> DataFrame:
        """Runs the jobs (retain, optimize, vacuum) over all tables: table, job, version, rows, files and what became of it, a row for each.

        rules: for retain, the time column and days of hot and of all rows, by table. A job that fails, because another writer
        was first for instance, is reported and does not stop the others.
        """
        out = []
        for table in self.tables():
            for job in jobs:
                outcome = "done"
                try:
                    if job == "retain":
                        if rules and table in rules:
                            self.retain(table, *rules[table], as_of)
                        else:
                            outcome = "no rule"
                    elif job == "optimize":
                        if self.describe(table)["files"] > 1:
                            self.optimize(table, target_mb)
                        else:
                            outcome = "one file"
                    elif job == "vacuum":
                        self.vacuum(table, retention_hours)
                    else:
                        raise ValueError(f"not a job: {job!r}")
                except ConcurrentCommit as e:
                    outcome = str(e)
                d = self.describe(table)
                out.append((table, job, d["version"], d["rows"], d["files"], outcome))
        return self.spark.createDataFrame(out, "table string, job string, version long, rows long, files long, outcome string")

    def recommendations(self, table: str, deleted: int = 0) -> list[tuple[str, int]]:
        """What to do about a table, with its points."""
        d = self.describe(table)
        found = [("compact: many files", 30)] if d["files"] > 1000 else []
        found += [("compact: small files", 15)] if d["files"] > 1 and d["bytes"] / d["files"] < 50 << 20 else []
        found += [("z-order", 20)] if d["files"] > 10 and "z_order" not in d["properties"] else []
        return found + ([("vacuum", 10)] if deleted > 100 else [])


def merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """old with the further columns of new."""
    return T.StructType([*old, *[f for f in new if f.name not in old.names]])
