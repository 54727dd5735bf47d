"""Catalog and lineage: tables as rows of a frame, and the graph of what is made from what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.quality import profile

TABLE = "name string, path string, description string, owner string, tags array<string>, columns array<string>"
EDGE = "source string, target string, operation string"


def entry(df: DataFrame, name: str, path: str, description: str = "", owner: str = "", tags: list[str] | None = None) -> DataFrame:
    """One row of TABLE for a frame."""
    return df.sparkSession.createDataFrame([(name, path, description, owner, tags or [], df.columns)], TABLE)


def search(catalog: DataFrame, term: str) -> DataFrame:
    """Tables whose name, description, tags or columns contain the term, in either case."""
    low = term.lower()
    text = F.lower(F.concat_ws("\n", "name", "description", F.array_join("tags", "\n"), F.array_join("columns", "\n")))
    return catalog.filter(text.contains(low))


def statistics(df: DataFrame) -> DataFrame:
    """Counts, distinct values and ranges of every column, in one pass."""
    return profile(df)


def reachable(edges: DataFrame, start: str, downstream: bool = True, most: int = 10) -> DataFrame:
    """asset and distance of all that `start` leads to (or comes from), cycles included once; a join a step, until nothing is new."""
    here, there = ("source", "target") if downstream else ("target", "source")
    steps = edges.select(F.col(here).alias("asset"), F.col(there).alias("next")).distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "asset string, distance int")
    front = seen
    for distance in range(1, most + 1):
        found = front.select("asset").join(steps, "asset").select(F.col("next").alias("asset")).distinct().join(seen.select("asset"), "asset", "left_anti")
        rows = [(r["asset"], distance) for r in found.collect()]  # the assets of a catalog are few
        if not rows:
            break
        front = spark.createDataFrame(rows, "asset string, distance int")
        seen = seen.unionByName(front)
    return seen.filter("distance > 0")


def impact(edges: DataFrame, start: str, most: int = 10) -> DataFrame:
    """How many assets depend on `start` at each distance."""
    return reachable(edges, start, True, most).groupBy("distance").agg(F.count("*").alias("assets"))


def storage_cost(tables: DataFrame, row_bytes: int = 1000, dollars_a_gb: float = 0.023) -> DataFrame:
    """Monthly cost of tables (name, rows)."""
    return tables.withColumn("monthly_cost", F.round(F.col("rows") * row_bytes / 1e9 * dollars_a_gb, 6))
