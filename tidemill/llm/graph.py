"""Connected components of a link table by alternating large and small stars, in O(log n) rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (node, root): every linked node with the smallest node it reaches.

    Each round hangs the greater neighbours of a node onto its least neighbour, then the lesser
    ones; the least neighbour is an aggregate, so a node with very many links costs no task
    more than its rows. Each round's links are written, so a lost executor never unrolls the loop.
    """
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "components")
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), "components")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x"))
        small = materialize(small.select("x.a", "x.b").filter("a <> b").distinct(), "components")
        # Stars with one centre each stay as they are: no node has two parents, and no parent has one.
        parents = small.groupBy("a").agg(F.count("*").alias("n"))
        done = parents.filter("n > 1").isEmpty() and small.select(F.col("b").alias("a")).distinct().join(parents, "a", "left_semi").isEmpty()
        discard(links)
        discard(large)
        links = small
        if done:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
