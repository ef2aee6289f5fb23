"""Connected components of an edge table: smallest member of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import Table


def components(edges: DataFrame) -> Table:
    """(node, root) for every node of edges (a, b), root the smallest node it is connected to.

    Alternates large-star and small-star steps, each one shuffle by node, until nothing changes:
    O(log^2 n) steps, no step larger than the edge table. Self-loops and repeats don't matter.
    """
    now = Table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        for large in (True, False):
            pairs = now.df.select("a", "b").unionAll(now.df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else now.df
            low = pairs.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
            star = pairs.join(low, "a")
            if large:
                star = star.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            else:
                star = star.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(low.select("a", F.col("low").alias("b")))
            after = Table(star.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
            now.drop()
            now = after
        summed = now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if summed == mark:
            break
        mark = summed
    roots = now.df.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    tops = now.df.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    found = Table(roots.unionAll(tops).groupBy("node").agg(F.min("root").alias("root")))
    now.drop()
    return found
