"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (summed map-side), stored, and a join of two stored tables; a node with very
many neighbours is a skewed key of that join alone, which adaptive execution splits. Every round is written
to the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attraudit.llm.common import stored


def _star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the edges (u, v) but the roots: root is the smallest node that can be reached."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    if e.isEmpty():
        return e.select("u", F.col("v").alias("root"))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = _star(both, least).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where(F.col("u") != F.col("v")).distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = _star(large, least).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select("u", F.col("v").alias("root"))
        before = now
