"""Connected components of a table of links, by alternating star contractions.

A round links every neighbour of a node to the least node it sees: first the larger neighbours
(large star), then the smaller ones (small star). Each keeps the components and shortens paths,
so the rounds grow with the logarithm of the longest path. Links, not neighbour lists, are
shuffled; the least neighbour is an aggregate that combines on the map side, so a node with very
many links is no burden to one task. Every round is written to the shared folder. Up to ``FEW`` links
(two numbers each) are contracted by one task, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.store import dropped, shuffled, written

FEW = 1 << 18


def _least(links: DataFrame, few: bool) -> DataFrame:
    """(node, other, low): each link with the least node among ``node`` and all its others."""
    least = links.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("low"))
    return links.join(least if few else shuffled(least), "node")


def _round(links: DataFrame, few: bool) -> DataFrame:
    def dealt(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    both = dealt(links.union(links.select(F.col("other").alias("node"), F.col("node").alias("other"))))
    large = _least(both, few).where("other > node").select(F.col("other").alias("node"), F.col("low").alias("other")).where("node > other").distinct()
    small = _least(large, few)
    moved = dealt(small.select(F.col("other").alias("node"), F.col("low").alias("other")).union(small.select("node", F.col("low").alias("other"))))
    return moved.where("node > other").distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its least node.

    Links of a node with itself, links with a null end and repeated links change nothing; nodes
    without links are not in the result.
    """
    a, b = F.col(left), F.col(right)
    now = written(links.where(a != b).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)")).alias("sum")).first()
        if tuple(seen) == mark or not seen["n"]:
            break
        mark = tuple(seen)
        following = written(_round(now, seen["n"] <= FEW), "links")
        dropped(now)
        now = following
    roots = now.select(F.col("other").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select("node", F.col("other").alias("component")).union(roots)
