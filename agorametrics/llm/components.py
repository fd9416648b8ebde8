"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics.llm.common import release, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of the component) of all nodes of the edges a, b.

    Every round links the neighbours of a node to the smallest of them. Rounds grow with the logarithm
    of the longest path; each is written to the shared folder. A node with very many neighbours is
    split by the skew join, and its minimum is taken before the shuffle. Self-loops and repeats are
    allowed; a node that has only a self-loop is its own root.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a or b = m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        large = large.unionByName(low.select("a", F.col("m").alias("b"))).where("a >= b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = stored(small.where("a >= b").distinct(), "edges")
        # two numbers of each table tell whether a round changed anything
        facts = [d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for d in (now, after)]
        if facts[0] == facts[1]:
            release(now)
            return after.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        release(now)
        now = after
