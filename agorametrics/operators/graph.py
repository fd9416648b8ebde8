"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (smallest node of its component) of every node of the edges.

    Every node points at the smallest node it knows: first at its smallest neighbour, then each round at the
    smallest one its neighbours' pointers and its own pointer's pointer lead to. A round combines before it
    shuffles and is written once; their number grows with the logarithm of the longest path.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    now = materialize(both.groupBy("x").agg(F.min(F.least("x", "y")).alias("p")), "pointers")
    while True:
        # what the neighbours point at, given to the node and to what it points at; then a step along the pointers
        told = both.join(now.select(F.col("x").alias("y"), F.col("p").alias("q")), "y").groupBy("x").agg(F.min("q").alias("q"))
        given = now.join(told, "x").select("x", "p", F.least("p", "q").alias("q"))
        none = F.lit(None).cast(now.schema["p"].dataType)
        offers = given.select(F.col("p").alias("x"), "q", none.alias("old")).unionByName(given.select("x", "q", F.col("p").alias("old")))
        hooked = offers.groupBy("x").agg(F.min("q").alias("p"), F.max("old").alias("old"))
        jumped = hooked.join(hooked.select(F.col("x").alias("p"), F.col("p").alias("r")), "p").select("x", F.col("r").alias("p"), "old")
        now = materialize(jumped, "pointers")
        if not now.where("p <> old").limit(1).count():
            break
    return now.select(F.col("x").alias("node"), F.col("p").alias("root"))
