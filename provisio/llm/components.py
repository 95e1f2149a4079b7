"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node among its neighbours and itself.

    The least neighbours are written first, so the join has two plain shuffles and Spark can split the part of a hub.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = spool(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its smaller neighbours and itself on the smallest of them. Edges lead from a to a smaller b."""
    least = spool(edges.groupBy("a").agg(F.min("b").alias("low")), "least")
    hung = edges.join(least, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.unionByName(least.withColumnRenamed("low", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table (a long, b long); root is the smallest node of its component.

    Loops and repeated edges do no harm; an empty edge table gives no rows. Steps number about log² of the nodes,
    each written to the shared folder.
    """
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    down = spool(down.distinct(), "edges")
    while True:
        # Done when every node has one parent and no parent has one itself.
        parents = down.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if not parents.filter("n > 1").take(1) and not down.select(F.col("b").alias("a")).distinct().join(down.select("a"), "a", "left_semi").take(1):
            return down.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(down.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        down = spool(_small_star(_large_star(down).distinct()).distinct(), "edges")
