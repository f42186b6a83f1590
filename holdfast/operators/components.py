"""Connected components by alternating large-star and small-star steps.

Each step is one grouping of the edges by node; no step holds more than a
node's neighbours' minimum, and stars are formed with partial minima and a
join, so that a node of very high degree is split like any skewed
join. The number of rounds grows with the logarithm of the longest path.

Defined cases: self-loops and repeated edges change nothing; an edge with a
null end is ignored; an empty table gives an empty table; other columns, of
whatever name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.scratch import drop, written


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of an edge; ``edges`` has columns ``src`` and ``dst``.

    The component is the smallest node in it. The rounds end once all edges form
    stars, which may be so before the first.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    now = written(pairs.distinct(), "cc")
    for _ in range(max_rounds):
        if _settled(now):
            break
        new = written(_star(_star(now, above=True), above=False).distinct(), "cc")
        drop(now)
        now = new
    else:
        if not _settled(now):
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges are stars: each node has one edge to a smaller node and none to greater ones, or none to smaller ones.

    One aggregate by node, summed before its shuffle; no more than a row reaches the driver.
    """
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def _star(edges: DataFrame, above: bool) -> DataFrame:
    """Each node's neighbours (``above``: those beyond it; else those below it, and itself) link to its least neighbour or itself."""
    both = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")).unionByName(edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least"))
    if above:
        linked = both.where("other > node").join(least, "node").select(F.col("least").alias("lo"), F.col("other").alias("hi"))
    else:
        below = both.where("other < node")
        linked = below.join(least, "node").select(F.col("least").alias("lo"), F.col("other").alias("hi")).unionByName(least.where("least < node").select(F.col("least").alias("lo"), F.col("node").alias("hi")))
    return linked.where("lo < hi")
