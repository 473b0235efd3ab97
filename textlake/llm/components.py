"""Connected components of a graph of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node in it) of all nodes of ``edges`` (a, b), in either direction.

    Every node points to a smaller one of its component, at first its smallest neighbour. Each round looks at the
    grandparents of a node's neighbours, hangs the node and its parent below the smallest of them, and shortens
    paths. Rounds grow with the logarithm of the longest path. What a round makes is written to the shared folder,
    and only the number of nodes that moved comes to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    links = stored(both.distinct(), "links")
    parents = stored(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), "parents")
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        grand = parents.join(above, "parent")
        near = links.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("near"))
        best = grand.join(near.withColumnRenamed("a", "node"), "node").select("node", "parent", F.least("grand", "near").alias("best"))
        hung = best.select("node", F.col("best").alias("to")).unionByName(best.select(F.col("parent").alias("node"), F.col("best").alias("to")))
        after = stored(
            hung.groupBy("node").agg(F.min("to").alias("to")).join(parents, "node").select(
                "node", F.least("to", "parent").alias("parent"), (F.col("to") < F.col("parent")).alias("moved")
            ),
            "parents",
        )
        parents = after.select("node", "parent")
        if after.where("moved").isEmpty():
            return parents.select("node", F.col("parent").alias("component"))
