"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fernwerk.storage import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; a component is named by its least node.

    Alternates large-star and small-star contractions, so the number of rounds grows with the logarithm of the longest
    path. A round is two aggregates with map-side combine and two joins against one row a node, which adaptive execution
    splits where a node is hot; its edges are written out, which cuts the lineage. Nulls and self-loops join nothing.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    e = materialise(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = materialise(nodes, "nodes")
    for _ in range(max_rounds):
        # done when each node hangs on one other, and none of those hangs on a third
        hung = e.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.lit(1).alias("side"))
        held = e.select(F.col("b").alias("a"), F.lit(1).cast("long").alias("c"), F.lit(2).alias("side"))
        if hung.union(held).groupBy("a").agg(F.max("c").alias("c"), F.count_distinct("side").alias("sides")).where("c > 1 or sides > 1").isEmpty():
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: greater neighbours move to the least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the node and its smaller neighbours move to the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        e = materialise(large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
