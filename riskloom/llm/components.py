"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import saved


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node of edges (a, b) but the roots themselves: root is the least node reachable. Each step links neighbours to the least of
    them, which keeps components whole; it ends when a step changes no edge. Lineage is cut at each round."""
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # large star: neighbours above a node are linked to the least of the node and its neighbours
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        # small star: a node and its lesser neighbours are linked to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = saved(large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct(), "edges")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
