"""Connected components of a graph given by edges, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.session import stage


def shared_key_edges(pairs: DataFrame, node: str, key: str) -> DataFrame:
    """Edges ``a, b`` that tie each node to the first node of every key it shares; one per row, never all pairs."""
    first = pairs.groupBy(key).agg(F.min(node).alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pairs.join(first, key).where(F.col(node) != F.col("b")).select(F.col(node).alias("a"), "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge: the smallest node it is connected to.

    Rounds tie the neighbours of each node to the smallest of them, first the larger ones, then the smaller ones
    (Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014). A round moves edges only and is
    written before the next one; long chains shrink by a constant factor each round.
    """
    now, before = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = state
        around = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(smaller.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
