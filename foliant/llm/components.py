"""Connected components of an edge table by alternating stars, as Spark joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import attach, remove, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node of its component. Every round links
    the greater neighbours of a node, then the lesser ones, to the least node in sight; paths shorten to stars in
    about log(nodes) rounds. Each node's least neighbour comes from a partial sum, and reaches a hub's edges without
    bringing them together. A round's tables are deleted when the next one's are written."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = attach(both, least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = written(large, "stars")
        down = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = attach(large, down, "b").select(F.col("m").alias("p"), F.explode(F.array("a", "b")).alias("q"))
        old, edges = edges, written(small.where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "edges")
        remove(old, "edges"), remove(large, "stars")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
