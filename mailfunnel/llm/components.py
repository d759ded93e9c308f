"""Connected components of an edge table by alternating large-star and small-star rounds in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node's neighbours are linked to the smallest of them and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    linked = both.join(low, "a")
    out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of long node ids -> ``(node, root)`` for every node with an edge; root is the smallest node reachable.

    Only counts go to the driver. Each round is written to the shared folder. Self links and repeated edges are
    ignored; null ends are dropped; an empty table gives an empty result.
    """
    now = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now = staged(_star(_star(now, True), False), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b"), F.col("b")).distinct())
