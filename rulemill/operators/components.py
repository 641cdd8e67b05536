"""Connected components by repeated least-neighbour and pointer-jumping joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges (src, dst) -> (node, component): the least node of each component; every node of an edge is listed."""
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    seen = None
    for _ in range(rounds):
        near = both.join(label.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        step = label.join(near, "node").select("node", F.least("component", "m").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        label = cut(step.join(jump, "component").select("node", F.least("component", "up").alias("component")))
        now = label.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]  # ids of any type
        if now == seen:
            return label
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
