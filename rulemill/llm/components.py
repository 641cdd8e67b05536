"""Connected components by alternating large-star and small-star rounds, after local union-find in each partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


class Unions:
    """Union-find over any hashable nodes; the root is the least node."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


SPREAD = 8  # parts of the edges of one node
FOREST_NODES = 200_000  # nodes held by a local union-find before it is flushed


def _forest(batches):
    """Edges of one partition as (node, local root): at most one row a node and flush, whatever the number of edges."""

    def rows(u):
        pairs = [(x, r) for x in u.parent if (r := u.find(x)) != x]
        a = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"a": a[:, 0], "b": a[:, 1]})

    u = Unions()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            u.join(a, b)
        if len(u.parent) > FOREST_NODES:
            yield rows(u)
            u = Unions()
    yield rows(u)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) -> (node, root): the least node of each node's component; roots are not listed."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_forest, "a long, b long").distinct(), "edges")
    seen = None
    def spread(edges, low):
        """``edges`` (a, b) with the node's ``m``; a node's edges are dealt to SPREAD tasks."""
        own = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SPREAD)))
        return own.join(low.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))), ["a", "part"])

    for _ in range(rounds):
        last = e
        # large star: neighbours above a node are linked to the least of its neighbours and itself
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its lower neighbours are linked to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = spread(large, low)
        e = stored(joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        dropped(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
