"""Strongly connected components of a directed graph, and the cycles of references they stand for.

The least node that reaches a node and the least node that it reaches are the same for all of a component. Both are label
propagations with jumps: what labels my label reaches me too, so a ring of n nodes settles in about log n rounds. A round
first trims what has no way in or no way out, then keeps components whose two labels agree, and goes on with the edges inside
equal labels, until none is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def least_reaching(edges: DataFrame) -> DataFrame:
    """(node, label): the least node from which a way leads to the node, itself included."""
    e = edges.select("src", "dst")
    label = cut(e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct().withColumn("label", F.col("node")))
    moved = label
    while moved.head(1):
        # only nodes whose label has changed tell it on
        told = e.join(moved.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("told"))
        step = label.join(told, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("told", "label")).alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        label = cut(step.join(up, "label").select("node", "was", F.least("label", "further").alias("label")))
        moved = label.where("label <> was").select("node", "label")
        label = label.select("node", "label")
    return label


def trimmed(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges without those that start where nothing arrives or end where nothing leaves."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return edges.select("src", "dst")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of a component, for every node that lies on a cycle with another."""
    left = cut(trimmed(edges.where("src <> dst").select("src", "dst").distinct()))
    parts = []
    while left.head(1):
        down = least_reaching(left)
        inside = left.join(down.select(F.col("node").alias("src"), F.col("label").alias("f")), "src").join(down.select(F.col("node").alias("dst"), F.col("label").alias("g")), "dst").where("f = g")
        inside = cut(inside.select("src", "dst", "f"))
        up = least_reaching(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = cut(down.join(up.select("node", F.col("label").alias("back")), "node"))
        parts.append(both.where("label = back").select("node", F.col("label").alias("component")))
        rest = both.where("label <> back").select("node", "back")
        left = inside.join(rest.select(F.col("node").alias("src"), F.col("back").alias("x")), "src").join(rest.select(F.col("node").alias("dst"), F.col("back").alias("y")), "dst").where("x = y")
        left = cut(trimmed(left.select("src", "dst")))
    out = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    for p in parts:
        out = out.unionAll(p)
    more = out.groupBy("component").count().where("count > 1")  # what the trimming left may be a component of one
    return out.join(more.select("component"), "component", "left_semi").select("node", "component")


def reference_cycles(edges: DataFrame) -> DataFrame:
    """(node, component, size): every node that lies on a cycle; a reference of a node to itself is a cycle of one."""
    found = strong_components(edges)
    alone = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
    every = found.unionAll(alone.select("node", F.col("node").alias("component")))
    sizes = every.groupBy("component").agg(F.count("*").alias("size"))
    return every.join(sizes, "component").select("node", "component", "size")


def cycle_edges(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """(src, dst, component): the references that lie on cycles."""
    a = cycles.select(F.col("node").alias("src"), "component")
    b = cycles.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("component = other").select("src", "dst", "component")
