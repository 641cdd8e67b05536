"""Property multigraphs as node and edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .convergence import ranks
from .storage import cut

#: Parts of a component, at most, while its edges are few; edges for a part; ends of edges that a task may hold.
SPREAD, SHARE, HELD = 16, 1 << 14, 1 << 25


def neighbours(edges: DataFrame, nodes: list, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """(node, neighbour), distinct."""
    e = edges.where(F.col("relation").isin(*relations)) if relations else edges
    out = e.where(F.col("src").isin(*nodes)).select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    back = e.where(F.col("dst").isin(*nodes)).select(F.col("dst").alias("node"), F.col("src").alias("neighbour"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def reachable(edges: DataFrame, start: list, depth: int, directed: bool = False) -> DataFrame:
    """(node, distance) up to ``depth`` steps: one join of the frontier a step; seen nodes are not expanded again."""
    spark = edges.sparkSession
    e = edges.select("src", "dst") if directed else both_ways(edges)
    kind = dict(edges.dtypes)["src"]
    seen = spark.createDataFrame([(s, 0) for s in start], f"node {kind}, distance int")
    frontier = seen
    for d in range(1, depth + 1):
        step = e.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.union(frontier)
    return seen


def subgraph(edges: DataFrame, start: list, depth: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` of ``start`` (nearest first, at most ``most``) and the edges among them only."""
    nodes = reachable(edges, start, depth)
    if most is not None:
        nodes = nodes.orderBy("distance", "node").limit(most)
    return nodes, induced(edges, nodes)


#: Relations that are followed first, in order; all others come after them.
PRIORITY = ("CONTAINS", "DEFINES", "REFERENCES", "APPLIES_TO", "HAS_ACTOR", "INVOKES_ALGORITHM", "STORES_IN", "REQUIRES_ENCODING", "HAS_PARAM", "HAS_STORAGE_TARGET", "HAS_FIELD_ENCODING")


def budgeted(nodes: DataFrame, edges: DataFrame, start: list, depth: int = 3, most: int = 100, relations: list[str] | None = None, priority: tuple = PRIORITY) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` nodes of a breadth-first walk from ``start``, and the edges that it went along between them.

    nodes (node, distance, place): the neighbours of an earlier node come before those of a later one; those of one node by
    the priority of the relation, then edges out before edges in, then the neighbour. edges (src, dst, relation): from a node
    to one that the walk reached later. One join of the frontier a step; a step keeps no more nodes than the budget has left,
    found as the top of the order, so what is held never grows beyond it."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    e = edges.where(F.col("relation").isin(*relations)) if relations else edges
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("relation")), F.lit(0))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    e = e.select("src", "dst", "relation", F.lit(0).alias("way")).union(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", F.lit(1).alias("way")))
    known = lambda few: few.join(nodes.select("node").join(few.select("node"), "node", "left_semi").distinct(), "node")  # noqa: E731 - all nodes are read, few are sent
    wanted = known(spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(start))], f"node {kind}, i int"))
    order = F.row_number().over(Window.orderBy("o")) - 1  # over the budget's rows
    top = lambda df, n: df.orderBy("o").limit(n).select("node", order.alias("place"))
    seen = frontier = cut(top(wanted.select("node", F.col("i").alias("o")), most).withColumn("distance", F.lit(0)))
    held = seen.count()
    for d in range(1, depth + 1):
        if held >= most:
            break
        step = e.join(frontier.select(F.col("node").alias("src"), "place"), "src").select(F.col("dst").alias("node"), F.struct("place", rank.alias("rank"), "way", F.col("dst").alias("n")).alias("o"))
        new = step.groupBy("node").agg(F.min("o").alias("o")).join(seen.select("node"), "node", "left_anti")
        new = known(cut(new))
        frontier = cut(top(new, most - held).select("node", (F.col("place") + held).alias("place"), F.lit(d).alias("distance")))
        found = frontier.count()
        if not found:
            break
        seen, held = seen.unionByName(frontier), held + found
    a = seen.where(F.col("distance") < depth).select(F.col("node").alias("src"), F.col("place").alias("a"))
    b = seen.select(F.col("node").alias("dst"), F.col("place").alias("b"))
    along = e.join(a, "src").join(b, "dst").where("b > a").select("src", "dst", "relation").distinct()
    return seen.select("node", "distance", "place"), along


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def shortest_path(edges: DataFrame, source, target, depth: int) -> DataFrame:
    """One row with the least shortest directed path as an array, or no row. Nothing is longer than ``depth``; 0 finds nothing."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    front = spark.createDataFrame([(source, [source])], f"node {kind}, path array<{kind}>")
    for _ in range(depth):
        step = edges.select("src", "dst").join(front.withColumnRenamed("node", "src"), "src").where(~F.array_contains("path", F.col("dst")))
        front = cut(step.groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path")))
        found = front.where(F.col("node") == F.lit(target)).select("path")
        if found.head(1):
            return found
    return front.where("false").select("path")


def strong_cycles(edges: DataFrame, start: list, depth: int) -> DataFrame:
    """(start, length) of the shortest directed cycle through each start node, up to ``depth``."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    front = spark.createDataFrame([(s, s) for s in start], f"start {kind}, node {kind}")
    seen, out = front, None
    e = edges.select("src", "dst").distinct()
    for d in range(1, depth + 1):
        step = e.join(front.withColumnRenamed("node", "src"), "src").select("start", F.col("dst").alias("node")).distinct()
        hit = step.where("start = node").select("start", F.lit(d).alias("length"))
        out = hit if out is None else out.union(hit)
        front = cut(step.join(seen, ["start", "node"], "left_anti"))
        seen = seen.union(front)
    return out.groupBy("start").agg(F.min("length").alias("length"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by type: (what, type, n)."""
    n = nodes.groupBy(F.col("node_type").alias("type")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "type", "n")
    return n.union(edges.groupBy(F.col("relation").alias("type")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "type", "n"))


def expand_definitions(terms: DataFrame, uses: DataFrame, depth: int) -> DataFrame:
    """(term, uses, level): the terms that a term's definition uses, directly or not, each at its least level."""
    return_cols = ["term", "used", "level"]
    front = terms.join(uses, "term").select("term", "used").distinct().withColumn("level", F.lit(1))
    seen = front
    for d in range(2, depth + 1):
        step = front.select(F.col("term").alias("t"), F.col("used").alias("term")).join(uses, "term").select(F.col("t").alias("term"), "used").distinct()
        front = cut(step.where("term <> used").join(seen, ["term", "used"], "left_anti").withColumn("level", F.lit(d)))
        seen = seen.union(front)
    return seen.select(*return_cols)


def maximal_cliques(edges: DataFrame, components: DataFrame, most: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """(component, clique) for every maximal clique of the similarity graph, each found at its first vertex by (degree, id):
    one search a vertex over its later neighbours; earlier ones only tell what isn't maximal. Only where ``most`` is
    given, a component above so many vertices is reported with a null clique. edges: src, dst; components: node, component;
    members: node, names (array) of vertices that stand for several, all linked with each other and with the same others.

    Neither triangles nor the two edges of a vertex are written: the vertices of a component are dealt to parts, and a part gets the
    neighbours of its own vertices and of their later neighbours, each once. So an edge is sent a few times for each part. Parts
    are few while a task may hold the component's edges (HELD), and else so small that no part needs more."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    large = None
    if most is not None:
        sizes = components.groupBy("component").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > most).select("component", F.lit(None).cast("array<long>").alias("clique"))
        few = components.join(sizes.where(F.col("n") <= most), "component", "left_semi").select(F.col("node").alias("src"))
        pairs = pairs.join(few, "src", "left_semi")
    pairs = cut(pairs)
    degree = both_ways(pairs).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    order = ranks(degree.select(F.lit(0).alias("all"), F.struct("d", "node").alias("o")), "all", "o")
    known = order.select(F.col("o.node").alias("node"), F.col("o.d").alias("d"), F.col("rank").alias("r")).join(components.select("node", F.col("component").cast("long").alias("component")), "node")
    own = F.array(F.col("node").cast("long"))
    if members is not None:
        known, own = known.join(members.select("node", F.col("names").cast("array<long>").alias("names")), "node", "left"), F.coalesce("names", own)
    nodes = cut(known.select("component", "node", "r", "d", own.alias("names")))
    end = lambda k, *more: nodes.select(F.col("node").alias(k), F.col("r").alias(f"{k}_r"), *more)
    ranked = cut(pairs.join(end("src", "component", F.col("d").alias("src_d")), "src").join(end("dst", F.col("d").alias("dst_d")), "dst").select("component", "src_r", "dst_r", "src_d", "dst_d"))
    first = F.col("src_r") < F.col("dst_r")
    later = ranked.select("component", F.least("src_r", "dst_r").alias("u"), F.greatest("src_r", "dst_r").alias("v"), F.when(first, F.col("dst_d")).otherwise(F.col("src_d")).alias("d"))
    held = later.groupBy("component").agg(F.count("*").alias("m"), F.sum("d").alias("w"))
    parts = F.least(F.lit(SPREAD), F.ceil(F.col("m") / SHARE))
    parts = F.when(2 * F.col("m") > HELD, F.greatest(parts, F.ceil(F.col("w") / HELD))).otherwise(parts)
    plan = F.broadcast(held.select("component", parts.alias("parts")).where("parts > 1"))  # a row for SHARE edges at most
    part = F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).alias("part")
    wanted = later.join(plan, "component", "left").select("component", part, F.col("v").alias("r"), F.lit(False).alias("home"))
    wanted = wanted.union(nodes.select("component", F.col("r").alias("u")).join(plan, "component", "left").select("component", part, F.col("u").alias("r"), F.lit(True).alias("home")))
    wanted = wanted.groupBy("r", "component", "part").agg(F.max("home").alias("home"))
    near = both_ways(ranked.select(F.col("src_r").alias("src"), F.col("dst_r").alias("dst"))).groupBy(F.col("src").alias("r")).agg(F.sort_array(F.collect_list("dst")).alias("near"))
    sent = wanted.join(near, "r").join(nodes.select("r", "names"), "r")
    spread = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(spread, "component", "part").sortWithinPartitions("component", "part").select("component", "part", "r", "home", "names", "near")
    out = sent.mapInArrow(_searches, "component long, clique array<long>")
    return out if large is None else out.union(large)


def _searches(batches):
    """Rows of a part follow each other; a part is searched when its last row is seen."""

    def found(component, rows):
        many = []
        for clique in (c for r, (home, _, _) in rows.items() if home for c in _cliques(r, rows)):
            many.append(clique)
            if len(many) == 1000:
                yield block(component, many)
                many = []
        if many:
            yield block(component, many)

    def block(component, many):
        return pa.RecordBatch.from_pydict({"component": pa.array([component] * len(many), pa.int64()), "clique": pa.array(many, pa.list_(pa.int64()))})

    at, rows = None, {}
    for batch in batches:
        component, part, r, home, names, near = batch.columns
        values, ends = near.flatten().to_numpy(), np.concatenate([[0], np.cumsum(near.value_lengths().to_numpy())])
        for i, here in enumerate(zip(component.to_pylist(), part.to_pylist())):
            if here != at:
                if rows:
                    yield from found(at[0], rows)
                at, rows = here, {}
            rows[r[i].as_py()] = home[i].as_py(), names[i].as_py(), values[ends[i] : ends[i + 1]]
    if rows:
        yield from found(at[0], rows)


def _cliques(vertex: int, rows: dict):
    """Maximal cliques whose first vertex is given, as sorted names. rows: whether a vertex is searched, names, neighbours in order.
    Sets of vertices are bits: later neighbours first, then earlier ones; those that see the same later ones count once."""
    around = rows[vertex][2]
    split = int(np.searchsorted(around, vertex))
    names = around[split:].tolist()
    if not names:
        return
    n, near = len(names), []
    sees: dict[int, int] = {}  # of earlier neighbours, which later ones they see
    for i, p in enumerate(names):
        there = rows[p][2]
        at = np.searchsorted(there, around)
        hit = np.flatnonzero(there[np.minimum(at, len(there) - 1)] == around)
        mask = np.zeros(n, np.uint8)
        mask[hit[hit >= split] - split] = 1
        near.append(int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little"))
        for x in hit[hit < split].tolist():
            sees[x] = sees.get(x, 0) | 1 << i
    for k, mask in enumerate(sorted(set(sees.values()))):
        near.append(mask)
        for v in _bits(mask):
            near[v] |= 1 << (n + k)
    later = (1 << n) - 1
    stack = [((), later, (1 << len(near)) - 1 - later)]
    while stack:
        r, p, x = stack.pop()
        if not p:
            if not x:
                yield sorted(name for v in (vertex, *(names[i] for i in r)) for name in rows[v][1])
            continue
        pivot = max(_bits(p | x), key=lambda v: (near[v] & p).bit_count())
        for v in _bits(p & ~near[pivot]):
            stack.append(((*r, v), p & near[v] & later, x & near[v]))
            p &= ~(1 << v)
            x |= 1 << v


def _bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low
