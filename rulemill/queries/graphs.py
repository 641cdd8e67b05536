"""Graph queries: suppliers, parts, nations and regions as nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cycles, graph
from ..session import read
from .registry import query

EDGES = """
    e as (select 'S' || s_suppkey as src, 'N' || s_nationkey as dst, 'IN' as relation from supplier union all select 'N' || n_nationkey, 'R' || n_regionkey, 'OF' from nation
      union all select distinct 'P' || l_partkey, 'S' || l_suppkey, 'FROM' from lineitem)"""


def edges_of(spark, sf_dir, once=True):
    """A walk needs no edge only ``once``: it looks for its frontier's edges, and those are few before all lines are compared."""
    name = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    s = read(spark, sf_dir, "supplier").select(name("S", "s_suppkey").alias("src"), name("N", "s_nationkey").alias("dst"), F.lit("IN").alias("relation"))
    n = read(spark, sf_dir, "nation").select(name("N", "n_nationkey").alias("src"), name("R", "n_regionkey").alias("dst"), F.lit("OF").alias("relation"))
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    li = li.distinct() if once else li
    return s.union(n).union(li.select(name("P", "l_partkey").alias("src"), name("S", "l_suppkey").alias("dst"), F.lit("FROM").alias("relation")))


@query(f"with {EDGES} select distinct * from (select src as node, dst as neighbour from e where src in ('S1', 'N3') union all select dst, src from e where dst in ('S1', 'N3'))")
def graph_neighbours(spark, sf_dir):
    return graph.neighbours(edges_of(spark, sf_dir, once=False), ["S1", "N3"])


@query(f"""with recursive {EDGES}, b as (select src, dst from e union all select dst, src from e),
    w(node, distance) as (select 'R1', 0 union select dst, distance + 1 from w join b on b.src = w.node where distance < 3)
    select node, min(distance)::int as distance from w group by 1""")
def graph_reachable(spark, sf_dir):
    """Nodes within three steps of a region, both ways."""
    return graph.reachable(edges_of(spark, sf_dir, once=False), ["R1"], 3)


@query(f"""with {EDGES}, n as (select 'R1' as node union select src from e where dst = 'R1') select count(*) as n from e where src in (select node from n) and dst in (select node from n)""")
def graph_induced(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return graph.subgraph(e, ["R1"], 1)[1].agg(F.count("*").alias("n"))


@query(f"""with recursive {EDGES}, d as (select distinct src, dst from e), first as (select min(src) as s from d where src like 'P%'),
    w(node, path, k) as (select s, [s], 0 from first union all select dst, list_append(path, dst), k + 1 from w join d on d.src = w.node where k < 4 and not list_contains(path, dst))
    select array_to_string(min(path), '>') as path from w where starts_with(node, 'R') and k = 3 and node = (select min(node) from w where starts_with(node, 'R'))""")
def graph_path(spark, sf_dir):
    """The least shortest path from the first part to the first region that it reaches."""
    e = edges_of(spark, sf_dir, once=False)
    start = e.where("src like 'P%'").agg(F.min("src")).first()[0]
    goal = graph.reachable(e, [start], 4, directed=True).where("node like 'R%'").agg(F.min("node")).first()[0]
    return graph.shortest_path(e, start, goal, 4).select(F.array_join("path", ">").alias("path"))


@query(f"""with {EDGES} select 'edge' as what, relation as type, count(*) as n from e group by 2
    union all select 'node', left(v, 1), count(distinct v) from (select src as v from e union all select dst from e) group by 2""")
def graph_statistics(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    nodes = e.select(F.col("src").alias("v")).union(e.select(F.col("dst").alias("v"))).distinct().select(F.left("v", F.lit(1)).alias("node_type"))
    return graph.statistics(nodes, e)


@query(None)
def graph_cliques(spark, sf_dir):
    """Maximal groups of similar vectors; tested against brute force."""
    from ..operators.retrieval import similar_cliques

    return similar_cliques(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 0.35)


REFERENCES = """
    e as (select distinct o_custkey as src, o_orderkey % 1499 as dst from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus <> 'O')"""


@query(f"""with recursive {REFERENCES}, w(s, node) as (select src, dst from e union select w.s, e.dst from w join e on e.src = w.node),
    c as (select a.s as node, least(min(b.s), a.s) as component from w a left join w b on b.node = a.s and a.node = b.s group by a.s having bool_or(a.node = a.s))
    select node, component, count(*) over (partition by component) as size from c""")
def graph_cycles(spark, sf_dir):
    """Customers refer to each other through orders: the components of all cycles of references."""
    o = read(spark, sf_dir, "orders").where("o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus <> 'O'")
    return cycles.reference_cycles(o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1499).alias("dst")).distinct())


@query(f"""with recursive {EDGES}, b as (select src, dst, relation, 0 as way from e union all select dst, src, relation, 1 from e),
    p as (select *, case relation when 'OF' then 1 when 'IN' then 2 else 3 end as rank from b),
    l0 as (select 'R1' as node, 0 as distance, 0::bigint as place),
    l1 as (select node, 1 as distance, row_number() over (order by o) as place from (select dst as node, min(struct_pack(a := l.place, b := rank, c := way, d := dst)) as o from p join l0 l on p.src = l.node group by dst) where node not in (select node from l0)),
    s1 as (select * from l0 union all select * from l1),
    l2 as (select node, 2 as distance, (select count(*) from s1) - 1 + row_number() over (order by o) as place from (select dst as node, min(struct_pack(a := l.place, b := rank, c := way, d := dst)) as o from p join l1 l on p.src = l.node group by dst) where node not in (select node from s1)),
    s2 as (select * from s1 union all select * from l2),
    l3 as (select node, 3 as distance, (select count(*) from s2) - 1 + row_number() over (order by o) as place from (select dst as node, min(struct_pack(a := l.place, b := rank, c := way, d := dst)) as o from p join l2 l on p.src = l.node group by dst) where node not in (select node from s2)),
    s as (select * from (select * from s2 union all select * from l3) where place < 40)
    select s.node, s.distance, s.place, (select count(*) from (select distinct p.src, p.dst, p.relation from p join s t on t.node = p.dst where p.src = s.node and t.place > s.place and s.distance < 3)) as edges_out from s""")
def graph_budgeted(spark, sf_dir):
    """The first forty nodes around a region by relation priority, with the number of edges that lead on from each."""
    e = edges_of(spark, sf_dir, once=False)
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node")))
    found, along = graph.budgeted(nodes, e, ["R1"], 3, 40, priority=("OF", "IN"))
    n = along.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("edges_out"))
    return found.join(n, "node", "left").na.fill(0, ["edges_out"])
