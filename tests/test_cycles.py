import random

import pytest

from rulemill.operators import cycles, graph


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: set() for n in nodes}
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    for n in nodes:
        stack = [n]
        while stack:
            for m in out[stack.pop()]:
                if m not in reach[n]:
                    reach[n].add(m)
                    stack.append(m)
    got = {n: min(m for m in nodes if m == n or (m in reach[n] and n in reach[m])) for n in nodes if n in reach[n]}
    return {(n, c, sum(x == c for x in got.values())) for n, c in got.items()}


@pytest.mark.parametrize("seed,n,m", [(2, 60, 75), (3, 30, 120)])
def test_equals_brute_force(spark, seed, n, m):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(5, 5)]
    d = spark.createDataFrame(edges, "src int, dst int")
    found = cycles.reference_cycles(d)
    assert {tuple(r) for r in found.collect()} == brute_components(edges)
    comp = {a: c for a, c, _ in brute_components(edges)}
    want = {(a, b, comp[a]) for a, b in edges if a in comp and comp[a] == comp.get(b)}
    assert {tuple(r) for r in cycles.cycle_edges(d, found).collect()} == want


def test_long_ring_and_bridges(spark):
    """A ring of 120 nodes in shuffled order, a bridge from it into another ring, and a way out."""
    ring = list(range(120))
    random.Random(6).shuffle(ring)
    edges = list(zip(ring, ring[1:] + ring[:1])) + [(10, 1000), (1000, 1001), (1001, 1002), (1002, 1003), (1003, 1002), (1003, 2000), (3000, 10)]
    got = {tuple(r) for r in cycles.reference_cycles(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {(i, 0, 120) for i in ring} | {(1002, 1002, 2), (1003, 1002, 2)}


def test_no_cycles(spark):
    assert cycles.reference_cycles(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).count() == 0
    assert cycles.reference_cycles(spark.createDataFrame([], "src string, dst string")).count() == 0


def walk(nodes, edges, start, depth, most, priority):
    """The queue, one node at a time."""
    place = {p: i for i, p in enumerate(priority)}
    seen, along, queue = {}, set(), [(s, 0) for s in start]
    while queue and len(seen) < most:
        node, d = queue.pop(0)
        if node in seen or node not in nodes:
            continue
        seen[node] = (d, len(seen))
        if d < depth:
            near = {(place.get(r, 99), 0, b, r) for a, b, r in edges if a == node} | {(place.get(r, 99), 1, a, r) for a, b, r in edges if b == node and a != b}
            for _, _, other, r in sorted(near):
                if other not in seen:
                    queue.append((other, d + 1))
                    along.add((node, other, r))
    return {(n, d, p) for n, (d, p) in seen.items()}, {(a, b, r) for a, b, r in along if a in seen and b in seen}


@pytest.mark.parametrize("seed,depth,most", [(1, 3, 100), (2, 3, 12), (4, 0, 5)])
def test_budgeted(spark, seed, depth, most):
    rnd = random.Random(seed)
    relations = ["CONTAINS", "REFERENCES", "OTHER", "APPLIES_TO"]
    edges = list({(rnd.randrange(40), rnd.randrange(40), rnd.choice(relations)) for _ in range(70)})
    nodes = [n for n in range(38)]
    start = [3, 39, 7, 3]
    got = graph.budgeted(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(edges, "src int, dst int, relation string"), start, depth, most)
    want = walk(set(nodes), edges, start, depth, most, graph.PRIORITY)
    assert {tuple(r) for r in got[0].collect()} == want[0]
    assert {tuple(r) for r in got[1].collect()} == want[1]
