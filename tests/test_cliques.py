import itertools
import random

import numpy as np

from rulemill.operators import components, graph, retrieval


def brute(near):
    found = []

    def grow(r, p, x):
        if not p and not x:
            found.append(sorted(r))
        for v in sorted(p):
            grow(r | {v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow(set(), {v for v in near if near[v]}, set())
    return sorted(c for c in found if c)


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def test_no_triangles_are_written(spark, monkeypatch):
    """Every two of 90 are linked: 4,005 edges, 117,480 triangles. (The first form wrote them, and shuffled twice as many paths.)"""
    written = []

    def cut(df, cut=graph.cut):
        written.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(graph, "cut", cut)
    pairs = [*itertools.combinations(range(90), 2), *((200 + i, 201 + i) for i in range(40))]
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = sorted(r.clique for r in graph.maximal_cliques(e, components.connected(e)).collect())
    assert got == sorted([list(range(90)), *([200 + i, 201 + i] for i in range(40))])
    assert max(written) <= len(pairs)


def test_parts_of_a_component(spark, monkeypatch):
    """A component lies in many parts, by its edges or by what a task may hold, and gives the same."""
    rnd = random.Random(3)
    pairs = [(a, b) for a, b in itertools.combinations(range(50), 2) if rnd.random() < 0.35] + [(60, 61), (61, 62), (60, 62)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    comp = components.connected(e)
    want = brute(neighbours(pairs))
    for share, held in ((20, 1 << 25), (1 << 14, 100), (1 << 14, 1 << 25)):
        monkeypatch.setattr(graph, "SHARE", share)
        monkeypatch.setattr(graph, "HELD", held)
        assert sorted(r.clique for r in graph.maximal_cliques(e, comp).collect()) == want and len(want) > 100


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [[float(x) for x in np.float32(rng.normal(size=5))] for _ in range(24)]
    rows = [(i + 100 * c, base[i], i % 2) for i in range(24) for c in range(1 + i % 4)]
    rows += [(900, [0.0] * 5, 0), (901, [0.0] * 5, 0), (902, [1.0, None, 0.0, 0.0, 0.0], 0), (903, None, 1), (904, base[0], None), (None, base[0], 0)]
    rows += [(910, [9.0, 0.0, 0.0, 0.0, 0.0], 7), (911, [9.0, 0.0, 0.0, 0.0, 0.0], 7)]  # like nothing else
    rows += [(3, base[5], 1), (7, base[7], 1), (0, base[8], 0)]  # ids that stand with two vectors, and a row twice
    near = {}
    for (i, v, g), (j, w, h) in itertools.combinations(rows, 2):
        if i is None or j is None or i == j or g is None or g != h or v is None or w is None or None in v or None in w:
            continue
        a, b = np.array(v), np.array(w)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        if n and a @ b / n >= 0.35:
            near.setdefault(i, set()).add(j)
            near.setdefault(j, set()).add(i)
    seen = []
    monkeypatch.setattr(retrieval, "maximal_cliques", lambda e, *a, f=retrieval.maximal_cliques, **k: seen.append(e.count()) or f(e, *a, **k))
    got = retrieval.similar_cliques(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "vec_id", "label", "embedding", 0.35).collect()
    want = brute(near)
    assert sorted(r.clique for r in got) == want and [910, 911] in want and any(3 in c for c in want)
    low = {}
    for v in near:  # the least of what is reached
        reach, todo = {v}, [v]
        while todo:
            todo += (more := near[todo.pop()] - reach)
            reach |= more
        low[v] = min(reach)
    assert all(r.component == low[r.clique[0]] for r in got)
    assert 4 * seen[0] < sum(map(len, near.values())) / 2
