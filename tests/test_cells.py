import math
import random

import numpy as np
import pytest

from rulemill.operators import cells


def clustered(n, dims, seed, spread=0.3):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [[x + rnd.gauss(0, spread) for x in rnd.choice(centres)] for _ in range(n)]


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.mark.parametrize("least", [0.8, -0.5])
def test_all_pairs(spark, least):
    vectors = clustered(150, 6, 3)
    odd = [None, [0.0] * 6, [float("nan")] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("inf")] + [1.0] * 5]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[i % 3]) for i in range(60)] + [(2000 + i, v) for i, v in enumerate(odd)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    got = cells.similar_pairs(d, "id", "v", least, pivots=9, size=16).collect()
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if cosine(vectors[i], vectors[j]) >= least}
    assert len(got) == len(want) and {(r.left_id, r.right_id) for r in got} == want
    assert all(abs(r.score - cosine(vectors[r.left_id], vectors[r.right_id])) < 1e-9 for r in got)
    m = {r.id: r["class"] for r in cells.membership(d, "id", "v").collect()}
    assert all(m[1000 + i] == i % 3 for i in range(60)) and all(m[2000 + i] == 2000 + i for i in range(5)) and all(m[i] == i for i in range(150))


def test_one_place(spark):
    """All vectors close together: one cell holds them, in pieces, and every task stays small."""
    vectors = clustered(1, 4, 1) * 1
    rnd = random.Random(2)
    rows = [(i, [x + rnd.gauss(0, 0.01) for x in vectors[0]]) for i in range(400)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    got = cells.similar_pairs(d, "id", "v", 0.9, pivots=2, size=32)
    assert got.count() == 400 * 399 // 2
    placed = cells.pieces_of(cells.located(cells.representatives(d, "id", "v").select("id", "v"), cells.pivots_of(cells.representatives(d, "id", "v"), 2)), ["cell"], 32)
    assert max(r["count"] for r in placed.groupBy("cell", "piece").count().collect()) < 4 * 32


def test_few(spark):
    d = spark.createDataFrame([], "id long, v array<double>")
    assert cells.similar_pairs(d, "id", "v", 0.5).count() == 0
    d = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert cells.similar_pairs(d, "id", "v", 0.5).count() == 0


def test_least_similarity(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, None]), v) for i, v in enumerate(clustered(200, 5, 8))]
    rows += [(500, 7, [1.0] * 5), (501, 8, [1.0] * 5), (502, 8, [2.0] * 5), (503, 9, None), (504, 8, [1.0] * 5)]
    got = {r.g: (r.n, r.min_similarity) for r in cells.least_similarity(spark.createDataFrame(rows, "id long, g int, v array<double>"), "g", "id", "v", pivots=8, size=8).collect()}
    for g in {r[1] for r in rows if r[2] is not None}:
        v = [r[2] for r in rows if r[1] == g and r[2] is not None]
        low = min((cosine(a, b) for i, a in enumerate(v) for b in v[:i]), default=None)
        assert got[g][0] == len(v) and (got[g][1] is None if low is None else math.isclose(got[g][1], low, abs_tol=1e-9))
    assert 9 not in got
    assert cells.least_similarity(spark.createDataFrame([], "id long, g int, v array<double>"), "g", "id", "v").count() == 0
