"""Pairs of vectors in pieces against brute force; what is held and sent stays bounded."""

import math
import random

import numpy as np

from rulemill.operators import cells, retrieval


def vectors(n, dims, seed):
    rnd = random.Random(seed)
    return [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(n)]


def test_pairs_within_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([1, 1, 1, 2, None]), v) for i, v in enumerate(vectors(120, 5, 7))]
    rows += [(500, 1, [0.0] * 5), (501, 1, None), (502, 1, [1.0, None, 1.0, 1.0, 1.0]), (503, 1, [1.0] * 4), (504, 1, [1.0] * 4), (None, 1, [1.0] * 5)]
    own = [(i, b, np.array(v)) for i, b, v in rows if None not in (i, b, v) and None not in v]
    cos = lambda x, y: float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y) or 1))
    d = spark.createDataFrame(rows, "id long, b int, v array<double>")
    for least in (0.3, -0.1):
        want = {(i, j) for i, b, v in own for j, c, w in own if i < j and b == c and len(v) == len(w) and cos(v, w) >= least}
        for size in (16, 1000):
            got = [(r.left_id, r.right_id) for r in cells.pairs_within(d, "b", least, size).collect()]
            assert set(got) == want and len(got) == len(want) > 100


def test_many_vectors_of_a_block(spark):
    """8,000 vectors of one block: 32 million pairs by rows."""
    d = spark.createDataFrame([(i, 1, v) for i, v in enumerate(vectors(8000, 16, 3))], "id long, b int, v array<double>")
    m = cells.unit(np.array(vectors(8000, 16, 3)))
    assert retrieval.similar_pairs(d, "id", "b", "v", 0.8).count() == (np.triu(m @ m.T, 1) >= 0.8).sum()


def test_pivots_follow_the_size_of_pieces(spark):
    """Where nothing is pruned a vector is sent to every cell, so cells must not be small."""
    d = spark.createDataFrame([(i, v) for i, v in enumerate(vectors(3000, 16, 3))], "id long, v array<double>")
    assert len(cells.pivots_of(d, size=1000)) == 3 and len(cells.pivots_of(d)) == 55


def test_visits_come_in_small_batches():
    """A row may visit every cell; a batch holds no more than STEP rows' visits."""
    import pyarrow as pa

    v = np.array(vectors(2000, 8, 1))
    pivots = cells.unit(v[:40])
    cell = cells._distances(cells.unit(v), pivots).argmin(axis=1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(v.tolist()), pa.array(cell, pa.int32())], ["id", "v", "cell"])
    out = list(cells._visits(pivots, np.full(40, 2.0), 2.0)([batch]))
    assert max(b.num_rows for b in out) <= cells.STEP * 40 and sum(b.num_rows for b in out) == int((cell + 1).sum())
    assert math.isclose(sum(float(np.square(cells.matrix(b.column("v"))).sum()) for b in out), sum(b.num_rows for b in out), rel_tol=1e-9)
