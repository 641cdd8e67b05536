import hashlib
import math
import random

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    from fractions import Fraction

    keep = [(v, la, [math.floor(scale * Fraction(x)) for x in e]) for v, e, la in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not keep:
        return []
    w = -(-max(len(e) for _, _, e in keep) // parts)
    keep = [(v, la, e + [0] * (w * parts - len(e))) for v, la, e in keep]
    books = [[e[p * w : (p + 1) * w] for _, _, e in sorted(keep, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]] for p in range(parts)]
    near = lambda e, p: min((sum((a - b) ** 2 for a, b in zip(e[p * w : (p + 1) * w], c)), i) for i, c in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(e, p)[1] for p in range(parts)] for _, _, e in keep]
        new = []
        for p in range(parts):
            own = [[e[p * w : (p + 1) * w] for (_, _, e), f in zip(keep, found) if f[p] == i] for i in range(len(books[p]))]
            new.append([[sum(c) // len(m) for c in zip(*m)] if m else books[p][i] for i, m in enumerate(own)])
        books = new
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    out, by = [], {}
    for v, la, e in keep:
        got = [near(e, p) for p in range(parts)]
        out.append([v, "".join(f"{i:02x}" for _, i in got), min(sum(d for d, _ in got), (1 << 63) - 1), la])
        by[la] = by.get(la, 0) + out[-1][2]
    return sorted(((v, c, d, min(by[la], (1 << 63) - 1), digest) for v, c, d, la in out), key=str)


def run(spark, rows, schema=SCHEMA):
    from rulemill.llm.codebooks import vector_codes

    return sorted((tuple(r) for r in vector_codes(spark.createDataFrame(rows, schema)).collect()), key=str)


def vectors(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    return [[rng.choice([-1, 0, 1]) * spread + rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(n)]


@pytest.mark.parametrize("n,dims", [(60, 32), (5, 8), (40, 13), (20, 3)])
def test_plain(spark, n, dims):
    rows = [(i * 7 % n, v, i % 3 or None) for i, v in enumerate(vectors(n, dims, n))]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    v = vectors(30, 16, 1)
    rows = [(i, x, i % 4) for i, x in enumerate(v)]
    rows += [(3, v[3], 3)] * 5 + [(None, v[4], None), (90, None, 1), (91, [None] + v[0][1:], 1), (92, [inf] + v[0][1:], 1), (93, [nan] * 16, None), (94, [], 2), (95, [0.5] * 3, 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []
    assert run(spark, [(1, [], 1)]) == brute([(1, [], 1)])
    ties = [(i, [float(i % 2)] * 8, 0) for i in range(40)]
    assert run(spark, ties) == brute(ties)


def test_very_large_components(spark):
    rows = [(i, [x * 10.0 ** (i % 40) for x in v], i % 2) for i, v in enumerate(vectors(24, 8, 3))] + [(99, [1.7e308] * 8, 1)]
    assert run(spark, rows) == brute(rows)


def test_clashing_columns(spark):
    rows = [(i, v, 1, "a", 2) for i, v in enumerate(vectors(20, 8, 2))]
    got = run(spark, rows, SCHEMA + ", code string, error int")
    assert got == brute([r[:3] for r in rows])


def test_nearest_is_exact():
    from rulemill.llm.codebooks import nearest

    rng = np.random.default_rng(0)
    for width, k, high in ((1, 5, 3), (4, 16, 4), (8, 16, 2), (8, 256, 4096)):
        x, book = rng.integers(-high, high, (500, width)), rng.integers(-high, high, (k, width))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        entry, least = nearest(x, book)
        assert (entry == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_restores_what_it_encodes(spark):
    from rulemill.llm.codebooks import compress, decompress

    rows = [(i, [float(i % 4)] * 8, 0) for i in range(16)]
    codes, books = compress(spark.createDataFrame(rows, SCHEMA))
    assert all(r.restored == [float(r.vec_id % 4)] * 8 and r.error == 0 for r in decompress(codes, books).collect())
