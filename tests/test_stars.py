import os
import random
from difflib import SequenceMatcher

import pytest

from rulemill.operators import stars
from rulemill.operators.discovery import fuzzy_merge, merged


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def sequential(rows, least, measure):
    """rows: id, block, text."""
    out, centres = {}, {}

    def alike(a, b):
        if measure == "words":
            x, y = set((a or "").lower().split()), set((b or "").lower().split())
            return bool(x and y) and len(x & y) / len(x | y) > least
        a, b = (a or "").lower().strip(), (b or "").lower().strip()
        return bool(a and b) and SequenceMatcher(None, a, b).ratio() >= least

    for i, block, text in sorted(rows, key=lambda r: r[0]):
        for c, t in centres.setdefault(block, []):
            if alike(t, text):
                out[i] = c
                break
        else:
            centres[block].append((i, text))
            out[i] = i
    return out


def rows_of(n, blocks, seed):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("key", "name", "usage", "serial", "policy") for b in ("", "s", "Id", "Set")]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12))) for _ in range(max(4, n // 8))]
    out = []
    for i in rnd.sample(range(n * 3), n):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 8)):
            t[rnd.randrange(len(t))] = rnd.choice("abcé \U0001f600")
        out.append((i, rnd.randrange(blocks), rnd.choice([None, "", " ", "".join(t), "".join(t).upper()]) if rnd.random() < 0.3 else "".join(t)))
    return out


@pytest.mark.parametrize("measure,least", [("ratio", 0.7), ("words", 0.5)])
@pytest.mark.parametrize("batch,piece", [(512, 8192), (4, 7)])
def test_equals_sequential(spark, monkeypatch, measure, least, batch, piece):
    monkeypatch.setattr(stars, "BATCH", batch)
    monkeypatch.setattr(stars, "PIECE", piece)
    rows = rows_of(160 if batch > 4 else 60, 3, int(least * 100) + batch)
    d = spark.createDataFrame([(i, b or None, t) for i, b, t in rows], "id long, block int, text string")
    got = {r.id: r.star for r in stars.greedy_stars(d, ["block"], "id", "text", least, measure).collect()}
    assert got == sequential([(i, b or None, t) for i, b, t in rows], least, measure)


def test_bound_never_refuses_what_is_alike():
    rows = [t for _, _, t in rows_of(80, 1, 5) if t and t.strip()]
    for least in (0.3, 0.6, 0.85):
        m = stars.Ratio(rows, least)
        for i in range(0, len(rows), 5):
            near = set(m.near(m, i).tolist())
            for j in range(len(rows)):
                alike = SequenceMatcher(None, rows[i], rows[j]).ratio() >= least
                assert alike == (j in near and m.alike(j, m, i))


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 0.8])
def test_shared_words_are_counted_not_compared(monkeypatch, least):
    """``near`` alone says who is alike, from lists of words: no pair of sets is intersected."""
    rows = ["", "x", *[(t or "") for _, _, t in rows_of(120, 1, 9)]]
    sets = [set(t.split()) for t in rows]
    m, other = stars.Words(rows, least), stars.Words(rows[::3] + ["none of these"], least)
    m.sets = None
    for i, s in enumerate(map(set, other.sets)):
        want = [j for j, o in enumerate(sets) if s & o and len(s & o) > least * len(s | o)]
        assert [j for j in m.near(other, i) if m.alike(j, other, i)] == want
    assert stars.Words([], least).near(other, 0).size == 0


def test_hot_block(spark):
    """One block with many rows of few kinds: few rounds, no pairs."""
    rnd = random.Random(3)
    kinds = ["".join(rnd.choice("abcdefghij") for _ in range(60)) for _ in range(20)]
    rows = [(i, 1, kinds[i % 20] + str(i)) for i in range(20000)]
    d = spark.createDataFrame(rows, "id long, block int, text string")
    got = {r.id: r.star for r in fuzzy_merge(d, ["block"], "id", "text").collect()}
    assert got == {i: i % 20 for i in range(20000)}


def test_empty_and_no_block(spark):
    d = spark.createDataFrame([], "id long, block int, text string")
    assert fuzzy_merge(d, ["block"], "id", "text").count() == 0
    d = spark.createDataFrame([(2, "abcdef"), (1, "abcdeg"), (3, None)], "id long, text string")
    assert {tuple(r) for r in stars.greedy_stars(d, [], "id", "text", 0.8).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_merged(spark):
    d = spark.createDataFrame([(1, 0.5, ["a"]), (2, 0.9, ["b", "a"]), (3, 0.1, [])], "id long, conf double, refs array<string>")
    s = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, star long")
    assert {(r.star, r.id, r.conf, tuple(r.refs)) for r in merged(d, s, "id", "conf", ["refs"]).collect()} == {(1, 2, 0.9, ("a", "b")), (3, 3, 0.1, ())}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_query(spark):
    from rulemill.queries import queries
    from rulemill.session import read

    want = sequential([(r.p_partkey, r.p_type, f"{r.p_name} {r.p_brand} {r.p_size}") for r in read(spark, SF, "part").collect()], 0.85, "ratio")
    assert {r.id: r.star for r in queries()["merge_fuzzy"](spark, SF).collect()} == want
