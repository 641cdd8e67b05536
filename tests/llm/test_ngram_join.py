import random
import re

from .util import EDGE, docs


def brute(texts, n, percent, ids):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    up, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(s), least[find(i)], links[i]) for i, s in enumerate(sets)}


def corpus():
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randint(0, 400)}"
    texts = list(EDGE)
    for base in range(12):
        w = [word() for _ in range(rnd.choice([4, 9, 12, 40, 120, 300]))]
        for _ in range(rnd.choice([1, 4, 25])):
            v = list(w)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
                v[rnd.randrange(len(v))] = word()
            v = v[: len(v) - rnd.choice([0, 0, 1, 2])]
            texts.append(" ".join(v).upper() if rnd.random() < 0.2 else " ".join(v))
    passage = [word() for _ in range(30)]
    texts += [" ".join([word() for _ in range(200)] + passage) for _ in range(15)]
    # boilerplate chains: texts of growing sizes made of one passage, each like the next and unlike the last
    long = [f"b{i}" for i in range(160)]
    texts += [" ".join(long[:k]) for k in range(30, 160, 3)] + [" ".join(long[k : k + 60]) for k in range(0, 60, 4)]
    return texts


def test_join(spark, monkeypatch):
    from rulemill.llm import ngram_join as m

    texts = corpus()
    rnd = random.Random(2)
    ids = rnd.sample(range(10**6), len(texts))
    for n, percent, members in ((5, 80, 256), (3, 90, 7)):
        monkeypatch.setattr(m, "MEMBERS", members)
        want = brute(texts, n, percent, ids)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in m.ngram_join(docs(spark, texts, ids=ids), n, percent).collect()}
        assert got == want, [(k, want[k], got[k]) for k in want if want[k] != got[k]][:5]


def test_prefix_pairs_lose_no_link(monkeypatch):
    """Blocks of any size, and matches expanded a few at a time, find the links of plain comparison."""
    import numpy as np

    from rulemill.llm import ngram_join as m

    rnd = random.Random(4)
    sets = [sorted(rnd.sample(range(60), rnd.randint(3, 40))) for _ in range(80)]
    sets += [sorted(set(s) - set(rnd.sample(s, rnd.choice([0, 1, 1, 2])))) for s in sets]
    count = {x: sum(x in s for s in sets) for x in range(60)}
    rows = []
    for i, s in enumerate(sets):
        order = sorted(s, key=lambda x: (count[x], x))[: m.prefix_length(len(s), 80)]
        rows.append((i, len(s), np.array(order, np.uint64), np.arange(len(order)), np.array(s, np.uint64) << np.uint64(57), 1))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    assert len(want) > 60
    for expand in (7, 1 << 20):
        monkeypatch.setattr(m, "EXPAND", expand)
        assert {(a.node[k], b.node[j]) for a, b, k, js in m.links_between(rows, None, 80) for j in js.tolist()} == want
        half = [(a.node[k], b.node[j]) for a, b, k, js in m.links_between(rows[:90], rows[90:], 80) for j in js.tolist()]
        assert len(half) == len(set(half)) and set(half) == {(i, j) for i, j in want if i < 90 <= j}


def test_size_bands(spark):
    from pyspark.sql import functions as F

    from rulemill.llm.ngram_join import size_band

    for percent in (80, 90, 100):
        band = [r[0] for r in spark.range(1, 3000).select(size_band(F.col("id"), percent)).collect()]
        assert all(band[m - 1] - band[n - 1] <= 1 for n in range(1, 2000) for m in [min(2999, n * 100 // percent)])


def test_join_edges(spark):
    from rulemill.llm.ngram_join import ngram_join

    assert ngram_join(docs(spark, [])).count() == 0
    rows = ngram_join(docs(spark, ["a b c d e f"] * 3, ids=[4, 4, None])).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in rows if r.doc_id) == [(4, 4, 1), (4, 4, 1)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def test_components(spark):
    from rulemill.llm.components import connected_components

    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 300), (300, 200), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {200: 100, 300: 100}
