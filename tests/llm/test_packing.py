import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P

from .util import EDGE, docs

PATH = P.path("byte_bpe_50k.json")


def test_knapsack_and_master():
    from rulemill.llm.packing import cutting_stock, knapsack, rounded

    price = np.zeros(10)
    price[3], price[4] = 0.3, 0.45
    best, pattern = knapsack(price, {3: 9, 4: 9}, 10)
    assert pattern(10) == {3: 2, 4: 1} and abs(best[10] - 1.05) < 1e-9
    best, pattern = knapsack(price, {3: 1, 4: 9}, 10)
    assert pattern(10) == {4: 2} and abs(best[10] - 0.9) < 1e-9
    demand = {6: 100, 4: 100, 5: 60, 3: 10}
    plan = cutting_stock(demand, 10)
    assert abs(sum(x for _, x in plan) - 133) < 1.5
    for n, k in demand.items():
        assert sum(p.get(n, 0) * x for p, x in plan) >= k - 1e-6
    took = Counter()
    for p, t in rounded(plan, demand, 10, 0):
        assert sum(n * k for n, k in p.items()) == 10
        for n, k in p.items():
            took[n] += k * t
    assert all(took[n] <= demand[n] for n in demand) and took[6] >= 98


def test_column_generation_improves_its_start():
    """Largest first is far from the least number of sequences here; the optimum fills every sequence."""
    from rulemill.llm.packing import Master, fullest

    for demand, capacity in (({6: 60, 5: 60, 4: 60, 3: 40, 2: 20}, 10), ({49: 40, 34: 40, 26: 80, 25: 80, 17: 120, 8: 10}, 100), ({51: 100, 27: 100, 26: 100, 23: 200, 25: 200}, 100)):
        assert all(sum(n * k for n, k in p.items()) <= capacity for p in fullest(demand, capacity))
        master = Master(demand, capacity, gap=1e-9, cut=1).solve()  # nothing pays to be cut
        plan = master.plan()
        for n, k in demand.items():
            assert sum(p.get(n, 0) * x for p, x in plan) >= k - 1e-6
        assert all(sum(n * k for n, k in p.items()) <= capacity for p, _ in plan)
        # Farley: no pattern is worth more than 1 at the duals of an optimal plan, so the duals' value is the optimum
        assert sum(x for _, x in plan) <= brute_optimum(demand, capacity) + 1e-6
        assert master.bound <= brute_optimum(demand, capacity) + 1e-6


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_pricing_on_the_given_tables(spark, scale):
    """Knapsacks are priced, what they make is used, duals stay small and the plan is within the gap of the bound."""
    from pyspark.sql import functions as F

    from rulemill.llm.packing import GAP, LENGTH, Layout, Master, tokenised

    rows = tokenised(spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet").repartition(16), PATH).where("rem > 0")
    demand = {r.rem: r.n for r in rows.groupBy("rem").agg(F.count("*").alias("n")).collect()}
    master = Master(demand).solve()
    assert master.pricings > 50 and len(master.generated()) > 50 and abs(master.dual).max() < 10
    assert master.cost @ master.use <= (1 + GAP) * master.bound + 1e-3
    plan, ids = Layout(demand), sum(n * k for n, k in demand.items())
    assert plan.sequences <= ids // LENGTH + 11 and plan.by_patterns >= 0.99 * ids


def brute_optimum(demand, capacity):
    """The linear program over all maximal patterns, by a plain simplex with Bland's rule on its dual."""
    lengths = sorted(demand)

    def every(i, room):
        if i < 0:
            yield ()
            return
        for k in range(room // lengths[i] + 1):
            for rest in every(i - 1, room - k * lengths[i]):
                yield (*rest, k)

    rows = [p for p in every(len(lengths) - 1, capacity) if capacity - sum(n * k for n, k in zip(lengths, p)) < lengths[0]]
    m, n = len(rows), len(lengths)
    t = np.zeros((m + 1, n + m + 1))
    t[:m, :n], t[:m, n : n + m], t[:m, -1], t[m, :n] = rows, np.eye(m), 1, [-demand[x] for x in lengths]
    basis = list(range(n, n + m))
    while (enter := next((j for j in range(n + m) if t[m, j] < -1e-9), None)) is not None:
        ratio = [(t[i, -1] / t[i, enter], basis[i], i) for i in range(m) if t[i, enter] > 1e-9]
        i = min(ratio)[2]
        t[i] /= t[i, enter]
        for r in range(m + 1):
            if r != i:
                t[r] -= t[r, enter] * t[i]
        basis[i] = enter
    return t[m, -1]


def test_patterns_take_the_remainders():
    """Over 95 % of the ids of remainders are placed whole by patterns; sequences are as few as ids allow."""
    import pyarrow.parquet as pq

    from rulemill.llm.packing import LENGTH, Layout, token_ids

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    made = Counter(len(ids) % LENGTH for ids in token_ids([t or "" for t in texts], PATH))
    made.pop(0, None)
    rnd = random.Random(8)
    for demand in (dict(made), {n: rnd.randint(1, 9000) for n in range(1, 2048)}, {1500: 1000}, {1500: 700, 1100: 900, 20: 3}, {1: 10**9, 2047: 10**9 + 5}, {700: 5}, {}):
        plan = Layout(demand)
        ids = sum(n * k for n, k in demand.items())
        assert plan.sequences <= 1.002 * ids / LENGTH + 11
        assert plan.by_patterns >= (0.95 if len(demand) > 4 or 1 in demand else 0.6 if ids > 10**6 else 0) * ids
        assert all(0 <= plan.given[n] <= k for n, k in demand.items())
        for n, runs in plan.runs.items():
            assert [r[0] for r in runs] == [0, *(r[1] for r in runs)][: len(runs)]
        cut = sum((demand[n] - plan.given[n]) * n for n in demand)
        assert sum(t * w for _, t, w, _, _ in plan.regions) >= cut and [r[0] for r in plan.regions] == sorted(r[0] for r in plan.regions)


def test_cut_documents_fill_holes(spark):
    """Every remainder has 1,500 ids: sequences hold one and the parts of others, without padding. Clashing columns are ignored."""
    from pyspark.sql import functions as F

    from rulemill.llm.packing import pack_documents

    texts = [" the" * 1499] * 40 + [None]
    rows = pack_documents(docs(spark, texts).withColumns({n: F.lit(7) for n in ("rem", "uid", "rank", "salt", "p", "runs", "start")}), PATH).collect()
    seqs, at = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        at.setdefault(r.doc_id, []).append((r.start, r.length))
    for v in [*seqs.values(), *at.values()]:
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 2048 or v in at.values()
    sizes = [sum(n for _, n in v) for v in seqs.values()]
    assert sum(sizes) == 40 * 1500 + 1 and all(n == 2048 or n & (n - 1) == 0 for n in sizes)
    assert sum(len(v) == 1 for v in at.values()) >= 28


def test_pack(spark):
    from tokenizers import Tokenizer

    from rulemill.llm.packing import pack_documents

    t = Tokenizer.from_file(PATH)
    rnd = random.Random(3)
    texts = EDGE + [" ".join(rnd.choices(["the", "word", "édit", "x1", "\n"], k=rnd.randint(1, 3000))) for _ in range(120)] + ["hot copy " * 100] * 60 + ["a<|endoftext|>b"]
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]
    rows = pack_documents(docs(spark, texts), PATH).collect()
    seen, seqs = {}, {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in enumerate(ids):
        at = 0
        for s, n in sorted(seen[i]):
            assert s == at
            at += n
        assert at == len(x)
    pad = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert pad <= 0.002 * sum(map(len, ids))
    assert pack_documents(docs(spark, []), PATH).count() == 0
    assert pack_documents(docs(spark, [None]), PATH).collect()[0].length == 1
