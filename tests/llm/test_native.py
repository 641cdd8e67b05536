import hashlib
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from .util import EDGE, docs


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality(spark):
    from rulemill.llm.quality import quality_rules

    texts = [*EDGE, "a b c a b c d\na b c a b c d\n# * $", "the cat sat. " + " ".join(f"w{i}" for i in range(80))]
    got = {r.doc_id: r for r in quality_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), (i, r)
        assert not (r.base_failed and r.kept)
    assert quality_rules(docs(spark, [])).count() == 0


def test_quality_plan_has_no_exchange(spark):
    from rulemill.llm.quality import quality_rules

    plan = quality_rules(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_exact(spark):
    from rulemill.llm.exact import exact_dedup, misra_gries

    texts = [*EDGE, *["hot Text"] * 50, *["HOT tEXT"] * 30, "É", "é"]
    got = {r.doc_id: r for r in exact_dedup(docs(spark, texts), counters=3).collect()}
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    for i, t in enumerate(low):
        same = [j for j, u in enumerate(low) if u == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    repeated = exact_dedup(docs(spark, ["t", "t", "t"], ids=[5, 5, 1])).collect()
    assert sum(r.kept for r in repeated) == 1 and all(r.keep_id == 5 for r in repeated)
    assert exact_dedup(docs(spark, [])).count() == 0
    import pyarrow as pa

    keys = ["a"] * 60 + [f"k{i}" for i in range(40)]
    out = list(misra_gries(2)(iter([pa.RecordBatch.from_pydict({"d": keys[i::3]}) for i in range(3)])))[0].to_pydict()
    assert "a" in out["digest"] and len(out["digest"]) <= 2


def test_sharding(spark):
    from rulemill.llm.sharding import BinTree, best_fit_decreasing, even_bins, shard_documents

    texts = [*EDGE, *[f"text {i} " * (i % 17) for i in range(400)], *["same text"] * 40]
    rows = shard_documents(docs(spark, texts), 24).collect()
    assert len(rows) == len(texts)
    by_text, slots = {}, {}
    for r in rows:
        t = texts[r.doc_id]
        assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert by_text.setdefault(t or "", r.shard) == r.shard and 0 <= r.shard < 24
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shard_documents(docs(spark, [])).count() == 0
    tree = BinTree()
    for i in range(200):
        tree.insert((i * 37 % 101, i))
    for i in range(0, 200, 2):
        tree.delete((i * 37 % 101, i))
    left = sorted((i * 37 % 101, i) for i in range(1, 200, 2))
    for b in range(105):
        assert tree.ceiling((b, -1)) == next((x for x in left if x >= (b, -1)), None)
    assert len(set(best_fit_decreasing([(6, "a"), (5, "b"), (4, "c"), (5, "d")], 10).values())) == 2
    assert best_fit_decreasing([(11, "a")], 10) is None
    load = Counter()
    items = [(1 + i * 7919 % 1000, i) for i in range(3000)]
    for i, b in even_bins(items, 24).items():
        load[b] += items[i][0]
    assert max(load.values()) <= 1.005 * sum(x for x, _ in items) / 24
    _ = F


def test_size_classes_equal_plain_best_fit():
    """Packing sizes with their numbers fills bins as packing the groups one by one does, and evenly."""
    import random

    from rulemill.llm.sharding import best_fit_classes, best_fit_decreasing, even_classes

    rnd = random.Random(2)
    for _ in range(60):
        sizes = rnd.choices([rnd.randint(1, 300) for _ in range(rnd.randint(1, 40))], k=rnd.randint(1, 400))
        classes = sorted(Counter(sizes).items(), reverse=True)
        capacity = rnd.randint(max(sizes), 4 * max(sizes))
        plain = Counter()
        for i, b in best_fit_decreasing(list(zip(sizes, range(len(sizes)))), capacity).items():
            plain[b] += sizes[i]
        load = Counter()
        for (size, count), runs in zip(classes, best_fit_classes(classes, capacity)):
            assert sum(k for _, k in runs) == count
            for b, k in runs:
                load[b] += k * size
        assert sorted(load.values()) == sorted(plain.values())
    classes = sorted(((rnd.randint(8, 30000), rnd.randint(1, 10**6)) for _ in range(3000)), reverse=True)
    load, total = Counter(), sum(s * k for s, k in classes)
    for (size, count), runs in zip(classes, even_classes(classes, 24)):
        assert sum(k for _, k in runs) == count
        for b, k in runs:
            load[b] += k * size
    assert len(load) == 24 and max(load.values()) <= 1.0002 * total / 24 and min(load.values()) >= 0.998 * total / 24
    assert even_classes([], 24) == []


def test_shards_are_even_and_other_columns_ignored(spark):
    from rulemill.llm.sharding import BITS, shard_documents, size_class

    texts = [f"text {i} " * (1 + i % 37) for i in range(6000)] + ["x" * 4000] * 3
    d = docs(spark, texts).withColumns({n: F.lit("x") for n in ("size", "g", "uid", "class", "salt", "shard", "rank", "n")})
    load, shards = Counter(), {}
    for r in shard_documents(d).collect():
        load[r.shard] += r.size
        assert shards.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert len(load) == 24 and max(load.values()) <= 1.01 * sum(load.values()) / 24 and min(load.values()) >= 0.98 * sum(load.values()) / 24
    sizes = [1, 8, 4095, 4096, 4097, 8191, 8193, 10**9 + 1, 10**15 + 7]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "x long").select(size_class(F.col("x"))).collect()]
    assert all(x <= y <= x * (1 + 2.0 ** (1 - BITS)) for x, y in zip(sizes, got)) and got[:3] == sizes[:3]


def test_sharding_with_large_groups(spark):
    from rulemill.llm.sharding import even_bins, shard_documents

    small = [(1000 + i * 7919 % 200, i) for i in range(3072)]
    total = sum(x for x, _ in small)
    for hot in ([total // 19], [total // 9], [total // 2], [99 * total], [total // 2, total // 3, total // 9]):
        items = small + [(x, f"hot{i}") for i, x in enumerate(hot)]
        size, load = {name: x for x, name in items}, Counter()
        at = even_bins(items, 24)
        for name, b in at.items():
            load[b] += size[name]
        assert set(load) == set(range(24))
        others = [v for b, v in load.items() if b not in {at[f"hot{i}"] for i in range(len(hot))}]
        assert len(others) == 24 - len(hot) and sum(others) == total
        assert max(others) <= 1.01 * total / len(others) and min(others) >= 0.95 * total / len(others)
    assert len(set(even_bins([(100, i) for i in range(25)], 24).values())) == 24
    texts = [f"text {i} " * 20 for i in range(2000)]
    for share in (0.5, 200):  # a third of the bytes, nearly all of them
        hot = "hot " * int(share * sum(len(t) + 8 for t in texts) / 4 / 10)
        rows = shard_documents(docs(spark, texts + [hot] * 10), 24).collect()
        load = Counter()
        for r in rows:
            load[r.shard] += r.size
        own = {r.shard for r in rows if r.doc_id >= len(texts)}
        others = [v for b, v in load.items() if b not in own]
        assert len(rows) == len(texts) + 10 and len(own) == 1 and len(others) == 23
        assert max(others) <= 1.05 * sum(others) / 23 and min(others) >= 0.9 * sum(others) / 23
