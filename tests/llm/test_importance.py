import hashlib
import math
import re
import zlib

import pytest

from .util import EDGE, docs

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows, target, ngram=1, buckets=10000, least=20, percent=10, seed=2024):
    def found(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(UP, LOW)))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    own, s, t = [(i, *found(x)) for i, x in rows], [0] * buckets, [0] * buckets
    for _, _, f in own:
        for b in f:
            s[b] += 1
    for x in target:
        for b in found(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for i, n, f in own:
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for k, r in enumerate(long[: percent * len(long) // 100], 1):
        r[4] = k
    return [r[:5] for r in out]


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(([r.doc_id, r.n_features, r.weight, r.score, r.rank] for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("ngram", [1, 3])
def test_resample(spark, ngram):
    from rulemill.llm.importance import resample

    texts = [*EDGE, "NUL\0and \x01 x" * 30, *[" ".join(f"W{(i * j) % 97}é" for j in range(i)) for i in range(60)]]
    target = ["W1é w2É w3é", None, "", "w4é"]
    got = resample(docs(spark, texts), docs(spark, target), ngram=ngram, buckets=50, percent=30).collect()
    same(got, brute(list(enumerate(texts)), target, ngram, 50, percent=30))


def test_repeated_null_and_clashing(spark):
    from pyspark.sql import functions as F

    from rulemill.llm.importance import resample

    texts = ["a b c " * 10] * 30 + ["d e f " * 12] * 10 + [None] * 3
    ids = [None, 7, 7, 7] + list(range(36)) + [5, 5, None]
    d = docs(spark, texts, ids=ids).withColumn("row", F.lit("x")).withColumn("score", F.lit(1)).withColumn("kind", F.lit(0)).withColumn("rank", F.lit(2))
    got = resample(d, spark.createDataFrame([], "item_id long, text string"), percent=50).collect()
    same(got, brute(list(zip(ids, texts)), [], percent=50))


def test_empty(spark):
    from rulemill.llm.importance import resample

    assert resample(docs(spark, []), docs(spark, ["a"])).count() == 0
    assert [r.rank for r in resample(docs(spark, ["a b", None]), docs(spark, ["a"])).collect()] == [None, None]
