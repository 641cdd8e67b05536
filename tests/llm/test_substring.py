import hashlib
import random
import re
from collections import Counter

import numpy as np

from .util import EDGE, docs


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    c = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if c[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def test_hashes():
    from rulemill.llm.fingerprints import window_hashes, word_hashes

    texts = [b"a b a", b"", b" a\tb  ", b"b", "é a b é".encode()]
    words, counts = word_hashes(texts, lower=False)
    assert counts.tolist() == [3, 0, 2, 1, 4]
    names = [x for t in texts for x in t.split()]
    same = {}
    for n, h in zip(names, words.tolist()):
        assert same.setdefault(n, h) == h
    assert len(set(same.values())) == len(same)
    h, sizes = window_hashes(words, counts, 2)
    assert sizes.tolist() == [2, 0, 1, 0, 3] and h[0] == h[2] == h[4] and len(set(h.tolist())) == 4
    up, _ = word_hashes([b"AbC d"], lower=True)
    low, _ = word_hashes([b"abc d"], lower=True)
    assert np.array_equal(up, low)


def check_factors(row, texts, window):
    """Factors cover the removed words, are long enough, equal their sources word for word and can't be extended there."""
    words = lambda i: re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
    own, covered = words(row.doc_id), set()
    for a, b, source, offset in row.factors:
        other = words(source)
        assert b - a >= window and own[a:b] == other[offset : offset + b - a]
        assert (source, offset) != (row.doc_id, a)
        covered |= set(range(a, b))
    assert len(covered) == row.n_removed and covered == {i for a, b in row.spans for i in range(a, b)}


def test_fingerprints_that_collide(spark):
    """With 6 bits counted nearly every block looks repeated; the second fingerprint leaves the results as they are."""
    from rulemill.llm.substring import substring_dedup

    rnd = random.Random(7)
    fresh = lambda n: [f"w{rnd.randint(0, 10**9)}" for _ in range(n)]
    shared = fresh(50)
    texts = [" ".join(fresh(rnd.randint(0, 90)) + (shared[rnd.randint(0, 9) :] if i % 4 == 0 else []) + fresh(rnd.randint(0, 60))) for i in range(40)]
    want = brute(texts, 35)
    d = docs(spark, texts)
    for bits in (6, 40):
        for r in substring_dedup(d, 35, bits=bits).collect():
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
            check_factors(r, texts, 35)


def test_repeated_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from rulemill.llm.substring import substring_dedup

    text = " ".join(f"v{i}" for i in range(40))
    d = docs(spark, [text, text, "short one"], ids=[5, 5, None]).withColumns({n: F.lit("x") for n in ("chunk", "range", "codes", "pos", "kind", "first")})
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(d).collect()) == [(0, 2, 0), (5, 40, 40), (5, 40, 40)]


def test_substring(spark):
    from rulemill.llm.substring import substring_dedup

    rnd = random.Random(1)
    fresh = lambda n: [f"w{rnd.randint(0, 10**9)}" for _ in range(n)]
    shared, long = fresh(35), fresh(60)
    texts = [*EDGE]
    texts += [" ".join(fresh(20) + shared + fresh(5)), "\n".join(shared), " ".join(fresh(3) + long[5:50] + fresh(9)), " ".join(long)]
    texts += [" ".join(long[:34]), " ".join(long[26:] + long[26:]), " ".join(fresh(100))] + ["same copy " * 30] * 20
    for window in (35, 3):
        want = brute(texts, window)
        for r in substring_dedup(docs(spark, texts), window, with_text=True).collect():
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], (r.doc_id, window)
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
            assert all(b - a >= window for a, b in r.spans)
            check_factors(r, texts, window)
    assert substring_dedup(docs(spark, [])).count() == 0
