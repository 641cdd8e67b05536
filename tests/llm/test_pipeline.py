import random
import re

import numpy as np
import public_tokenizers as P

from .test_langid import corpus as language_corpus
from .test_ngram_join import brute as brute_join
from .test_pii import brute as brute_pii
from .util import EDGE, docs


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    rnd = random.Random(11)
    texts, langs = language_corpus()
    texts += [" ".join(texts[i].split()[:-1]) for i in range(0, 200, 4)] + [texts[i].upper() for i in range(1, 200, 9)]
    texts += [f"{texts[i]} mail a{i}@b.org or +1 (604) 555-80{i:02d}" for i in range(10, 40)]
    langs += [None] * (len(texts) - len(langs))
    texts, langs = texts + EDGE, langs + ["en"] * len(EDGE)
    ids = rnd.sample(range(10**6), len(texts))
    docs(spark, texts, langs, ids).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = p.run(spark, str(tmp_path)).collect()

    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    kept = {i: t for i, t in zip(ids, texts) if t and any(c.isalpha() for c in t)}
    got = {r.doc_id for r in p.language(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").collect()}
    assert got <= kept.keys() and len(kept) - len(got) <= 4
    kept = {i: kept[i] for i in kept if i in got}
    last = {}
    for i in sorted(kept):
        last[low(kept[i])] = i
    kept = {i: kept[i] for i in last.values()}
    groups = brute_join(list(kept.values()), 5, 80, list(kept))
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    kinds = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for i, t in kept.items():
        out, at = "", 0
        for s, k, e in brute_pii(t):
            if s >= at:
                out += t[at:s] + kinds[k]
            at = max(at, e)
        want[i] = len(tok.encode(out + t[at:], add_special_tokens=False).ids) + 1
    seen = {}
    for r in pieces:
        assert r.doc_tokens == want[r.doc_id]
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == want
    _ = np


def test_clashing_columns(spark):
    """Extra columns keep their values, whatever names the stages use within."""
    from pyspark.sql import functions as F

    import corpus_pipeline as p

    names = ["uid", "digest", "_own", "_id", "_digest", "row", "_t", "base", "added", "_all", "score", "rejected", "lang_pred", "chunk", "sig", "rank", "rem", "salt", "kept", "component_id"]
    d = docs(spark, ["the cat and a dog mail me@x.org", "the cat and a dog mail me@x.org", None, "another text of the corpus"], ["en"] * 4)
    d = d.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for _, stage in p.STAGES[:-1]:
        d = stage(spark, d, "")
    rows = d.collect()
    assert {r.doc_id: r.text for r in rows} == {1: "the cat and a dog mail [EMAIL]", 3: "another text of the corpus"}
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert {r.doc_id for r in p.pack(spark, d, "").collect()} == {1, 3}


def test_stages_on_empty(spark):
    import corpus_pipeline as p

    d = docs(spark, [])
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns and out.count() == 0
    assert [n for n, _ in p.STAGES] and p.STAGES[-1][1](spark, d, "").count() == 0
