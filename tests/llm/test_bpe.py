import hashlib
import random

import public_tokenizers as P
import pytest

from .util import EDGE, docs

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    import tiktoken

    from rulemill.llm.bpe import load_ranks

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def odd_texts():
    rnd = random.Random(7)
    alphabet = ["'", "s", "t", "re", "ll", "ve", "d", " ", "  ", "\n", "\t", " ", "　", "é", "1", "²", "٣", "!", "..", "A", "漢", "\U0001f600", "́", "​", "\x85", "x", "<|endoftext|>"]
    return ["".join(rnd.choices(alphabet, k=rnd.randint(0, 40))) for _ in range(3000)]


def test_small_cache(theirs, monkeypatch):
    from rulemill.llm import bpe

    monkeypatch.setattr(bpe, "CACHED", 40)
    monkeypatch.setattr(bpe, "CHUNK", 64)
    bpe.own_codec.cache_clear()
    for t, (ids, decimal, _, _) in zip(odd_texts(), bpe.encode_texts(odd_texts(), PATH), strict=True):
        assert ids.tolist() == theirs.encode_ordinary(t) and " ".join(decimal) == " ".join(map(str, ids.tolist()))
    bpe.own_codec.cache_clear()


def test_against_library(theirs):
    from rulemill.llm.bpe import encode_texts, own_codec

    texts = [t or "" for t in EDGE] + odd_texts() + ["ab" * 3000, "\n" * 2000 + "x", "'" * 500, "zq" * 40 + "é" * 100]
    decode = own_codec(PATH)[1].decode
    for t, (ids, decimal, starts, counts) in zip(texts, encode_texts(texts, PATH), strict=True):
        assert ids.tolist() == theirs.encode_ordinary(t), repr(t)
        assert " ".join(decimal) == " ".join(map(str, ids.tolist()))
        assert decode(ids) == t.encode() and sum(counts) == len(ids)
        at = 0
        for a, b, n in zip(starts, [*starts[1:], len(t)], counts.tolist()):
            assert decode(ids[at : at + n]) == t[a:b].encode()
            at += n


def test_query_digests(spark, theirs):
    from rulemill.llm.bpe import decode_documents, digests, encode_documents

    texts = EDGE + odd_texts()[:50]
    for r in digests(docs(spark, texts), PATH).collect():
        ids = theirs.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = decode_documents(encode_documents(docs(spark, texts), PATH), PATH).collect()
    assert all(bytes(r.bytes) == (texts[r.doc_id] or "").encode() for r in back)
    assert digests(docs(spark, []), PATH).count() == 0
