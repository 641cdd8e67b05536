import random
import zlib

from .util import EDGE, docs

#: Function words for the made texts.
WORDS = {"en": "the of and to in is that for was with this from which".split(), "de": "der die und den von zu das mit sich auf für ist nicht".split(), "fr": "le la les et des un une du est dans que pour qui".split()}


def corpus():
    rnd = random.Random(9)
    texts, langs = [], []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        made = WORDS[lang] + [w[::-1] + w for w in WORDS[lang]]
        texts.append(" ".join(rnd.choices(made, k=rnd.randint(5, 80))))
        langs.append(None if i % 50 == 7 else lang)
    return texts, langs


def test_language_id(spark):
    from rulemill.llm.langid import language_id

    texts, langs = corpus()
    odd = [*EDGE, "1234 !!", "\U0001f600"]
    got = {r.doc_id: r for r in language_id(docs(spark, texts + odd, langs + ["en"] * len(odd))).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i].lang_pred == ["en", "de", "fr"][i % 3] for i in held) >= 0.98 * len(held)
    assert sum(got[i].rejected for i in range(len(texts))) <= 3
    for k, t in enumerate(odd, len(texts)):
        letters = any(c.isalpha() for c in t or "")
        assert (got[k].lang_pred == "und") == (not letters) and 0 <= got[k].score <= 1


def test_nothing_to_learn(spark):
    from rulemill.llm.langid import language_id

    assert language_id(docs(spark, [])).count() == 0
    assert [r.lang_pred for r in language_id(docs(spark, ["a b"], [None])).collect()] == ["und"]


def test_counts():
    import numpy as np

    from rulemill.llm.langid import counts_of, spherical_kmeans

    a, n = counts_of(["ab, Ab", "", "ab ab", "12"])
    assert np.array_equal(a[0], a[2]) and n.tolist() == [4, 0, 4, 0] and a[0].sum() == 7 + 6 + 5
    x = np.eye(4, dtype=np.float32)[[0, 0, 1, 1, 2]]
    assert sorted(spherical_kmeans(x, 3).argmax(axis=1).tolist()) == [0, 1, 2]


def test_rejection(spark):
    from rulemill.llm.langid import fit, predict

    rnd = random.Random(3)
    texts, langs = corpus()
    for i in range(120):
        lang = ["en", "de", "fr"][i % 3]
        texts.append(" ".join(rnd.choices(WORDS[lang] + [w[::-1] + w for w in WORDS[lang]], k=rnd.randint(100, 600))))
        langs.append(lang)
    model = fit(docs(spark, texts, langs))
    clean = [" ".join(rnd.choices(WORDS[lang], k=k)) for lang in WORDS for k in (3, 6, 12, 25, 50, 400, 5000) for _ in range(20)]
    assert sum(r for _, _, r in predict(clean, model)) <= 0.02 * len(clean)
    finnish = "suomessa on tuhansia järviä ja metsät peittävät suuren osan maasta joten ihmiset viihtyvät luonnossa kesällä talvella".split()
    turkish = "türkiyenin kalabalık şehri olan tarihi boyunca birçok uygarlığa sahipliği yapmıştır bugün hava çok güzel olduğu için çocuklar".split()
    for n in (140, 500, 2000, 30000):
        other = [" ".join(rnd.choices(w, k=n // 4))[:n] for w in (finnish, turkish) for _ in range(10)]
        other += ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=n)) for _ in range(10)]
        assert all(r for _, _, r in predict(other, model)), n


def test_bounds():
    import numpy as np

    from rulemill.llm.langid import LENGTHS, MARGIN, bounds

    b = bounds({3: [0.2] * 100, 7: [0.4] * 100, 9: [0.8] * 3})
    assert len(b) == LENGTHS and np.allclose(b[:7], 0.2 * MARGIN) and np.allclose(b[7:], b[7]) and b[7] >= 0.4 * MARGIN
    assert np.isnan(bounds({})).all() and np.isfinite(bounds({5: [0.5]})).all()


def test_sample_is_a_bound(spark):
    """Rows without doc_id, repeated rows and copies do not raise the number of rows drawn."""
    from pyspark.sql import functions as F

    from rulemill.llm.langid import drawn

    made = docs(spark, [f"text {i}" for i in range(300)] + ["a copy"] * 200 + ["few"] * 7, ["en"] * 300 + ["de"] * 200 + ["fr"] * 7)
    lost = made.withColumn("doc_id", F.lit(None).cast("long"))
    for rows in (made, lost, made.union(made), made.limit(0)):
        for bounded in (False, True):
            got = {r.lang: r["count"] for r in drawn(rows.select("doc_id", "text", "lang"), 50, bounded).groupBy("lang").count().collect()}
            n = rows.count()
            assert got == ({"en": 50, "de": 50, "fr": min(50, 7 * (n // 507))} if n else {})
    assert drawn(made, 50).where("lang = 'en'").distinct().count() == 50
