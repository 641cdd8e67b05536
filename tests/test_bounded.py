"""Steps that must not be done again in each round, or meet on a word that many share."""

import random

from rulemill.operators import documents, graph, knowledge


def test_terms_of_one_first_word(spark):
    """20,000 terms and sections that all begin with one word: by that word 400 million candidates."""
    from pyspark.sql import functions as F

    term = F.concat(F.lit("Key "), F.col("id").cast("string"))
    d = spark.range(20_000)
    got = knowledge.cross_references(d.select("id", F.concat(F.lit("key; "), (F.col("id") + 1).cast("string"), F.lit(" key")).alias("text")), d.select(term.alias("term"), F.col("id").alias("section")))
    assert got.count() == 19_999 and got.where("dst = src + 1").count() == 19_999
    plain = F.concat(F.lit("a key-"), F.col("id").cast("string"))
    assert knowledge.cross_references(d.select("id", plain.alias("text")), d.limit(0).select(term.alias("term"), F.col("id").alias("section"))).count() == 0


def test_closed_writes_each_chain_once(spark, monkeypatch):
    rows = []
    real = documents.cut

    def counted(df):
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(documents, "cut", counted)
    got = documents.closed(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)], "src int, dst int"))
    assert got.count() == sum(rows) == 40 * 41 // 2 + 9
    assert {(r.src, r.dst): r.steps for r in got.collect() if r.src < 100} == {(a, b): b - a for a in range(40) for b in range(a + 1, 41)}


def test_walks_take_repeated_edges(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(30), rnd.randrange(30), rnd.choice("xy")) for _ in range(80)]
    once, often = (spark.createDataFrame(e, "src int, dst int, relation string") for e in (sorted(set(edges)), edges * 3))
    nodes = spark.createDataFrame([(n,) for n in range(28)] * 2, "node int")
    a, b = (graph.budgeted(nodes, e, [1], 3, 15) for e in (once, often))
    assert sorted(a[0].collect()) == sorted(b[0].collect()) and sorted(a[1].collect()) == sorted(b[1].collect())
    assert [r.path for r in graph.shortest_path(once, 1, 5, 6).collect()] == [r.path for r in graph.shortest_path(often, 1, 5, 6).collect()]
