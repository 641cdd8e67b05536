import math
import random

from pyspark.sql import functions as F

from rulemill.operators import knowledge as k


def test_wording(spark):
    wording = {"limit": r"\bno longer than\b", "likeness": r"\bsame as\b", "leave": r"\bfree to\b"}
    rows = [(1, "The rope is no longer than a day."), (2, "It MUST be no longer than a day."), (3, "It is the same as that, free to go."), (4, None), (5, "Plain prose.")]
    got = {r.id: r.kinds for r in spark.createDataFrame(rows, "id int, text string").select("id", k.binding_kinds(F.col("text"), wording).alias("kinds")).collect()}
    assert got == {1: ["limit"], 2: [], 3: ["likeness", "leave"], 4: [], 5: []}


def test_conditions(spark):
    rows = [
        (1, "If the certificate is a CA, and when the validity exceeds 398 days"), (2, "Unless subjectAltName is present"), (3, "If cA=TRUE then"), (4, "A CA is here"), (5, None),
        (6, "It holds when the key size is at least 2048 and the curve is not P-192; else not."), (7, "Unless the list contains a name and its length is less than 3."), (8, "when nothing happens, if policy is absent."),
    ]
    got = {r.id: [(c.field, c.operator, c.value) for c in r.c or []] for r in spark.createDataFrame(rows, "id int, text string").select("id", k.conditions_of(F.col("text")).alias("c")).collect()}
    assert got == {
        1: [("certificate", "==", "a ca"), ("validity", ">", "398 days")], 2: [("subjectaltname", "ABSENT", None)], 3: [("ca", "==", "true then")], 4: [], 5: [],
        6: [("key size", ">=", "2048"), ("curve", "!=", "p-192")], 7: [("list", "LACKS", "a name"), ("length", ">=", "3")], 8: [("policy", "ABSENT", None)],
    }


def test_lists(spark):
    text = "All of these\nhold:\n - first\n - second one\n 3. third"
    rows = spark.createDataFrame([(1, text), (2, "no list - here"), (3, None)], "id int, text string")
    assert [tuple(r) for r in k.list_items(rows, ["id"]).orderBy("item_number").collect()] == [(1, "All of these hold:", i, x) for i, x in enumerate(["first", "second one", "third"])]


def test_definitions_and_cross_references(spark):
    d = spark.createDataFrame([(1, "Subject", "rfc", 1, "a"), (2, "subject", "br", 2, "b"), (3, "subject", "br", 2, "c")], "id int, term string, source string, priority int, text string")
    a = spark.createDataFrame([("Holder", "subject")], "alias string, term string")
    got = {tuple(r) for r in k.definition_lookup(spark.createDataFrame([("holder",), ("SUBJECT",), ("none",)], "term string"), d, a).collect()}
    assert got == {("holder", 2, "br", "b"), ("SUBJECT", 2, "br", "b")}
    s = spark.createDataFrame([("1", "The key usage extension."), ("2", "Key usages differ."), ("3", "See key  usage; and CRL.")], "id string, text string")
    t = spark.createDataFrame([("Key usage", "1"), ("CRL", "2"), ("", "3")], "term string, section string")
    assert {tuple(r) for r in k.cross_references(s, t).collect()} == {("3", "1"), ("3", "2")}


def test_group_similarity(spark):
    rnd = random.Random(1)
    rows = [(i, i % 3, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(20)] + [(99, 7, [1.0] * 8)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    got = {r.g: (r.n, r.mean_similarity) for r in k.group_similarity(spark.createDataFrame(rows, "id int, g int, v array<double>"), "g", "v").collect()}
    for g in (0, 1, 2):
        v = [r[2] for r in rows if r[1] == g]
        all_pairs = [cos(a, b) for i, a in enumerate(v) for b in v[:i]]
        assert got[g][0] == len(v) and abs(got[g][1] - sum(all_pairs) / len(all_pairs)) < 1e-9
    assert got[7] == (1, None)


def test_rates(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", False)], "k string, ok boolean")
    assert {tuple(r) for r in k.consistency(rows, ["k"], "ok").collect()} == {("a", 2, 0.5), ("b", 1, 0.0)}
    rows = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("a", "")], "a string, b string")
    assert [round(r[0], 6) for r in rows.select(k.edit_similarity(F.col("a"), F.col("b"))).collect()] == [round(1 - 3 / 7, 6), 1.0, 0.0]
