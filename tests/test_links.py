"""Best links and matches against all pairs, with many equal rows, that must not meet one by one."""

import random

from rulemill.operators import reasoning


def test_scored_links_equal_all_pairs(spark):
    rnd = random.Random(4)
    subject = lambda: rnd.choice([None, "", ".x", "a", "a.b", "a.b.c", "a.b.", "a.bc", "b", "b.c"])
    side = lambda n: [(i, subject(), rnd.choice([None, "p", "q"]), rnd.choice([None, "m", "n"]), rnd.choice([None, "1", "2", "3"])) for i in range(n)]
    rules, lints = side(150), side(12)
    points = lambda x, y, v: v if x is not None and x == y else 0.0

    def score(a, b):
        if a[1] is None or b[1] is None or a[1].split(".")[0] != b[1].split(".")[0]:
            return None
        s = 0.5 if a[1] == b[1] else 0.3 if a[1].startswith(b[1] + ".") or b[1].startswith(a[1] + ".") else 0.0
        return s + points(a[2], b[2], 0.4) + points(a[3], b[3], 0.3) + points(a[4], b[4], 0.3)

    for least in (0.3, 0.0, 0.8, 2.0):
        want = {}
        for a in rules:
            found = [(-s, b[0], s) for b in lints if (s := score(a, b)) is not None and s >= least]
            if found:
                want[a[0]] = min(found)[1:]
        frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, subject string, predicate string, obligation string, constraint_value string")
        got = reasoning.scored_links(frame(rules, "id"), frame(lints, "lint_name"), least)
        assert {r.rule_id: (r.lint_name, r.score) for r in got.collect()} == want


def test_equal_rules_do_not_multiply(spark):
    """400,000 rules of one root: by pairs 160 thousand million."""
    from pyspark.sql import functions as F

    d = spark.range(400_000).select("id", F.lit("a.b").alias("subject"), F.lit("p").alias("predicate"), (F.col("id") % 3).cast("string").alias("obligation"), F.lit(None).cast("string").alias("constraint_value"))
    got = reasoning.scored_links(d, d.withColumnRenamed("id", "lint_name"))
    assert got.where("lint_name = rule_id % 3").count() == got.count() == 400_000


def test_nearest_matches_equal_all_pairs(spark):
    from pyspark.sql import functions as F

    from rulemill.operators import retrieval

    rnd = random.Random(6)
    amount = lambda: rnd.choice([None, float("nan"), float("inf"), 1e16, -0.0, 0.0, 0.0001, 0.0002, 0.00049, round(rnd.uniform(-20, 20), 2), round(rnd.uniform(-20, 20), 5), 20000.0])
    left = [(i, amount(), rnd.choice([1, 2, 3])) for i in range(120)]
    right = [(i, amount(), rnd.choice([1, 2]), rnd.choice([True, False, None])) for i in rnd.sample(range(1000), 400)]

    def score(own, other):
        return F.round(1 - 0.3 * F.least(F.abs(own - other) / 10000.0, F.lit(1.0)), 8)

    l, r = spark.createDataFrame(left, "id long, value double, nation int"), spark.createDataFrame(right, "id long, value double, nation int, owes boolean")
    got = retrieval.nearest_matches(l, r, "value", ["nation", "owes"], 3, score, 0.001)
    got = {(x.id, x.owes, x.other, x.score) for x in got.collect()}
    pairs = l.select(F.col("id").alias("a"), F.col("value").alias("v"), "nation").join(r, "nation").select("a", "owes", "id", score(F.col("v"), F.col("value")).alias("s")).collect()
    want = set()
    for a, owes in {(p.a, p.owes) for p in pairs}:
        want |= {(a, owes, i, -s) for s, i in sorted((-p.s, p.id) for p in pairs if (p.a, p.owes) == (a, owes))[:3]}
    assert got == want and len(want) > 500


def test_equal_balances_do_not_multiply(spark):
    """300,000 customers and 3,000 suppliers of one nation and balance: by pairs 900 million."""
    from pyspark.sql import functions as F

    from rulemill.operators import retrieval

    right = spark.range(300_000).select("id", F.lit(1.0).alias("value"), F.lit(1).alias("nation"))
    left = spark.range(3_000).select("id", (F.col("id") % 7).cast("double").alias("value"), F.lit(1).alias("nation"))
    got = retrieval.nearest_matches(left, right, "value", ["nation"], 3, lambda own, other: -F.abs(own - other), 0.001)
    assert got.count() == 9_000 and got.where("other < 3").count() == 9_000
