import itertools

from pyspark.sql import functions as F

from rulemill.operators import audit
from rulemill.operators.audit import Raw
from rulemill.plans import Lint, Vocabulary, parse
from rulemill.plans.vocabulary import Field, col

FIELDS = {"name": Raw("name"), "policies": Raw("policies", "list", "policies_critical"), "size": Raw("size", "number"), "ca": Raw("ca", "flag"), "alt_name": Raw("name")}
ROWS = [(i, *r) for i, r in enumerate(itertools.product([None, "", "Any-Policy", "x"], [None, [], ["any.policy"], ["a", "A", "a"]], [None, True, False], [None, 0, 5], [None, True, False]))]
SCHEMA = "id int, name string, policies array<string>, policies_critical boolean, size int, ca boolean"


def brute(name, r):
    _, text, policies, critical, size, ca = r
    plain = lambda s: (s or "").lower().translate(str.maketrans("_-.", "   "))
    return {
        "e_name_absent": bool(text), "name_present": not text, "e_policies_absent": bool(policies), "w_ca_policies_present": bool(ca) and not policies, "e_policies_critical": bool(policies) and not critical,
        "e_policies_not_critical": bool(policies) and bool(critical), "e_policies_unique": bool(policies) and len(set(policies)) < len(policies), "e_name_is_any_policy": plain(text) != "any policy",
        "e_name_is_not_x": plain(text) == "x", "e_policies_contains_a": "a" not in [plain(p) for p in policies or []], "n_leaf_policies_not_contains_any_policy": ca is False and "any policy" in [plain(p) for p in policies or []],
        "e_name_contains_policy": "policy" not in plain(text), "e_size_at_least_3": (size or 0) < 3, "e_policies_at_most_2": len(policies or []) > 2, "e_alt_name_at_most_3": len(text or "") > 3, "e_ca_present": not ca, "e_size_present": size is None,
    }.get(name)


def test_claims(spark):
    scopes = {"ca": F.col("ca"), "leaf": ~F.col("ca")}
    names = "e_name_absent name_present e_policies_absent w_ca_policies_present e_policies_critical e_policies_not_critical e_policies_unique e_name_is_any_policy e_name_is_not_x e_policies_contains_a n_leaf_policies_not_contains_any_policy e_name_contains_policy e_size_at_least_3 e_policies_at_most_2 e_alt_name_at_most_3 e_ca_present e_size_present".split()
    d = spark.createDataFrame(ROWS, SCHEMA)
    got = d.select("id", *[audit.claimed_defect(n, FIELDS, scopes).alias(n) for n in names]).collect()
    for r in got:
        for n in names:
            assert r[n] == brute(n, ROWS[r.id]), (n, ROWS[r.id])
    for n in ("e_name_in_order", "e_other_absent", "e_name_critical", "e_name_unique", "e_policies_is_x", "", "e_", "absent"):
        assert audit.claimed_defect(n, FIELDS, scopes) is None


def test_verdicts(spark):
    v = Vocabulary({"name": col("name", "string"), "size": Field("int", lambda: F.coalesce("size", F.lit(0)))}, {})
    lints = [Lint("e_name_present", parse({"op": "FieldNonEmpty", "args": ["name"]})), Lint("e_size_at_least_3", parse({"op": "FieldNumericInRange", "args": ["size", 1, 9]})), Lint("e_odd", parse({"op": "FieldNonEmpty", "args": ["name"]}))]
    d = spark.createDataFrame([(1, "a", 5), (2, "", 2), (3, None, 0)], "id int, name string, size int")
    rows = audit.audited(d, "id", lints, v, FIELDS)
    want = {(2, "e_name_present", "CONFIRMED"), (3, "e_name_present", "CONFIRMED"), (2, "e_size_at_least_3", "MISSED"), (3, "e_size_at_least_3", "CONFIRMED"), (2, "e_odd", "NOCHECK"), (3, "e_odd", "NOCHECK")}
    assert {(r.id, r.lint, r.verdict) for r in rows.collect()} == want
    found = spark.createDataFrame([(1, "e_name_present"), (2, "e_name_present"), (2, "e_name_present"), (3, "e_odd")], "id int, lint string")
    got = {tuple(r) for r in audit.audited_findings(found, d, "id", [x.name for x in lints], FIELDS).collect()}
    assert got == {(1, "e_name_present", "REFUTED"), (2, "e_name_present", "CONFIRMED"), (3, "e_name_present", "MISSED"), (2, "e_size_at_least_3", "MISSED"), (3, "e_size_at_least_3", "MISSED"), (3, "e_odd", "NOCHECK")}
    table = {r.lint: (r.confirmed, r.refuted, r.nocheck, r.missed, r.precision) for r in audit.audit_table(rows).collect()}
    assert table == {"e_name_present": (2, 0, 0, 0, 1.0), "e_size_at_least_3": (1, 0, 0, 1, 1.0), "e_odd": (0, 0, 2, 0, None)}
