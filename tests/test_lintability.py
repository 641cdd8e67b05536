from rulemill.operators.lintability import coverage_candidates, gate, observable
from rulemill.plans import CERTIFICATE, compile_tree, validate
from rulemill.plans.derive import derive, guard
from rulemill.plans.tree import Node, serialise

SCHEMA = "id int, obligation string, assertion_subject string, subject string, predicate string, rule_category string, enforcement_phase string, text string"


def test_gate(spark):
    good = (1, "MUST", "Certificate", "extensions.keyUsage", "must_be_present", "encoding_constraint", "Encoding", "The extension MUST be present in the certificate.")
    rows = [good, (2, "MAY", *good[2:]), (3, *good[1:2], "CA", *good[3:]), (4, *good[1:3], "phone_contact.x", *good[4:]), (5, *good[1:5], "comparison", *good[6:]), (6, *good[1:6], "Validation", good[7])]
    rows += [(7, *good[1:7], "The CA MUST maintain a record of it."), (8, *good[1:5], None, None, good[7]), (9, None, None, None, None, None, None, None), (10, "SHOULD_NOT", *good[2:])]
    got = {r.id: (r.lintable, list(r.reasons)) for r in gate(spark.createDataFrame(rows, SCHEMA), [" must maintain .* record "]).collect()}
    assert got[1] == (True, []) and got[8] == (True, []) and got[10] == (True, [])
    assert [got[i][1] for i in range(2, 8)] == [["obligation"], ["assertion_subject"], ["subject"], ["category"], ["phase"], ["not_observable"]]
    assert got[9] == (False, ["obligation", "assertion_subject", "subject"])
    obs = {r.id: r.observable for r in observable(spark.createDataFrame([*rows, (11, *good[1:7], "a | MUST be present here"), (12, *good[1:7], "unique for each certificate")], SCHEMA), [" unique for "]).collect()}
    assert [i for i, v in obs.items() if v] == [1, 5, 6, 7, 8, 10]


def test_wording(spark):
    from pyspark.sql import functions as F

    from rulemill.operators.lintability import says

    wording = [" must .*keep ", " bakers? .*oven "]
    texts = ["The shop MUST always keep flour.", "Keep it; it must rise.", "The baker heats the oven!", "The baker sleeps. The oven is cold.", "Must\nkeep", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.no for r in rows.select("id", says(F.coalesce("text", F.lit("")), wording).alias("no")).collect()}
    assert [got[i] for i in range(6)] == [True, False, True, False, False, False]
    assert not any(r.no for r in rows.select(says(F.coalesce("text", F.lit("")), []).alias("no")).collect())


def test_candidates(spark):
    rules = spark.createDataFrame([(1, "RFC", "4.1.2"), (2, "RFC5280", "4.10"), (3, "CABF-BR", "7"), (4, "ETSI", "1"), (5, "RFC", None)], "id int, source string, section string")
    lints = spark.createDataFrame([("a", "RFC", "4.1"), ("b", "RFC", "4.1.2.5"), ("c", "CABF", "7.1"), ("d", "RFC", "4")], "lint_name string, source string, section string")
    got = {(r.rule_id, r.lint_name) for r in coverage_candidates(rules, lints).collect()}
    assert got == {(1, "a"), (1, "b"), (1, "d"), (2, "d"), (3, "a"), (3, "b"), (3, "c"), (3, "d")}


def test_derive():
    rule = lambda s, p, v=None, t=None, c=None: {"subject": s, "predicate": p, "constraint": {"value": v, "type": t}, "precondition": c}
    cases = [
        (rule({"path": "extensions.keyUsage"}, "must_be_critical"), {"op": "ExtCritical", "args": ["2.5.29.15"]}),
        (rule("extensions.nameConstraints", "must_not_be_present", c="if it is an end entity"), {"op": "When", "args": [{"op": "IsEndEntity", "args": []}, {"op": "Not", "args": [{"op": "ExtPresent", "args": ["2.5.29.30"]}]}]}),
        (rule("tbsCertificate.version", "equal", "3"), {"op": "FieldEq", "args": ["version", 3]}),
        (rule("subject.commonName", "must_include", 64, "length"), {"op": "FieldLenInRange", "args": ["subject.common_name", 0, 64]}),
        (rule("validity", "less_than", 398), {"op": "FieldNumericInRange", "args": ["validity_period", 0, 397]}),
        (rule("subject.countryName", "matches_pattern", "country_code"), {"op": "FieldMatchesRegex", "args": ["subject.country", "country_code"]}),
    ]
    for r, want in cases:
        node = derive(r)
        assert serialise(node) == want and validate(node, CERTIFICATE) == []
    assert derive(rule("phone", "equal", "1")) is None and derive(rule("version", "equal", "3", c="if the moon is full")) is None
    assert guard("for a subordinate CA certificate") == Node("IsCA") or guard("for a subordinate CA certificate").op in ("IsSubCA", "IsCA")


def test_derived_compiles(spark):
    compile_tree(derive({"subject": "validity", "predicate": "less_than", "constraint": {"value": 3}}), CERTIFICATE)
