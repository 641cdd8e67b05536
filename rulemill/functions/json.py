"""Rule records kept as JSON text: generated columns over both generations of the subject field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Generated columns and their paths.
GENERATED = {
    "obligation": "$.ir.obligation", "predicate": "$.ir.predicate", "constraint_type": "$.ir.constraint.type", "constraint_value": "$.ir.constraint.value",
    "assertion_subject": "$.ir.assertion_subject", "enforcement_phase": "$.ir.enforcement_phase", "rule_category": "$.ir.rule_category",
    "spec_family": "$.ir.spec_family", "verifiability": "$.ir.verifiability", "stage": "$.ir.stage", "non_lintable_reason": "$.ir.non_lintable_reason",
}


def subject(c: Column) -> Column:
    """``$.ir.subject.path``, or ``$.ir.subject`` where it is a plain string."""
    return F.coalesce(F.get_json_object(c, "$.ir.subject.path"), F.get_json_object(c, "$.ir.subject"))


def flag(c: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(c, path).try_cast("boolean"), F.lit(False))


def generated(rules: DataFrame, column: str = "ir_data") -> DataFrame:
    """The rule table with its generated columns; malformed JSON gives nulls."""
    c = F.col(column)
    return rules.withColumns({n: F.get_json_object(c, p) for n, p in GENERATED.items()} | {"subject": subject(c), "lintable": flag(c, "$.ir.lintable")})
