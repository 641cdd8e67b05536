"""Independent audit of findings: does a record really show what a lint says of it?

A lint is a tree of atoms, so a fault of the tree (a precondition that was dropped, an atom that was chosen wrongly) can't be
seen by evaluating the tree again. The audit knows nothing of trees: it reads the claim from the lint's name, looks at raw
columns of the record, and answers for each finding CONFIRMED (the defect is there), REFUTED (it isn't, or the record is
out of the name's scope) or NOCHECK (the name makes no claim that it can look up). Silent lints are held against it too.

Names: ``[e_|w_|n_][<scope>_]<field>_<claim>``; the claims are

    absent, present                      the field's presence
    critical, not_critical               its flag
    is_<value>, is_not_<value>           its text, case ignored
    contains_<value>, not_contains_<value>   an element of a list, a part of a text, case ignored
    at_least_<n>, at_most_<n>            a number, the length of a list or text
    unique                               no element of a list twice
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lint import NON_PASS, Lint, lint_column
from ..plans.vocabulary import Vocabulary

CLAIM = re.compile(r"_(?:(absent|present|critical|not_critical|unique)|(is_not|is|not_contains|contains)_(.+)|(at_least|at_most)_(\d+))$")
PREFIX = re.compile(r"^[ewn]_")


@dataclass(frozen=True)
class Raw:
    """Where a field stands in a raw record: a column, its kind (text, list, number, flag) and, where there is one, its flag of
    criticality."""

    column: str
    kind: str = "text"
    critical: str | None = None


def _present(f: Raw) -> Column:
    c = F.col(f.column)
    if f.kind == "text":
        return F.coalesce(c != "", F.lit(False))
    if f.kind == "list":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(c, F.lit(False)) if f.kind == "flag" else c.isNotNull()


def _holds(f: Raw, value: str) -> Column:
    value = value.replace("_", " ").lower()
    plain = lambda c: F.translate(F.lower(c), "_-.", "   ")
    c = F.col(f.column)
    if f.kind == "list":
        return F.coalesce(F.exists(c, lambda x: plain(x) == value), F.lit(False))
    return F.coalesce(F.contains(plain(c.cast("string")), F.lit(value)), F.lit(False))


def _size(f: Raw) -> Column:
    c = F.col(f.column)
    return F.coalesce({"list": lambda: F.when(c.isNotNull(), F.size(c)), "text": lambda: F.length(c), "number": lambda: c, "flag": lambda: c.cast("int")}[f.kind](), F.lit(0))


def claimed_defect(name: str, fields: dict[str, Raw], scopes: dict[str, Column] | None = None) -> Column | None:
    """Whether a record breaks what a lint's name claims; None for a name that claims nothing that ``fields`` know."""
    plain = PREFIX.sub("", name)
    found = CLAIM.search("_" + plain) if plain else None
    if not found:
        return None
    head = plain[: max(found.start() - 1, 0)]
    scope = next((s for s in sorted(scopes or {}, key=len, reverse=True) if head.startswith(s + "_")), None)
    f = fields.get(head[len(scope) + 1 :] if scope else head)
    if f is None:
        return None
    state, compared, value, bound, n = found.groups()
    if state in ("critical", "not_critical"):
        if f.critical is None:
            return None
        flag = F.coalesce(F.col(f.critical), F.lit(False))
        broken = _present(f) & (flag if state == "not_critical" else ~flag)
    elif state == "unique":
        if f.kind != "list":
            return None
        broken = F.coalesce(F.size(F.array_distinct(f.column)) < F.size(f.column), F.lit(False))
    elif state:
        broken = _present(f) if state == "absent" else ~_present(f)
    elif compared in ("contains", "not_contains"):
        broken = _holds(f, value) if compared == "not_contains" else ~_holds(f, value)
    elif compared:
        if f.kind == "list":
            return None
        same = F.coalesce(F.translate(F.lower(F.col(f.column).cast("string")), "_-.", "   ") == value.replace("_", " ").lower(), F.lit(False))
        broken = same if compared == "is_not" else ~same
    else:
        broken = _size(f) < int(n) if bound == "at_least" else _size(f) > int(n)
    return broken & F.coalesce(scopes[scope], F.lit(False)) if scope else broken


def verdict_of(fires: Column, defect: Column | None) -> Column:
    """For one lint and record; null where there is neither a finding nor a defect."""
    if defect is None:
        return F.when(fires, "NOCHECK")
    return F.when(fires & defect, "CONFIRMED").when(fires, "REFUTED").when(defect, "MISSED")


def audited(records: DataFrame, key: str, lints: list[Lint], vocabulary: Vocabulary, fields: dict[str, Raw], scopes: dict[str, Column] | None = None) -> DataFrame:
    """(key, lint, status, verdict): findings with their verdicts, and MISSED where a claim is broken but its lint is silent. Both
    evaluators run in one projection over one scan; nothing is joined."""
    rows = []
    for x in lints:
        status = lint_column(x, vocabulary)
        rows.append(F.struct(F.lit(x.name).alias("lint"), status.alias("status"), verdict_of(status.isin(*NON_PASS, "info"), claimed_defect(x.name, fields, scopes)).alias("verdict")))
    return records.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*").where("verdict is not null")


def audited_findings(findings: DataFrame, records: DataFrame, key: str, names: list[str], fields: dict[str, Raw], scopes: dict[str, Column] | None = None) -> DataFrame:
    """The same for findings (key, lint) that were stored: (key, lint, verdict). Claims are looked up once a record; only those
    of broken records meet the findings."""
    claims = [(n, claimed_defect(n, fields, scopes)) for n in names]
    known = [n for n, c in claims if c is not None]
    broken = F.array_compact(F.array(*[F.when(c, n) for n, c in claims if c is not None])) if known else F.array().cast("array<string>")
    there = records.select(key, F.explode(broken).alias("lint"), F.lit(True).alias("there"))
    both = findings.select(key, "lint", F.lit(True).alias("found")).distinct().join(there.distinct(), [key, "lint"], "full")
    verdict = F.when(F.col("found") & F.col("there"), "CONFIRMED").when(F.col("there"), "MISSED").when(F.col("lint").isin(*known), "REFUTED").otherwise("NOCHECK")
    return both.select(key, "lint", verdict.alias("verdict"))


def audit_table(verdicts: DataFrame) -> DataFrame:
    """Per lint: how many of each verdict, and the share of findings looked up that are confirmed."""
    names = ["CONFIRMED", "REFUTED", "NOCHECK", "MISSED"]
    out = verdicts.groupBy("lint").agg(*[F.count_if(F.col("verdict") == n).alias(n.lower()) for n in names])
    looked = F.col("confirmed") + F.col("refuted")
    return out.withColumn("precision", F.when(looked > 0, F.col("confirmed") / looked))
