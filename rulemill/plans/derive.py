"""Rule record -> predicate tree, for the rules that a table can decide; None where it can't."""

from __future__ import annotations

from .tree import INF, Node, vacuous_when

#: Extensions by the last segment of a subject, and the field that holds their content.
EXTENSIONS = {
    "authoritykeyidentifier": ("2.5.29.35", "aki"), "subjectkeyidentifier": ("2.5.29.14", "ski"), "keyusage": ("2.5.29.15", "key_usage"), "certificatepolicies": ("2.5.29.32", "policy_oids"),
    "policymappings": ("2.5.29.33", None), "subjectaltname": ("2.5.29.17", "dns_names"), "issueraltname": ("2.5.29.18", None), "subjectdirectoryattributes": ("2.5.29.9", None),
    "basicconstraints": ("2.5.29.19", None), "nameconstraints": ("2.5.29.30", None), "policyconstraints": ("2.5.29.36", None), "extkeyusage": ("2.5.29.37", "ext_key_usage"),
    "crldistributionpoints": ("2.5.29.31", None), "inhibitanypolicy": ("2.5.29.54", None), "freshestcrl": ("2.5.29.46", None), "authorityinfoaccess": ("1.3.6.1.5.5.7.1.1", None), "subjectinfoaccess": ("1.3.6.1.5.5.7.1.11", None),
}
#: Plain fields by the last segment of a subject.
FIELDS = {
    "version": "version", "serialnumber": "serial", "commonname": "subject.common_name", "countryname": "subject.country", "organizationname": "subject.organization",
    "localityname": "subject.locality", "stateorprovincename": "subject.province", "dnsname": "dns_names", "ipaddress": "ip_addresses", "rfc822name": "emails", "uniformresourceidentifier": "uris",
    "modulus": "rsa_bits", "validity": "validity_period", "emailaddress": "subject.email_address", "domaincomponent": "subject.domain_component",
}
#: Wording of a precondition and the test that it means.
GUARDS = (
    ("is a ca", Node("IsCA")), ("ca certificate", Node("IsCA")), ("subordinate ca", Node("IsSubCA")), ("root ca", Node("IsRootCA")), ("end entity", Node("IsEndEntity")),
    ("subscriber", Node("IsSubscriberCert")), ("subject field is empty", Node("DNEmpty", ("subject",))), ("subject is an empty", Node("DNEmpty", ("subject",))),
)
NEGATED = ("MUST NOT", "SHALL NOT", "SHOULD NOT", "NOT RECOMMENDED")


def guard(text: str | None) -> Node | None:
    """The first guard that a precondition's wording names; the longest wording wins."""
    low = (text or "").lower()
    found = [(len(words), i) for i, (words, _) in enumerate(GUARDS) if words in low]
    return GUARDS[max(found)[1]][1] if found else None


def _number(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def main_test(rule: dict) -> Node | None:
    path = rule.get("subject") or ""
    path = path.get("path", "") if isinstance(path, dict) else path
    name = path.split(".")[-1].lower().replace("_", "")
    predicate, constraint = (rule.get("predicate") or "").lower(), rule.get("constraint") or {}
    value = constraint.get("value")
    ext, field = EXTENSIONS.get(name), FIELDS.get(name)
    n = _number(value)
    if predicate in ("must_be_present", "must_include") and value in (None, ""):
        return Node("ExtPresent", (ext[0],)) if ext else Node("FieldNonEmpty", (field,)) if field else None
    if predicate in ("must_not_be_present", "must_not_include") and value in (None, ""):
        return Node("Not", (Node("ExtPresent", (ext[0],)),)) if ext else Node("FieldEmpty", (field,)) if field else None
    if predicate in ("must_be_critical", "must_not_be_critical") and ext:
        return Node("ExtCritical" if predicate == "must_be_critical" else "ExtNotCritical", (ext[0],))
    if field is None:
        return None
    if predicate in ("equal", "must_equal") and value is not None:
        return Node("FieldEq", (field, n if n is not None else value))
    if predicate == "not_equal" and value is not None:
        return Node("Not", (Node("FieldEq", (field, n if n is not None else value)),))
    if predicate in ("allowed_values", "forbidden_values") and isinstance(value, list):
        return Node("FieldInSet" if predicate == "allowed_values" else "FieldNotInSet", (field, tuple(value)))
    if constraint.get("type") == "length" and n is not None:
        return Node("FieldLenInRange", (field, 0, n))
    if n is not None and predicate in ("less_than", "less_than_or_equal", "greater_than", "greater_than_or_equal"):
        low, high = {"less_than": (0, n - 1), "less_than_or_equal": (0, n), "greater_than": (n + 1, INF), "greater_than_or_equal": (n, INF)}[predicate]
        return Node("FieldNumericInRange", (field, low, high))
    if predicate == "in_range" and isinstance(value, list) and len(value) == 2:
        return Node("FieldNumericInRange", (field, int(value[0]), int(value[1])))
    if predicate == "matches_pattern" and isinstance(value, str):
        return Node("FieldMatchesRegex", (field, value))
    if predicate == "encode_as" and value:
        return Node("FieldEncodedAs", (field, tuple(value) if isinstance(value, list) else (value,)))
    return None


def derive(rule: dict) -> Node | None:
    """The tree of a rule record, its condition folded in with When. A condition that isn't understood, or one that makes
    the rule say nothing, gives None."""
    main = main_test(rule)
    condition = rule.get("precondition")
    if main is None or not condition:
        return main
    g = guard(condition)
    if g is None:
        return None
    tree = Node("When", (g, main))
    return None if vacuous_when(tree) else tree
