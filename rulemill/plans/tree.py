"""Predicate trees: parsing from JSON, validation against a vocabulary, and back to JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass

#: Atoms and combinators with the kinds of their arguments, in the language's order. s: string, i: number,
#: b: bound (number or "inf"), v: number or string, f: field, d: date field or literal, l: list field, t: tuple, o: OID,
#: h: hex, h: holder, p: predicate, r: named regular expression, P: predicates.
SIGNATURES = {
    "ExtPresent": "o", "HasAnyExtension": "", "ExtCritical": "o", "ExtNotCritical": "o", "ExtContentNonEmpty": "o", "IsCA": "", "IsRootCA": "",
    "IsSubCA": "", "PathLenConstraintPresent": "", "IsServerCert": "", "IsSubscriberCert": "", "IsEndEntity": "", "KeyUsageHas": "s",
    "ExtKeyUsageHas": "s", "FieldEq": "fv", "FieldNonEmpty": "f", "FieldEmpty": "f", "FieldMatchesRegex": "fr", "FieldNotMatchesRegex": "fr",
    "FieldInSet": "ft", "FieldNotInSet": "ft", "FieldLenInRange": "fib", "FieldNumericInRange": "fib", "FieldCount": "fib", "FieldEncodedAs": "ft",
    "DNDirectoryStringValuesEncodedAs": "st", "FieldContains": "fs", "CrossFieldEq": "ff", "DateAfter": "dd", "DateBefore": "dd",
    "ListAllMatch": "lp", "ListAnyMatch": "lp", "ListUnique": "l", "WildcardFilter": "lsp", "ItemMatchesRegex": "r", "ItemInSet": "t", "ItemEq": "v",
    "ItemLenIn": "t", "ItemNotMatchesRegex": "r", "BytesEq": "ff", "IPListAllOctetCount": "fi", "OidListContains": "fo", "OidListCountInSet": "ftib",
    "BytesEqualsHex": "fh", "BytesContainsHex": "fh", "ExtensionURISchemeNotInSet": "t", "PublicKeyAlgorithmIs": "s", "DNEmpty": "s",
    "ExtRawValueEqualsHex": "oh", "ExtRawValueContainsHex": "oh", "ExtSubfieldPresent": "oiss", "AIAHasMethodOtherThan": "ot",
    "AIAMethodLocationsTagInSet": "oot", "AIAMethodLocationsAnyMatchRegex": "oor", "CRLDPHasNameRelative": "", "CRLDPHasNameRelativeWithMultiIssuer": "",
    "ValidityDateAsn1TagInSet": "st", "CertPolicyExplicitTextHasEncodingTagInSet": "t", "PolicyQualifierOIDInSet": "o", "PolicyQualifierOIDNotInSet": "o",
    "OidEq": "fo", "SubtreeIPListAnyHasOctetCount": "fi", "BytesContainsOidDer": "fo", "IPListAllOctetCountIn": "ft", "SubtreeIPListAnyAllZero": "fi",
    "SubtreeIPListAnyHasOctetCountAndNotAllZero": "fi", "SubtreeStringListAllMatch": "lp", "SubtreeStringListAnyMatch": "lp",
    "SubtreeStringListAllMatchOrEmpty": "lp", "SubtreeIPListAllOctetCountIn": "ft", "SubtreeIPMaskValidCIDR": "f", "ScalarInList": "fl",
    "ScalarInAnyOfLists": "ft", "IPv4Conditional": "lpp", "SubtreeIPv4Conditional": "lpp", "ExtHasGeneralNameWithTag": "oi", "ExtHasAnyGeneralNameOfTag": "oi",
    "DomainComponentOrdered": "", "RSAModulusBitsInRange": "ib", "RSAPublicExponentInRange": "ib", "SigAlgMatchesTBSSignature": "",
    "NotAfterIsNoExpirySentinel": "", "CommonNameFromSAN": "", "RDNCountInRange": "sib", "RDNHasSingleAttribute": "s", "RDNSequenceHasCountryBefore": "s",
    "SerialNumberPositive": "", "SerialNumberOctetLengthInRange": "ib", "Not": "p", "When": "pp", "And": "P", "Or": "P",
}
COMBINATORS = ("Not", "When", "And", "Or")
ATOMS = tuple(n for n in SIGNATURES if n not in COMBINATORS)
INF = "inf"


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()


def parse(source) -> Node:
    """A tree from JSON text or a dict ``{"op": name, "args": [...]}``; unknown names and wrong arity raise."""
    data = json.loads(source) if isinstance(source, str) else source
    if not isinstance(data, dict) or "op" not in data:
        raise ValueError(f"not a predicate: {data!r}")
    op, args = data["op"], data.get("args", [])
    if op not in SIGNATURES:
        raise ValueError(f"unknown operation {op!r}")
    kinds = SIGNATURES[op]
    if kinds == "P":
        parts = args[0] if len(args) == 1 and isinstance(args[0], list) else args
        if not parts:
            raise ValueError(f"{op} needs a part")
        return Node(op, tuple(parse(a) for a in parts))
    if len(args) != len(kinds):
        raise ValueError(f"{op} takes {len(kinds)} arguments, not {len(args)}")
    return Node(op, tuple(parse(a) if k == "p" else tuple(a) if k == "t" else a for k, a in zip(kinds, args)))


def serialise(node: Node) -> dict:
    plain = lambda a: serialise(a) if isinstance(a, Node) else list(a) if isinstance(a, tuple) else a
    return {"op": node.op, "args": [plain(a) for a in node.args]}


def leaves(node: Node) -> list[Node]:
    if node.op in COMBINATORS:
        return [x for a in node.args for x in leaves(a)]
    return [node]


def validate(node: Node, vocabulary) -> list[str]:
    """What is wrong with the names and types of a tree; nothing if it can be compiled."""
    wrong = []
    kinds = SIGNATURES[node.op]
    if kinds == "P":
        return [w for a in node.args for w in validate(a, vocabulary)]
    for k, a in zip(kinds, node.args):
        if k == "p":
            wrong += validate(a, vocabulary)
        elif k in "fl" and a not in vocabulary.fields:
            wrong.append(f"{node.op}: unknown field {a!r}")
        elif k == "l" and not vocabulary.fields[a].is_list:
            wrong.append(f"{node.op}: {a!r} is not a list")
        elif k == "r" and a not in vocabulary.regexes:
            wrong.append(f"{node.op}: unknown regular expression {a!r}")
        elif k == "i" and not isinstance(a, int):
            wrong.append(f"{node.op}: {a!r} is not a number")
        elif k == "b" and not (isinstance(a, int) or a == INF):
            wrong.append(f"{node.op}: {a!r} is not a bound")
        elif k in "os" and not isinstance(a, str):
            wrong.append(f"{node.op}: {a!r} is not a string")
        elif k == "h" and not (isinstance(a, str) and len(a) % 2 == 0 and all(c in "0123456789abcdefABCDEF" for c in a)):
            wrong.append(f"{node.op}: {a!r} is not hexadecimal")
        elif k == "d" and not (isinstance(a, str) and (a in vocabulary.fields or a[:4].isdigit())):
            wrong.append(f"{node.op}: {a!r} is not a date")
    if node.op == "KeyUsageHas" and node.args[0] not in vocabulary.key_usage:
        wrong.append(f"KeyUsageHas: unknown bit {node.args[0]!r}")
    return wrong


def certified(node: Node, known: set[str]) -> bool:
    """All leaves are atoms of ``known``."""
    return all(x.op in known for x in leaves(node))


def vacuous_when(node: Node) -> bool:
    """A condition that equals its consequence, or the negation of a condition that can't hold with it: always true."""
    if node.op == "When":
        cond, main = node.args
        if cond == main or (main.op == "Or" and cond in main.args):
            return True
    return any(vacuous_when(a) for a in node.args if isinstance(a, Node))


def summary(node: Node) -> str:
    """A sentence for people."""
    if node.op == "And":
        return "(" + " and ".join(map(summary, node.args)) + ")"
    if node.op == "Or":
        return "(" + " or ".join(map(summary, node.args)) + ")"
    if node.op == "Not":
        return f"not {summary(node.args[0])}"
    if node.op == "When":
        return f"if {summary(node.args[0])} then {summary(node.args[1])}"
    name = "".join(" " + c.lower() if c.isupper() else c for c in node.op).strip()
    said = [summary(a) if isinstance(a, Node) else "{" + ", ".join(map(str, a)) + "}" if isinstance(a, tuple) else str(a) for a in node.args]
    return f"{name} [{'; '.join(said)}]" if said else name
