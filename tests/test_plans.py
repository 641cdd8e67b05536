"""Predicate trees: every atom on a small certificate record, against values worked out by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rulemill.plans import CERTIFICATE, Lint, compile_tree, lint_column, lint_columns, multi_branch, parse, serialise, validate
from rulemill.plans.compile import encoded_oid
from rulemill.plans.tree import ATOMS, certified, leaves, summary, vacuous_when

ATTR = "struct<oid:string,tag:int,value:string>"
DN = f"struct<raw:binary,rdns:array<array<{ATTR}>>>"
SCHEMA = (
    f"id int, version int, serial binary, serial_sign int, not_before timestamp, not_after timestamp, not_before_tag int, not_after_tag int, validity_period int, key_usage int, ext_key_usage array<string>, "
    f"is_ca boolean, basic_constraints_valid boolean, self_signed boolean, max_path_len int, max_path_len_zero boolean, ski binary, aki binary, dns_names array<string>, emails array<string>, uris array<string>, "
    f"ip_addresses array<binary>, ip_texts array<string>, policy_oids array<string>, policy_qualifiers array<string>, notice_text_tags array<int>, extension_oids array<string>, extensions array<struct<oid:string,critical:boolean,value:binary>>, "
    f"ext_content_count map<string,int>, ext_context_tags map<string,array<struct<path:string,tag:int>>>, ext_uris array<string>, general_names map<string,array<struct<tag:int,value:binary>>>, "
    f"access_descriptions map<string,array<struct<method:string,tag:int,location:string>>>, crl_points array<struct<name_relative:boolean,n_issuer:int>>, subject {DN}, issuer {DN}, "
    f"permitted_dns array<string>, excluded_dns array<string>, permitted_ips array<struct<ip:binary,mask:binary>>, excluded_ips array<struct<ip:binary,mask:binary>>, subject_raw binary, issuer_raw binary, "
    f"sig_alg_raw binary, tbs_sig_alg_raw binary, signature_oid string, public_key_algorithm string, rsa_bits int, rsa_exp long, common_name string"
)
DC = "0.9.2342.19200300.100.1.25"
FULL = {
    "id": 1, "version": 3, "serial": b"\x01\x02", "serial_sign": 1, "not_before": dt.datetime(2024, 1, 1), "not_after": dt.datetime(2025, 1, 1), "not_before_tag": 23, "not_after_tag": 24, "validity_period": 366,
    "key_usage": 5, "ext_key_usage": ["serverAuth"], "is_ca": False, "basic_constraints_valid": True, "self_signed": False, "max_path_len": 0, "max_path_len_zero": True, "ski": b"\xaa", "aki": b"\xaa",
    "dns_names": ["*.a.org", "b.org"], "emails": [], "uris": ["http://x"], "ip_addresses": [b"\x01\x02\x03\x04"], "ip_texts": ["1.2.3.4"], "policy_oids": ["2.23.140.1.2.1"], "policy_qualifiers": ["1.3.6.1.5.5.7.2.1"],
    "notice_text_tags": [12], "extension_oids": ["2.5.29.17"], "extensions": [("2.5.29.17", False, b"\x30\x03\x82\x01x"), ("2.5.29.15", True, b"\x03\x02")], "ext_content_count": {"2.5.29.17": 1},
    "ext_context_tags": {"2.5.29.35": [("", 0)]}, "ext_uris": ["http://x/y"], "general_names": {"2.5.29.17": [(2, b"b.org"), (1, b"\xc3\xa9")]},
    "access_descriptions": {"1.3.6.1.5.5.7.1.1": [("1.3.6.1.5.5.7.48.1", 6, "http://ocsp")]}, "crl_points": [(True, 2)],
    "subject": (b"s", [[(DC, 22, "org")], [("2.5.4.6", 19, "DE")], [("2.5.4.8", 12, "BY"), ("2.5.4.3", 12, "b.org")]]), "issuer": (b"i", []),
    "permitted_dns": ["a.org"], "excluded_dns": [], "permitted_ips": [(b"\x0a\x00\x00\x00", b"\xff\x00\x00\x00")], "excluded_ips": [(b"\x00" * 4, b"\x00" * 4)], "subject_raw": b"\x06\x03\x55\x04\x03", "issuer_raw": b"i",
    "sig_alg_raw": b"\x01", "tbs_sig_alg_raw": b"\x01", "signature_oid": "1.2.3", "public_key_algorithm": "RSA", "rsa_bits": 2048, "rsa_exp": 65537, "common_name": "b.org",
}
#: (tree, on the full record, on a record of nulls)
CASES = [
    (["ExtPresent", "2.5.29.17"], True, False), (["HasAnyExtension"], True, False), (["ExtCritical", "2.5.29.15"], True, False), (["ExtNotCritical", "2.5.29.17"], True, False), (["ExtNotCritical", "2.5.29.99"], False, False),
    (["ExtContentNonEmpty", "2.5.29.17"], True, False), (["IsCA"], False, False), (["IsRootCA"], False, False), (["IsSubCA"], False, False), (["PathLenConstraintPresent"], True, False), (["IsServerCert"], True, False),
    (["IsSubscriberCert"], True, True), (["IsEndEntity"], True, True), (["KeyUsageHas", "keyEncipherment"], True, False), (["KeyUsageHas", "keyCertSign"], False, False), (["ExtKeyUsageHas", "serverAuth"], True, False),
    (["FieldEq", "version", 3], True, False), (["FieldEq", "policy_oids", "2.23.140.1.2.1"], True, False), (["FieldNonEmpty", "dns_names"], True, False), (["FieldNonEmpty", "not_after"], True, False), (["FieldEmpty", "emails"], True, True),
    (["FieldMatchesRegex", "dns_names", "dns_name"], True, False), (["FieldMatchesRegex", "emails", "email"], False, False), (["FieldNotMatchesRegex", "dns_names", "underscore"], True, False), (["FieldInSet", "version", [2, 3]], True, False),
    (["FieldNotInSet", "emails", ["a"]], True, True), (["FieldLenInRange", "common_name", 1, 5], True, False), (["FieldLenInRange", "serial", 2, 2], True, False), (["FieldNumericInRange", "serial", 258, 258], True, False),
    (["FieldNumericInRange", "serial", 259, "inf"], False, False), (["FieldNumericInRange", "validity_period", 0, 398], True, True), (["FieldCount", "dns_names", 2, "inf"], True, False), (["FieldEncodedAs", "subject", ["UTF8String", "PrintableString", "IA5String"]], True, False),
    (["FieldEncodedAs", "dns_names", ["IA5String"]], True, False), (["DNDirectoryStringValuesEncodedAs", "subject", ["UTF8String"]], True, False), (["FieldContains", "uris", "http"], True, False), (["CrossFieldEq", "common_name", "common_name"], True, True),
    (["DateAfter", "not_after", "not_before"], True, False), (["DateBefore", "not_before", "2024-06-01"], True, False), (["ListAllMatch", "dns_names", ["ItemMatchesRegex", "dns_name"]], True, False), (["ListAnyMatch", "dns_names", ["ItemEq", "b.org"]], True, False),
    (["ListUnique", "dns_names"], True, True), (["WildcardFilter", "dns_names", "*.", ["ItemLenIn", [7]]], True, True), (["ListAnyMatch", "dns_names", ["ItemInSet", ["x"]]], False, False), (["ListAllMatch", "dns_names", ["ItemNotMatchesRegex", "underscore"]], True, False),
    (["BytesEq", "ski", "aki"], True, True), (["IPListAllOctetCount", "ip_addresses", 4], True, True), (["OidListContains", "policy_oids", "2.23.140.1.2.1"], True, False), (["OidListCountInSet", "policy_oids", ["2.23.140.1.2.1"], 1, 1], True, False),
    (["BytesEqualsHex", "ski", "aa"], True, False), (["BytesContainsHex", "subject_raw", "5504"], True, False), (["ExtensionURISchemeNotInSet", ["ldap"]], True, True), (["ExtensionURISchemeNotInSet", ["http"]], False, True), (["PublicKeyAlgorithmIs", "RSA"], True, False),
    (["DNEmpty", "issuer"], True, False), (["ExtRawValueEqualsHex", "2.5.29.15", "0302"], True, False), (["ExtRawValueContainsHex", "2.5.29.17", "82"], True, False), (["ExtSubfieldPresent", "2.5.29.35", 0, "keyIdentifier", ""], True, False),
    (["AIAHasMethodOtherThan", "1.3.6.1.5.5.7.1.1", ["1.3.6.1.5.5.7.48.2"]], True, False), (["AIAMethodLocationsTagInSet", "1.3.6.1.5.5.7.1.1", "1.3.6.1.5.5.7.48.1", [6]], True, True), (["AIAMethodLocationsAnyMatchRegex", "1.3.6.1.5.5.7.1.1", "1.3.6.1.5.5.7.48.1", "uri_http"], True, False),
    (["CRLDPHasNameRelative"], True, False), (["CRLDPHasNameRelativeWithMultiIssuer"], True, False), (["ValidityDateAsn1TagInSet", "not_before", [23]], True, False), (["CertPolicyExplicitTextHasEncodingTagInSet", [12]], True, False),
    (["PolicyQualifierOIDInSet", "1.3.6.1.5.5.7.2.1"], True, False), (["PolicyQualifierOIDNotInSet", "1.3.6.1.5.5.7.2.2"], True, True), (["OidEq", "signature_oid", "1.2.3"], True, False), (["SubtreeIPListAnyHasOctetCount", "permitted_ips", 8], True, False),
    (["BytesContainsOidDer", "subject_raw", "2.5.4.3"], True, False), (["IPListAllOctetCountIn", "ip_addresses", [4, 16]], True, True), (["SubtreeIPListAnyAllZero", "excluded_ips", 8], True, False), (["SubtreeIPListAnyHasOctetCountAndNotAllZero", "permitted_ips", 8], True, False),
    (["SubtreeStringListAllMatch", "permitted_dns", ["ItemMatchesRegex", "dns_name"]], True, False), (["SubtreeStringListAnyMatch", "permitted_dns", ["ItemEq", "a.org"]], True, False), (["SubtreeStringListAllMatchOrEmpty", "excluded_dns", ["ItemEq", "q"]], True, True),
    (["SubtreeIPListAllOctetCountIn", "permitted_ips", [8, 32]], True, True), (["SubtreeIPMaskValidCIDR", "permitted_ips"], True, True), (["ScalarInList", "common_name", "dns_names"], True, True), (["ScalarInAnyOfLists", "common_name", ["uris", "dns_names"]], True, True),
    (["IPv4Conditional", "ip_addresses", ["ItemLenIn", [4]], ["ItemLenIn", [16]]], True, True), (["SubtreeIPv4Conditional", "permitted_ips", ["ItemLenIn", [4]], ["ItemLenIn", [16]]], True, True), (["ExtHasGeneralNameWithTag", "2.5.29.17", 2], True, False),
    (["ExtHasGeneralNameWithTag", "2.5.29.17", 1], False, False), (["ExtHasAnyGeneralNameOfTag", "2.5.29.17", 2], True, False), (["DomainComponentOrdered"], False, False), (["RSAModulusBitsInRange", 2048, "inf"], True, True), (["RSAPublicExponentInRange", 3, 5], False, True),
    (["SigAlgMatchesTBSSignature"], True, True), (["NotAfterIsNoExpirySentinel"], False, False), (["CommonNameFromSAN"], True, True), (["RDNCountInRange", "subject", 3, 3], True, False), (["RDNHasSingleAttribute", "subject"], False, False),
    (["RDNSequenceHasCountryBefore", "subject"], True, True), (["SerialNumberPositive"], True, False), (["SerialNumberOctetLengthInRange", 1, 20], True, False), (["Not", ["IsCA"]], True, True), (["When", ["IsCA"], ["IsRootCA"]], True, True),
    (["And", ["IsServerCert"], ["IsEndEntity"]], True, False), (["Or", ["IsCA"], ["IsEndEntity"]], True, True),
]


def tree(x):
    from rulemill.plans.tree import SIGNATURES

    kinds = SIGNATURES[x[0]]
    return {"op": x[0], "args": [tree(a) if isinstance(a, list) and (kinds == "P" or kinds[i] == "p") else a for i, a in enumerate(x[1:])]}


def test_atoms(spark):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(SCHEMA)
    full = tuple(FULL[f.name] for f in schema.fields)
    none = tuple(2 if f.name == "id" else None for f in schema.fields)
    rows = spark.createDataFrame([full, none], schema)
    seen = {x.op for c in CASES for x in leaves(parse(tree(c[0])))} | {a.op for c in CASES for n in leaves(parse(tree(c[0]))) for a in n.args if hasattr(a, "op")}
    assert seen >= set(ATOMS), set(ATOMS) - seen
    for part in range(0, len(CASES), 25):
        cases = CASES[part : part + 25]
        cols = [compile_tree(parse(tree(c[0])), CERTIFICATE).alias(f"c{i}") for i, c in enumerate(cases)]
        got = rows.select("id", *cols).orderBy("id").collect()
        for i, (t, want, empty) in enumerate(cases):
            assert (got[0][f"c{i}"], got[1][f"c{i}"]) == (want, empty), t


def test_language():
    assert len(ATOMS) == 88
    for t, _, _ in CASES:
        node = parse(json.dumps(tree(t)))
        assert validate(node, CERTIFICATE) == [] and parse(serialise(node)) == node and summary(node)
    for bad in ({"op": "Nope"}, {"op": "IsCA", "args": [1]}, {"op": "And", "args": []}, {"args": []}):
        with pytest.raises(ValueError):
            parse(bad)
    assert validate(parse({"op": "FieldEq", "args": ["nope", 1]}), CERTIFICATE)
    assert validate(parse({"op": "BytesEqualsHex", "args": ["ski", "abc"]}), CERTIFICATE) and validate(parse({"op": "KeyUsageHas", "args": ["x"]}), CERTIFICATE)
    assert certified(parse(tree(["Not", ["IsCA"]])), {"IsCA"}) and vacuous_when(parse(tree(["When", ["IsCA"], ["IsCA"]])))
    assert encoded_oid("2.5.4.3") == b"\x06\x03\x55\x04\x03" and encoded_oid("1.2.840.113549").hex() == "06062a864886f70d"


def test_lints(spark):
    df = spark.createDataFrame([(1, True, True), (2, False, True), (3, None, None)], "id int, is_ca boolean, self_signed boolean").withColumn("basic_constraints_valid", F.lit(True))
    ca, root = parse(tree(["IsCA"])), parse(tree(["IsRootCA"]))
    guarded, folded = Lint("g", root, ca, "SHOULD"), Lint("f", parse(tree(["When", ["IsCA"], ["IsRootCA"]])))
    assert (guarded.kind, folded.kind, guarded.severity) == ("guarded", "folded", "warn")
    got = df.select("id", lint_column(guarded, CERTIFICATE).alias("g"), lint_column(folded, CERTIFICATE).alias("f"), multi_branch([guarded, Lint("e", ca, parse(tree(["IsEndEntity"])))], CERTIFICATE).alias("m")).orderBy("id").collect()
    assert [(r.g, r.f, r.m) for r in got] == [("pass", "pass", "pass"), ("NA", "pass", "error"), ("NA", "pass", "error")]
    assert lint_columns(df, [guarded, folded], CERTIFICATE, "id").count() == 6
