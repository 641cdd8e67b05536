"""Every atom of predicate trees over records of the shape of certificates, made from orders.

Each field of an order's record is one of a few values, picked by the order's key; the SQL states what an atom means over
the same values, with lists and hexadecimal text for octets, and counts the records for which it holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import CERTIFICATE, compile_tree, parse
from ..session import read
from .registry import query

SAN, KU, AKI, AIA, OCSP, ISSUERS = "2.5.29.17", "2.5.29.15", "2.5.29.35", "1.3.6.1.5.5.7.1.1", "1.3.6.1.5.5.7.48.1", "1.3.6.1.5.5.7.48.2"
C, ST, O, CN, DC = "2.5.4.6", "2.5.4.8", "2.5.4.10", "2.5.4.3", "0.9.2342.19200300.100.1.25"
DN = "array<array<struct<oid:string,tag:int,value:string>>>"
IPS = "array<struct<ip:string,mask:string>>"
#: column: (type, values); octets are hexadecimal here. An order's value is the one at its key modulo their number.
RECORD = {
    "version": ("int", [1, 2, 3]),
    "serial": ("string", ["", "000A", "7F01", "8000000001", "01"]),
    "serial_sign": ("int", [0, 1, 1, -1, 1]),
    "not_before_tag": ("int", [23, 24]),
    "validity_period": ("int", [0, 100, 397, 398, 399, 825]),
    "key_usage": ("int", [0, 1, 4, 5, 32, 96, 256]),
    "ext_key_usage": ("array<string>", [[], ["serverAuth"], ["clientAuth", "serverAuth"]]),
    "is_ca": ("boolean", [True, False]),
    "basic_constraints_valid": ("boolean", [True, True, False]),
    "self_signed": ("boolean", [True, False, False, False, False]),
    "max_path_len": ("int", [-1, 0, 2]),
    "max_path_len_zero": ("boolean", [True, False, False, False]),
    "ski": ("string", ["", "AA", "BB01"]),
    "aki": ("string", ["", "AA", "CC", "BB01", "AA"]),
    "dns_names": ("array<string>", [[], ["a.org", "*.b.org"], ["x_y.org"], ["a.org", "a.org", "-bad"], ["zzz"]]),
    "emails": ("array<string>", [[], ["q@x.org"], ["nomail", "r@y.org"]]),
    "uris": ("array<string>", [["http://x"], ["ldap://y", "urn:z"], []]),
    "ip_addresses": ("array<string>", [[], ["01020304"], ["20010DB8000000000000000000000001"], ["0102", "01020304"]]),
    "ip_texts": ("array<string>", [[], ["1.2.3.4"], ["1.2.3.4", "::1"]]),
    "policy_oids": ("array<string>", [["2.23.140.1.2.1"], ["2.5.29.32.0", "1.2.3"], []]),
    "policy_qualifiers": ("array<string>", [["1.3.6.1.5.5.7.2.1"], ["1.3.6.1.5.5.7.2.2"], []]),
    "notice_text_tags": ("array<int>", [[], [12], [22, 26]]),
    "extensions": ("array<struct<oid:string,critical:boolean,value:string>>", [[], [(SAN, False, "3003820178")], [(KU, True, "0302")], [(SAN, True, "0500"), (KU, False, "030205")]]),
    "content": ("int", [None, 0, 1, 2]),
    "context": ("array<struct<path:string,tag:int>>", [None, [("", 0)], [("", 1), ("x", 0)]]),
    "ext_uris": ("array<string>", [[], ["http://a/"], ["LDAP://b", "ftp:c"], ["nocolon"]]),
    "names": ("array<struct<tag:int,value:string>>", [None, [(2, "622E")], [(2, "C3A9"), (1, "61")], [(1, "E9")]]),
    "access": ("array<struct<method:string,tag:int,location:string>>", [None, [(OCSP, 6, "http://o")], [(ISSUERS, 6, "ldap://c"), (OCSP, 1, "x")]]),
    "crl_points": ("array<struct<name_relative:boolean,n_issuer:int>>", [[], [(True, 2)], [(False, 3), (True, 1)]]),
    "subject_rdns": (DN, [[], [[(C, 19, "DE")], [(ST, 12, "BY")]], [[(ST, 12, "BY")], [(C, 19, "FR"), (CN, 12, "a.org")]], [[(DC, 22, "x")], [(O, 30, "o")], [(DC, 22, "y")]], [[(O, 19, "o")], [(DC, 22, "y")], [(DC, 22, "z")]]]),
    "issuer_rdns": (DN, [[], [[(C, 19, "DE")]], [[(CN, 30, "r"), (O, 12, "s")]]]),
    "permitted_dns": ("array<string>", [[], ["a.org"], [".b.org", "c d"]]),
    "permitted_ips": (IPS, [[], [("0A000000", "FF000000")], [("00000000", "00000000")], [("0A000001", "FF00FF00"), ("20010DB8000000000000000000000001", "FFFFFFFF000000000000000000000000")]]),
    "subject_raw": ("string", ["0603550403", "3000", "0603550404"]),
    "issuer_raw": ("string", ["3000", "3001"]),
    "sig_alg_raw": ("string", ["01"]),
    "tbs_sig_alg_raw": ("string", ["01", "02", "01", None]),
    "signature_oid": ("string", ["1.2.3", "1.2.4"]),
    "public_key_algorithm": ("string", ["RSA", "ECDSA", "Ed25519"]),
    "rsa_bits": ("int", [1024, 2048, None, 4096]),
    "rsa_exp": ("bigint", [3, 65537, None]),
    "common_name": ("string", ["", "a.org", "1.2.3.4", "zzz"]),
}
OCTETS = ("serial", "ski", "aki", "subject_raw", "issuer_raw", "sig_alg_raw", "tbs_sig_alg_raw")
DNS = r"^(\*\.)?([A-Za-z0-9_]([A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?\.)*[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?$"
MAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _any(rows, holds):
    return f"coalesce(len(list_filter({rows}, lambda x: {holds})) > 0, false)"


def _all(rows, holds):
    return f"coalesce(len(list_filter({rows}, lambda x: not ({holds}))) = 0, false)"


def _some_and_all(rows, holds):
    return f"(len({rows}) > 0 and {_all(rows, holds)})"


_hex_of = lambda c: f"(length({c}) // 2)"
_big = lambda c: f"('0x0' || {c})::bigint"
_octets = "((length(x.ip) + length(x.mask)) // 2)"
_zero = "not regexp_matches(x.ip || x.mask, '[^0]')"
_first = lambda h, oid: f"list_min(list_transform(list_filter(range(1, len({h}) + 1), lambda k: len(list_filter({h}[k], lambda a: a.oid = '{oid}')) > 0), lambda k: k))"
_flat = lambda h: f"flatten({h})"
#: (tree, what it means in SQL)
ATOMS = [
    (["ExtPresent", SAN], _any("extensions", f"x.oid = '{SAN}'")), (["HasAnyExtension"], "len(extensions) > 0"), (["ExtCritical", KU], _any("extensions", f"x.oid = '{KU}' and x.critical")),
    (["ExtNotCritical", SAN], _any("extensions", f"x.oid = '{SAN}' and not x.critical")), (["ExtContentNonEmpty", SAN], "coalesce(content > 0, false)"),
    (["IsCA"], "is_ca and basic_constraints_valid"), (["IsRootCA"], "is_ca and self_signed"), (["IsSubCA"], "is_ca and not self_signed"), (["PathLenConstraintPresent"], "max_path_len > 0 or max_path_len_zero"),
    (["IsServerCert"], "list_contains(ext_key_usage, 'serverAuth')"), (["IsSubscriberCert"], "not is_ca"), (["IsEndEntity"], "not is_ca"), (["KeyUsageHas", "keyEncipherment"], "(key_usage & 4) <> 0"), (["KeyUsageHas", "keyCertSign"], "(key_usage & 32) <> 0"),
    (["ExtKeyUsageHas", "clientAuth"], "list_contains(ext_key_usage, 'clientAuth')"), (["PublicKeyAlgorithmIs", "RSA|Ed25519"], "public_key_algorithm in ('RSA', 'Ed25519')"),
    (["FieldEq", "version", 3], "version = 3"), (["FieldEq", "policy_oids", "2.23.140.1.2.1"], "len(policy_oids) = 1 and policy_oids[1] = '2.23.140.1.2.1'"), (["FieldNonEmpty", "dns_names"], "len(dns_names) > 0"), (["FieldNonEmpty", "serial"], "serial <> ''"),
    (["FieldNonEmpty", "subject"], "len(subject_rdns) > 0"), (["FieldEmpty", "emails"], "len(emails) = 0"), (["FieldEmpty", "common_name"], "common_name = ''"), (["FieldMatchesRegex", "dns_names", "dns_name"], _some_and_all("dns_names", f"regexp_matches(x, '{DNS}')")),
    (["FieldMatchesRegex", "common_name", "ipv4"], "regexp_matches(common_name, '^([0-9]{1,3}\\.){3}[0-9]{1,3}$')"), (["FieldNotMatchesRegex", "dns_names", "underscore"], _some_and_all("dns_names", "not contains(x, '_')")), (["FieldInSet", "version", [2, 3]], "version in (2, 3)"),
    (["FieldNotInSet", "emails", ["nomail"]], _all("emails", "x <> 'nomail'")), (["FieldLenInRange", "common_name", 1, 5], "strlen(common_name) between 1 and 5"), (["FieldLenInRange", "serial", 2, 2], f"{_hex_of('serial')} = 2"), (["FieldLenInRange", "dns_names", 2, "inf"], "len(dns_names) >= 2"),
    (["FieldNumericInRange", "serial", 10, 32513], f"{_big('serial')} between 10 and 32513"), (["FieldNumericInRange", "serial", 32514, "inf"], f"{_big('serial')} >= 32514"), (["FieldNumericInRange", "validity_period", 0, 398], "validity_period <= 398"), (["FieldCount", "uris", 1, 1], "len(uris) = 1"),
    (["FieldEncodedAs", "subject", ["UTF8String", "PrintableString"]], _some_and_all(_flat("subject_rdns"), "x.tag in (12, 19)")), (["FieldEncodedAs", "emails", ["PrintableString"]], _some_and_all("emails", "regexp_matches(x, '^[A-Za-z0-9 ''()+,./:=?-]*$')")),
    (["DNDirectoryStringValuesEncodedAs", "subject", ["UTF8String"]], _all(_flat("subject_rdns"), f"x.oid not in ('{CN}', '{ST}', '{O}') or x.tag = 12")), (["FieldContains", "uris", "ldap"], _some_and_all("uris", "contains(x, 'ldap')")),
    (["CrossFieldEq", "ski", "aki"], "ski = aki"), (["BytesEq", "subject_raw", "issuer_raw"], "subject_raw = issuer_raw"), (["DateAfter", "not_after", "not_before"], "not_after > not_before"), (["DateBefore", "not_before", "1995-06-01"], "not_before < timestamp '1995-06-01'"),
    (["ListAllMatch", "emails", ["ItemMatchesRegex", "email"]], _some_and_all("emails", f"regexp_matches(x, '{MAIL}')")), (["ListAnyMatch", "emails", ["ItemNotMatchesRegex", "email"]], _any("emails", f"not regexp_matches(x, '{MAIL}')")), (["ListAnyMatch", "dns_names", ["ItemInSet", ["zzz", "a.org"]]], _any("dns_names", "x in ('zzz', 'a.org')")),
    (["ListAnyMatch", "uris", ["ItemEq", "urn:z"]], _any("uris", "x = 'urn:z'")), (["ListUnique", "dns_names"], "len(list_distinct(dns_names)) = len(dns_names)"), (["WildcardFilter", "dns_names", "*.", ["ItemLenIn", [7]]], _all("dns_names", "not starts_with(x, '*.') or strlen(x) = 7")),
    (["IPListAllOctetCount", "ip_addresses", 4], _all("ip_addresses", "length(x) = 8")), (["IPListAllOctetCountIn", "ip_addresses", [4, 16]], _all("ip_addresses", "length(x) in (8, 32)")),
    (["IPv4Conditional", "ip_addresses", ["ItemLenIn", [4]], ["ItemLenIn", [15]]], _all("ip_addresses", "length(x) <> 32")), (["ScalarInList", "common_name", "dns_names"], "common_name = '' or list_contains(dns_names, common_name)"),
    (["ScalarInAnyOfLists", "common_name", ["dns_names", "uris"]], "common_name = '' or list_contains(dns_names, common_name) or list_contains(uris, common_name)"), (["OidListContains", "policy_oids", "1.2.3"], "list_contains(policy_oids, '1.2.3')"),
    (["OidListCountInSet", "policy_oids", ["1.2.3", "2.23.140.1.2.1"], 1, 1], "len(list_filter(policy_oids, lambda x: x in ('1.2.3', '2.23.140.1.2.1'))) = 1"), (["OidEq", "signature_oid", "1.2.4"], "signature_oid = '1.2.4'"),
    (["BytesEqualsHex", "ski", "bb01"], "ski = 'BB01'"), (["BytesContainsHex", "subject_raw", "5504"], "regexp_matches(subject_raw, '^(..)*5504')"), (["BytesContainsOidDer", "subject_raw", CN], "regexp_matches(subject_raw, '^(..)*0603550403')"),
    (["ExtensionURISchemeNotInSet", ["ldap", "nocolon"]], f"not {_any('ext_uris', "contains(x, ':') and lower(split_part(x, ':', 1)) in ('ldap', 'nocolon')")}"), (["DNEmpty", "issuer"], "len(issuer_rdns) = 0"),
    (["ExtRawValueEqualsHex", KU, "0302"], _any("extensions", f"x.oid = '{KU}' and x.value = '0302'")), (["ExtRawValueContainsHex", SAN, "82"], _any("extensions", f"x.oid = '{SAN}' and regexp_matches(x.value, '^(..)*82')")),
    (["ExtSubfieldPresent", AKI, 0, "keyIdentifier", ""], _any("context", "x.tag = 0 and x.path = ''")), (["AIAHasMethodOtherThan", AIA, [OCSP]], _any("access", f"x.method <> '{OCSP}'")),
    (["AIAMethodLocationsTagInSet", AIA, OCSP, [6]], f"access is null or {_all('access', f"x.method <> '{OCSP}' or x.tag = 6")}"), (["AIAMethodLocationsAnyMatchRegex", AIA, OCSP, "uri_http"], _any("access", f"x.method = '{OCSP}' and regexp_matches(x.location, '^https?://[^\\s]+$')")),
    (["CRLDPHasNameRelative"], _any("crl_points", "x.name_relative")), (["CRLDPHasNameRelativeWithMultiIssuer"], _any("crl_points", "x.name_relative and x.n_issuer > 1")), (["ValidityDateAsn1TagInSet", "not_before", [23]], "not_before_tag = 23"),
    (["CertPolicyExplicitTextHasEncodingTagInSet", [12, 26]], _any("notice_text_tags", "x in (12, 26)")), (["PolicyQualifierOIDInSet", "1.3.6.1.5.5.7.2.1"], "list_contains(policy_qualifiers, '1.3.6.1.5.5.7.2.1')"), (["PolicyQualifierOIDNotInSet", "1.3.6.1.5.5.7.2.2"], "not list_contains(policy_qualifiers, '1.3.6.1.5.5.7.2.2')"),
    (["SubtreeIPListAnyHasOctetCount", "permitted_ips", 32], _any("permitted_ips", f"{_octets} = 32")), (["SubtreeIPListAnyAllZero", "permitted_ips", 8], _any("permitted_ips", f"{_octets} = 8 and {_zero}")), (["SubtreeIPListAnyHasOctetCountAndNotAllZero", "permitted_ips", 8], _any("permitted_ips", f"{_octets} = 8 and not {_zero}")),
    (["SubtreeIPListAllOctetCountIn", "permitted_ips", [8]], _all("permitted_ips", f"{_octets} = 8")), (["SubtreeIPMaskValidCIDR", "permitted_ips"], _all("permitted_ips", "regexp_matches(x.mask, '^F*[FEC8]?0*$')")),
    (["SubtreeIPv4Conditional", "permitted_ips", ["ItemLenIn", [4]], ["ItemLenIn", [4]]], _all("permitted_ips", f"{_octets} <> 32")), (["SubtreeStringListAllMatch", "permitted_dns", ["ItemMatchesRegex", "dns_name"]], _some_and_all("permitted_dns", f"regexp_matches(x, '{DNS}')")),
    (["SubtreeStringListAnyMatch", "permitted_dns", ["ItemMatchesRegex", "leading_dot"]], _any("permitted_dns", "starts_with(x, '.')")), (["SubtreeStringListAllMatchOrEmpty", "permitted_dns", ["ItemMatchesRegex", "dns_name"]], _all("permitted_dns", f"regexp_matches(x, '{DNS}')")),
    (["ExtHasGeneralNameWithTag", SAN, 2], f"names is not null and {_all('names', "x.tag <> 2 or not regexp_matches(x.value, '^(..)*[89A-F]')")}"), (["ExtHasAnyGeneralNameOfTag", SAN, 1], _any("names", "x.tag = 1")),
    (["DomainComponentOrdered"], f"regexp_matches(coalesce(list_aggregate(list_transform(subject_rdns, lambda r: case when len(list_filter(r, lambda a: a.oid = '{DC}')) > 0 then '1' else '0' end), 'string_agg', ''), ''), '^0*1*$')"),
    (["RSAModulusBitsInRange", 2048, "inf"], "rsa_bits is null or rsa_bits >= 2048"), (["RSAPublicExponentInRange", 65537, "inf"], "rsa_exp is null or rsa_exp >= 65537"), (["SigAlgMatchesTBSSignature"], "tbs_sig_alg_raw is null or sig_alg_raw = tbs_sig_alg_raw"),
    (["NotAfterIsNoExpirySentinel"], "not_after = timestamp '9999-12-31 23:59:59'"), (["CommonNameFromSAN"], "common_name = '' or list_contains(dns_names, common_name) or list_contains(ip_texts, common_name)"), (["RDNCountInRange", "subject", 2, 2], "len(subject_rdns) = 2"),
    (["RDNHasSingleAttribute", "subject"], _all("subject_rdns", "len(x) = 1")), (["RDNSequenceHasCountryBefore", "subject"], f"coalesce({_first('subject_rdns', C)} < {_first('subject_rdns', ST)}, true)"),
    (["SerialNumberPositive"], "serial_sign > 0"), (["SerialNumberOctetLengthInRange", 1, 4], f"{_hex_of('serial')} between 1 and 4"),
]


def _plain(v) -> str:
    """A value as SQL."""
    if v is None:
        return "null"
    if isinstance(v, list):
        return f"[{', '.join(_plain(x) for x in v)}]"
    if isinstance(v, tuple):
        return f"row({', '.join(_plain(x) for x in v)})"
    return str(v).lower() if isinstance(v, bool | int) else f"'{v}'"


def _sql_type(t: str) -> str:
    if t.startswith("array<"):
        return _sql_type(t[6:-1]) + "[]"
    if t.startswith("struct<"):
        return "struct(" + ", ".join(f"{n} {_sql_type(k)}" for n, k in (x.split(":") for x in t[7:-1].split(","))) + ")"
    return {"string": "varchar"}.get(t, t)


def _records_sql() -> str:
    pick = [f"(case o_orderkey % {len(vs)} {' '.join(f'when {i} then {_plain(v)}' for i, v in enumerate(vs))} end)::{_sql_type(t)} as {n}" for n, (t, vs) in RECORD.items()]
    dates = "o_orderdate as not_before, case when o_orderkey % 7 = 0 then timestamp '9999-12-31 23:59:59' else o_orderdate + to_days((o_orderkey % 4)::int) end as not_after"
    return f"select o_orderkey, {dates}, {', '.join(pick)} from orders"


def _value(v) -> Column:
    if isinstance(v, list):
        return F.array(*[_value(x) for x in v])
    return F.struct(*[_value(x) for x in v]) if isinstance(v, tuple) else F.lit(v)


def records(spark, sf_dir):
    """Orders as certificate records."""
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")

    def pick(kind, values):
        out = F.lit(None).cast(kind)
        for i, v in enumerate(values):
            out = F.when(key % len(values) == i, _value(v).cast(kind)).otherwise(out)
        return out

    dates = {"not_before": F.col("o_orderdate").cast("timestamp"), "not_after": F.when(key % 7 == 0, F.lit("9999-12-31 23:59:59").cast("timestamp")).otherwise(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval((key % 4).cast("int")))}
    r = o.select("o_orderkey", *[c.alias(n) for n, c in dates.items()], *[pick(t, vs).alias(n) for n, (t, vs) in RECORD.items()])
    octets = {n: F.unhex(n) for n in OCTETS} | {"ip_addresses": F.transform("ip_addresses", lambda x: F.unhex(x)), "permitted_ips": F.transform("permitted_ips", lambda x: F.struct(F.unhex(x["ip"]).alias("ip"), F.unhex(x["mask"]).alias("mask")))}
    octets |= {"extensions": F.transform("extensions", lambda x: F.struct(x["oid"].alias("oid"), x["critical"].alias("critical"), F.unhex(x["value"]).alias("value"))), "names": F.transform("names", lambda x: F.struct(x["tag"].alias("tag"), F.unhex(x["value"]).alias("value")))}
    r = r.withColumns(octets)
    mapped = {"ext_content_count": (SAN, "content"), "ext_context_tags": (AKI, "context"), "general_names": (SAN, "names"), "access_descriptions": (AIA, "access")}
    maps = {n: F.when(F.col(c).isNull(), F.create_map().cast(f"map<string,{dict(r.dtypes)[c]}>")).otherwise(F.create_map(F.lit(oid), F.col(c))) for n, (oid, c) in mapped.items()}
    holders = {h: F.struct(F.col(f"{h}_rdns").alias("rdns")) for h in ("subject", "issuer")}
    return r.withColumns(maps | holders | {"excluded_ips": F.col("permitted_ips"), "excluded_dns": F.col("permitted_dns"), "extension_oids": F.transform("extensions", lambda x: x["oid"])})


def _node(tree):
    return {"op": tree[0], "args": [_node(a) if isinstance(a, list) and a and isinstance(a[0], str) and a[0].startswith("Item") else a for a in tree[1:]]}


def _sql() -> str:
    counts = " union all ".join(f"select {i} as n, '{tree[0]}' as atom, count(*) filter ({sql}) as holds from r" for i, (tree, sql) in enumerate(ATOMS))
    return f"with r as materialized ({_records_sql()}) {counts}"


@query(_sql())
def lint_certificates(spark, sf_dir):
    """For how many records each atom holds, all in one scan."""
    held = records(spark, sf_dir).agg(*[F.count_if(compile_tree(parse(_node(tree)), CERTIFICATE)).alias(str(i)) for i, (tree, _) in enumerate(ATOMS)])
    every = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(tree[0]).alias("atom"), F.col(f"`{i}`").alias("holds")) for i, (tree, _) in enumerate(ATOMS)])
    return held.select(F.explode(every).alias("a")).select("a.*")
