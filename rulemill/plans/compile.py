"""Predicate tree -> Catalyst column. Every leaf is two-valued: a null is false, whatever the data.

Lists: "all" atoms on plain lists, and list-typed field atoms, want a non-empty list; wildcard, address and
``...OrEmpty`` atoms hold for an empty one. Lengths of strings are octets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tree import INF, Node
from .vocabulary import Vocabulary

#: Universal tags of ASN.1 string types.
STRING_TAGS = {"UTF8String": 12, "NumericString": 18, "PrintableString": 19, "TeletexString": 20, "IA5String": 22, "VisibleString": 26, "UniversalString": 28, "BMPString": 30}
#: Attribute types whose syntax is DirectoryString.
DIRECTORY_STRINGS = ("2.5.4.3", "2.5.4.4", "2.5.4.7", "2.5.4.8", "2.5.4.9", "2.5.4.10", "2.5.4.11", "2.5.4.12", "2.5.4.17", "2.5.4.42")
#: Characters that a string type allows, for fields that don't keep their tag.
CHARSETS = {"IA5String": "^[\\x00-\\x7F]*$", "PrintableString": "^[A-Za-z0-9 '()+,./:=?-]*$", "NumericString": "^[0-9 ]*$", "VisibleString": "^[\\x20-\\x7E]*$"}
NO_EXPIRY = "9999-12-31 23:59:59"


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def within(c: Column, lo, hi) -> Column:
    return c >= lo if hi == INF else (c >= lo) & (c <= hi)


def encoded_oid(oid: str) -> bytes:
    """DER content octets of an object identifier, with its tag and length."""
    first, second, *rest = map(int, oid.split("."))
    body = bytearray()
    for n in [first * 40 + second, *rest]:
        part = [n & 0x7F]
        while n := n >> 7:
            part.append(n & 0x7F | 0x80)
        body += bytes(reversed(part))
    return bytes([6, len(body)]) + bytes(body)


class Compiler:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def __call__(self, node: Node, item: Column | None = None) -> Column:
        if node.op == "Not":
            return ~self(node.args[0], item)
        if node.op == "When":
            return ~self(node.args[0], item) | self(node.args[1], item)
        if node.op in ("And", "Or"):
            parts = [self(a, item) for a in node.args]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if node.op == "And" else out | p
            return out
        if node.op.startswith("Item"):
            if item is None:
                raise ValueError(f"{node.op} outside a list")
            return sure(self.item(node, item))
        return sure(getattr(self, node.op)(*node.args))

    # items of lists
    def item(self, node: Node, x: Column) -> Column:
        a = node.args[0]
        if node.op == "ItemMatchesRegex":
            return x.rlike(self.v.regex(a))
        if node.op == "ItemNotMatchesRegex":
            return ~x.rlike(self.v.regex(a))
        if node.op == "ItemInSet":
            return x.isin(*a)
        if node.op == "ItemEq":
            return x == F.lit(a)
        return F.octet_length(x).isin(*a)  # ItemLenIn

    def _each(self, name: str, test: Callable[[Column], Column], empty: bool) -> Column:
        values = self.v.field(name).value()
        every = F.forall(values, lambda x: sure(test(x)))
        return every if empty else (F.size(values) > 0) & every

    def _field(self, name: str, test: Callable[[Column], Column], empty: bool = False) -> Column:
        """A test on a scalar, or on every element of a list."""
        f = self.v.field(name)
        return self._each(name, test, empty) if f.is_list else test(f.value())

    # extensions
    @staticmethod
    def _ext(test) -> Column:
        return F.exists("extensions", test)

    def ExtPresent(self, oid):
        return self._ext(lambda e: e["oid"] == oid)

    def HasAnyExtension(self):
        return F.size("extensions") > 0

    def ExtCritical(self, oid):
        return self._ext(lambda e: (e["oid"] == oid) & e["critical"])

    def ExtNotCritical(self, oid):
        return self._ext(lambda e: (e["oid"] == oid) & ~e["critical"])

    def ExtContentNonEmpty(self, oid):
        return F.try_element_at("ext_content_count", F.lit(oid)) > 0

    def ExtRawValueEqualsHex(self, oid, h):
        return self._ext(lambda e: (e["oid"] == oid) & (e["value"] == F.lit(bytes.fromhex(h))))

    def ExtRawValueContainsHex(self, oid, h):
        return self._ext(lambda e: (e["oid"] == oid) & F.contains(e["value"], F.lit(bytes.fromhex(h))))

    def ExtSubfieldPresent(self, oid, tag, subfield, path):
        return F.exists(F.try_element_at("ext_context_tags", F.lit(oid)), lambda t: (t["tag"] == tag) & (t["path"] == path))

    def ExtensionURISchemeNotInSet(self, schemes):
        bad = lambda u: F.lower(F.substring_index(u, ":", 1)).isin(*[s.lower() for s in schemes]) & F.contains(u, F.lit(":"))
        return ~sure(F.exists("ext_uris", bad))

    def ExtHasGeneralNameWithTag(self, oid, tag):
        names = F.try_element_at("general_names", F.lit(oid))
        ia5 = lambda g: ~F.hex(g["value"]).rlike("^(..)*[89A-F]")
        return names.isNotNull() & F.forall(F.filter(names, lambda g: g["tag"] == tag), ia5)

    def ExtHasAnyGeneralNameOfTag(self, oid, tag):
        return F.exists(F.try_element_at("general_names", F.lit(oid)), lambda g: g["tag"] == tag)

    # roles
    def IsCA(self):
        return F.col("is_ca") & F.col("basic_constraints_valid")

    def IsRootCA(self):
        return F.col("is_ca") & F.col("self_signed")

    def IsSubCA(self):
        return F.col("is_ca") & ~F.col("self_signed")

    def PathLenConstraintPresent(self):
        return (F.col("max_path_len") > 0) | F.col("max_path_len_zero")

    def IsServerCert(self):
        return F.array_contains("ext_key_usage", "serverAuth")

    def IsSubscriberCert(self):
        return ~sure(F.col("is_ca"))

    IsEndEntity = IsSubscriberCert

    def KeyUsageHas(self, bit):
        return F.col("key_usage").bitwiseAND(F.lit(self.v.key_usage[bit])) != 0

    def ExtKeyUsageHas(self, bit):
        return F.array_contains("ext_key_usage", bit)

    def PublicKeyAlgorithmIs(self, algorithm):
        return F.col("public_key_algorithm").isin(*[a.strip() for a in algorithm.split("|")])

    # fields
    def FieldEq(self, name, value):
        f = self.v.field(name)
        if f.is_list:
            return (F.size(f.value()) == 1) & (F.get(f.value(), F.lit(0)) == F.lit(value))
        return f.value() == F.lit(value)

    def FieldNonEmpty(self, name):
        f = self.v.field(name)
        c = f.value()
        if f.is_list:
            return F.size(c) > 0
        if f.kind == "dn":
            return F.size(c["rdns"]) > 0
        if f.kind in ("bytes", "bigint"):
            return F.length(c) > 0
        if f.kind == "date":
            return c.isNotNull()
        return c if f.kind == "bool" else c != (0 if f.kind == "int" else "")

    def FieldEmpty(self, name):
        return ~sure(self.FieldNonEmpty(name))

    def FieldMatchesRegex(self, name, pattern):
        return self._field(name, lambda x: x.rlike(self.v.regex(pattern)))

    def FieldNotMatchesRegex(self, name, pattern):
        return self._field(name, lambda x: ~x.rlike(self.v.regex(pattern)))

    def FieldInSet(self, name, values):
        return self._field(name, lambda x: x.isin(*values))

    def FieldNotInSet(self, name, values):
        return self._field(name, lambda x: ~x.isin(*values), empty=True)

    def FieldContains(self, name, substring):
        return self._field(name, lambda x: F.contains(x, F.lit(substring)))

    def FieldLenInRange(self, name, lo, hi):
        f = self.v.field(name)
        return within(F.size(f.value()) if f.is_list else F.octet_length(f.value()), lo, hi)

    def FieldNumericInRange(self, name, lo, hi):
        f = self.v.field(name)
        if f.kind == "bigint":  # big-endian magnitude: compared as hexadecimal digits of equal length
            return self._big(f.value(), lo, hi)
        return within(f.value(), lo, hi)

    @staticmethod
    def _big(c, lo, hi):
        digits = F.regexp_replace(F.hex(c), "^0+", "")
        def least(n):
            h = format(n, "X") if n else ""
            return (F.length(digits) > len(h)) | ((F.length(digits) == len(h)) & (digits >= h))
        return least(lo) if hi == INF else least(lo) & ~least(hi + 1)

    def FieldCount(self, name, lo, hi):
        return within(F.size(self.v.field(name).value()), lo, hi)

    def FieldEncodedAs(self, name, types):
        if name in self.v.holders:
            flat = F.flatten(F.col(f"{name}.rdns"))
            return (F.size(flat) > 0) & F.forall(flat, lambda a: a["tag"].isin(*[STRING_TAGS[t] for t in types]))
        def fits(x):
            out = F.lit(False)
            for t in types:
                out = out | (x.rlike(CHARSETS[t]) if t in CHARSETS else F.lit(True))
            return out
        return self._field(name, fits)

    def DNDirectoryStringValuesEncodedAs(self, holder, types):
        flat = F.filter(F.flatten(F.col(f"{holder}.rdns")), lambda a: a["oid"].isin(*DIRECTORY_STRINGS))
        return F.forall(flat, lambda a: a["tag"].isin(*[STRING_TAGS[t] for t in types]))

    def CrossFieldEq(self, a, b):
        return self.v.field(a).value() == self.v.field(b).value()

    BytesEq = CrossFieldEq

    def _date(self, name):
        return self.v.field(name).value() if name in self.v.fields else F.lit(name).cast("timestamp")

    def DateAfter(self, later, earlier):
        return self._date(later) > self._date(earlier)

    def DateBefore(self, earlier, later):
        return self._date(earlier) < self._date(later)

    # lists
    def ListAllMatch(self, name, p):
        return self._each(name, lambda x: self(p, x), empty=False)

    def ListAnyMatch(self, name, p):
        return F.exists(self.v.field(name).value(), lambda x: self(p, x))

    SubtreeStringListAllMatch = ListAllMatch
    SubtreeStringListAnyMatch = ListAnyMatch

    def SubtreeStringListAllMatchOrEmpty(self, name, p):
        return self._each(name, lambda x: self(p, x), empty=True)

    def ListUnique(self, name):
        c = self.v.field(name).value()
        return F.size(F.array_distinct(c)) == F.size(c)

    def WildcardFilter(self, name, prefix, p):
        return F.forall(F.filter(self.v.field(name).value(), lambda x: F.startswith(x, F.lit(prefix))), lambda x: self(p, x))

    def IPListAllOctetCount(self, name, n):
        return self._each(name, lambda x: F.length(x) == n, empty=True)

    def IPListAllOctetCountIn(self, name, counts):
        return self._each(name, lambda x: F.length(x).isin(*counts), empty=True)

    def IPv4Conditional(self, name, p4, p6):
        return self._each(name, lambda x: F.when(F.length(x) == 4, self(p4, x)).when(F.length(x) == 16, self(p6, x)).otherwise(True), empty=True)

    def ScalarInList(self, name, values):
        return self.ScalarInAnyOfLists(name, (values,))

    def ScalarInAnyOfLists(self, name, lists):
        c = self.v.field(name).value()
        out = c == ""
        for n in lists:
            out = out | F.exists(self.v.field(n).value(), lambda x: x == c)
        return out

    def OidListContains(self, name, oid):
        return F.array_contains(self.v.field(name).value(), oid)

    def OidListCountInSet(self, name, allowed, lo, hi):
        return within(F.size(F.filter(self.v.field(name).value(), lambda x: x.isin(*allowed))), lo, hi)

    def OidEq(self, name, oid):
        return self.v.field(name).value() == oid

    # bytes
    def BytesEqualsHex(self, name, h):
        return self.v.field(name).value() == F.lit(bytes.fromhex(h))

    def BytesContainsHex(self, name, h):
        return F.contains(self.v.field(name).value(), F.lit(bytes.fromhex(h)))

    def BytesContainsOidDer(self, name, oid):
        return F.contains(self.v.field(name).value(), F.lit(encoded_oid(oid)))

    # address subtrees
    @staticmethod
    def _octets(x):
        return F.length(x["ip"]) + F.length(x["mask"])

    @staticmethod
    def _zero(x):
        return ~F.concat(F.hex(x["ip"]), F.hex(x["mask"])).rlike("[^0]")

    def SubtreeIPListAnyHasOctetCount(self, name, n):
        return F.exists(self.v.field(name).value(), lambda x: self._octets(x) == n)

    def SubtreeIPListAnyAllZero(self, name, n):
        return F.exists(self.v.field(name).value(), lambda x: (self._octets(x) == n) & self._zero(x))

    def SubtreeIPListAnyHasOctetCountAndNotAllZero(self, name, n):
        return F.exists(self.v.field(name).value(), lambda x: (self._octets(x) == n) & ~self._zero(x))

    def SubtreeIPListAllOctetCountIn(self, name, counts):
        return self._each(name, lambda x: self._octets(x).isin(*counts), empty=True)

    def SubtreeIPMaskValidCIDR(self, name):
        return self._each(name, lambda x: F.hex(x["mask"]).rlike("^F*[FEC8]?0*$"), empty=True)

    def SubtreeIPv4Conditional(self, name, p4, p6):
        return self._each(name, lambda x: F.when(self._octets(x) == 8, self(p4, x["ip"])).when(self._octets(x) == 32, self(p6, x["ip"])).otherwise(True), empty=True)

    # access descriptions, distribution points, policies
    def _access(self, oid):
        return F.try_element_at("access_descriptions", F.lit(oid))

    def AIAHasMethodOtherThan(self, oid, allowed):
        return F.exists(self._access(oid), lambda a: ~a["method"].isin(*allowed))

    def AIAMethodLocationsTagInSet(self, oid, method, tags):
        a = self._access(oid)
        return a.isNull() | F.forall(F.filter(a, lambda x: x["method"] == method), lambda x: x["tag"].isin(*tags))

    def AIAMethodLocationsAnyMatchRegex(self, oid, method, pattern):
        return F.exists(self._access(oid), lambda a: (a["method"] == method) & a["location"].rlike(self.v.regex(pattern)))

    def CRLDPHasNameRelative(self):
        return F.exists("crl_points", lambda d: d["name_relative"])

    def CRLDPHasNameRelativeWithMultiIssuer(self):
        return F.exists("crl_points", lambda d: d["name_relative"] & (d["n_issuer"] > 1))

    def CertPolicyExplicitTextHasEncodingTagInSet(self, tags):
        return F.exists("notice_text_tags", lambda t: t.isin(*tags))

    def PolicyQualifierOIDInSet(self, oid):
        return F.exists("policy_qualifiers", lambda q: q == oid)

    def PolicyQualifierOIDNotInSet(self, oid):
        return ~sure(self.PolicyQualifierOIDInSet(oid))

    # names
    def DNEmpty(self, holder):
        return F.size(F.col(f"{holder}.rdns")) == 0

    def RDNCountInRange(self, holder, lo, hi):
        return within(F.size(F.col(f"{holder}.rdns")), lo, hi)

    def RDNHasSingleAttribute(self, holder):
        return F.forall(F.col(f"{holder}.rdns"), lambda r: F.size(r) == 1)

    @staticmethod
    def _first(holder, oid):
        return F.array_min(F.filter(F.transform(F.col(f"{holder}.rdns"), lambda r, i: F.when(F.exists(r, lambda a: a["oid"] == oid), i)), lambda i: i.isNotNull()))

    def RDNSequenceHasCountryBefore(self, holder):
        return F.coalesce(self._first(holder, "2.5.4.6") < self._first(holder, "2.5.4.8"), F.lit(True))

    def DomainComponentOrdered(self):
        dc = F.transform(F.col("subject.rdns"), lambda r: F.exists(r, lambda a: a["oid"] == "0.9.2342.19200300.100.1.25"))
        # contiguous up to the end: once one has been seen all that follow are domain components
        marks = F.array_join(F.transform(dc, lambda x: F.when(x, "1").otherwise("0")), "")
        return marks.rlike("^0*1*$")

    def CommonNameFromSAN(self):
        cn = self.v.field("common_name").value()
        return (cn == "") | F.array_contains("dns_names", cn) | F.exists("ip_texts", lambda x: x == cn)

    # numbers, dates, algorithms
    def RSAModulusBitsInRange(self, lo, hi):
        return F.col("rsa_bits").isNull() | within(F.col("rsa_bits"), lo, hi)

    def RSAPublicExponentInRange(self, lo, hi):
        return F.col("rsa_exp").isNull() | within(F.col("rsa_exp"), lo, hi)

    def SigAlgMatchesTBSSignature(self):
        return F.coalesce(F.col("sig_alg_raw") == F.col("tbs_sig_alg_raw"), F.lit(True))

    def NotAfterIsNoExpirySentinel(self):
        return F.col("not_after") == F.lit(NO_EXPIRY).cast("timestamp")

    def ValidityDateAsn1TagInSet(self, name, tags):
        return F.col(f"{name}_tag").isin(*tags)

    def SerialNumberPositive(self):
        return F.col("serial_sign") > 0

    def SerialNumberOctetLengthInRange(self, lo, hi):
        return within(F.length("serial"), lo, hi)


def compile_tree(node: Node, vocabulary: Vocabulary) -> Column:
    return Compiler(vocabulary)(node)


