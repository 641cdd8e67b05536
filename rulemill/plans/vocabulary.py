"""The closed vocabulary that predicate trees may name: fields with their kinds, bits, dates and regular expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALARS = {"string", "int", "bool", "date", "bytes", "bigint", "oid"}
LISTS = {"string_list", "oid_list", "ip_list", "subtree_list", "subtree_ip_list"}


@dataclass(frozen=True)
class Field:
    """``kind`` decides how an atom reads the column; zero values stand for what is absent."""

    kind: str
    column: Callable[[], Column]

    @property
    def is_list(self) -> bool:
        return self.kind in LISTS

    def value(self) -> Column:
        c = self.column()
        if self.kind == "string" or self.kind == "oid":
            return F.coalesce(c, F.lit(""))
        if self.kind == "int":
            return F.coalesce(c, F.lit(0))
        if self.kind == "bool":
            return F.coalesce(c, F.lit(False))
        if self.kind in ("bytes", "bigint"):
            return F.coalesce(c, F.lit(b""))
        if self.kind in ("string_list", "oid_list", "subtree_list"):
            return F.coalesce(c, F.array().cast("array<string>"))
        if self.kind == "ip_list":
            return F.coalesce(c, F.array().cast("array<binary>"))
        if self.kind == "subtree_ip_list":
            return F.coalesce(c, F.array().cast("array<struct<ip:binary,mask:binary>>"))
        return c


def col(name: str, kind: str) -> Field:
    return Field(kind, lambda: F.col(name))


@dataclass
class Vocabulary:
    fields: dict[str, Field]
    regexes: dict[str, str] = field(default_factory=dict)
    key_usage: dict[str, int] = field(default_factory=dict)
    holders: tuple[str, ...] = ("subject", "issuer")

    def field(self, name: str) -> Field:
        if name not in self.fields:
            raise ValueError(f"unknown field {name!r}")
        return self.fields[name]

    def regex(self, name: str) -> str:
        if name not in self.regexes:
            raise ValueError(f"unknown regular expression {name!r}")
        return self.regexes[name]


#: Bits of the key usage bitmap.
KEY_USAGE = {
    "digitalSignature": 1, "contentCommitment": 2, "keyEncipherment": 4, "dataEncipherment": 8, "keyAgreement": 16,
    "keyCertSign": 32, "cRLSign": 64, "encipherOnly": 128, "decipherOnly": 256,
}
#: Regular expressions by name (the common subset of RE2 and Java).
REGEXES = {
    "dns_name": r"^(\*\.)?([A-Za-z0-9_]([A-Za-z0-9_-]{0,61}[A-Za-z0-9_])?\.)*[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?$",
    "dns_label": r"^[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "uri_http": r"^https?://[^\s]+$",
    "ldap_uri": r"^ldaps?://[^\s]*$",
    "ipv4": r"^([0-9]{1,3}\.){3}[0-9]{1,3}$",
    "country_code": r"^[A-Z]{2}$",
    "printable": r"^[A-Za-z0-9 '()+,./:=?-]*$",
    "numeric": r"^[0-9 ]*$",
    "ascii": r"^[\x00-\x7F]*$",
    "visible": r"^[\x20-\x7E]*$",
    "leading_dot": r"^\.",
    "underscore": r"_",
    "wildcard": r"^\*\.",
}
#: Attribute types of a distinguished name.
DN_ATTRIBUTES = {
    "common_name": "2.5.4.3", "surname": "2.5.4.4", "serial_number": "2.5.4.5", "country": "2.5.4.6", "locality": "2.5.4.7",
    "province": "2.5.4.8", "street": "2.5.4.9", "organization": "2.5.4.10", "organizational_unit": "2.5.4.11", "title": "2.5.4.12",
    "postal_code": "2.5.4.17", "given_name": "2.5.4.42", "domain_component": "0.9.2342.19200300.100.1.25", "email_address": "1.2.840.113549.1.9.1",
}


def attributes(holder: str, oid: str) -> Column:
    """Values of a distinguished name's attribute, in order."""
    flat = F.flatten(F.col(f"{holder}.rdns"))
    return F.transform(F.filter(flat, lambda a: a["oid"] == oid), lambda a: a["value"])


def _dn_fields() -> dict[str, Field]:
    found = {}
    for holder in ("subject", "issuer"):
        found[holder] = Field("dn", lambda holder=holder: F.col(holder))
        for name, oid in DN_ATTRIBUTES.items():
            found[f"{holder}.{name}"] = Field("string_list", lambda holder=holder, oid=oid: attributes(holder, oid))
    return found


#: The record of a parsed certificate and the kinds of its fields.
RECORD_FIELDS = {
    "version": "int", "serial": "bigint", "key_usage": "int", "ext_key_usage": "oid_list", "is_ca": "bool", "basic_constraints_valid": "bool",
    "self_signed": "bool", "max_path_len": "int", "ski": "bytes", "aki": "bytes", "dns_names": "string_list", "emails": "string_list",
    "uris": "string_list", "ip_addresses": "ip_list", "policy_oids": "oid_list", "extension_oids": "oid_list", "not_before": "date", "not_after": "date",
    "validity_period": "int", "signature_oid": "oid", "public_key_algorithm": "string", "rsa_bits": "int", "common_name": "string", "ext_uris": "string_list",
    "permitted_dns": "subtree_list", "excluded_dns": "subtree_list", "permitted_ips": "subtree_ip_list", "excluded_ips": "subtree_ip_list",
    "subject_raw": "bytes", "issuer_raw": "bytes", "sig_alg_raw": "bytes", "tbs_sig_alg_raw": "bytes",
}
CERTIFICATE = Vocabulary({n: col(n, k) for n, k in RECORD_FIELDS.items()} | _dn_fields(), REGEXES, KEY_USAGE)
CERTIFICATE.fields["now"] = Field("date", F.current_timestamp)
