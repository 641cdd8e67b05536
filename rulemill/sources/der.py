"""Certificates from DER: a tag-length-value walk in plain Python, run once at ingest; lints then read native columns.

A broken certificate gives zero values and ``parse_ok`` false. Values that a field can't hold (serial numbers of up to
160 bits) stay bytes.
"""

from __future__ import annotations

import datetime as dt
import ipaddress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTR = "struct<oid:string,tag:int,value:string>"
DN = f"struct<raw:binary,rdns:array<array<{ATTR}>>>"
RECORD = (
    "parse_ok boolean, version int, serial binary, serial_sign int, not_before timestamp, not_after timestamp, not_before_tag int, not_after_tag int, validity_period int, key_usage int, ext_key_usage array<string>, "
    "is_ca boolean, basic_constraints_valid boolean, self_signed boolean, max_path_len int, max_path_len_zero boolean, ski binary, aki binary, dns_names array<string>, emails array<string>, uris array<string>, "
    "ip_addresses array<binary>, ip_texts array<string>, policy_oids array<string>, policy_qualifiers array<string>, notice_text_tags array<int>, extension_oids array<string>, "
    "extensions array<struct<oid:string,critical:boolean,value:binary>>, ext_content_count map<string,int>, ext_context_tags map<string,array<struct<path:string,tag:int>>>, ext_uris array<string>, "
    "general_names map<string,array<struct<tag:int,value:binary>>>, access_descriptions map<string,array<struct<method:string,tag:int,location:string>>>, crl_points array<struct<name_relative:boolean,n_issuer:int>>, "
    f"subject {DN}, issuer {DN}, permitted_dns array<string>, excluded_dns array<string>, permitted_ips array<struct<ip:binary,mask:binary>>, excluded_ips array<struct<ip:binary,mask:binary>>, "
    "subject_raw binary, issuer_raw binary, sig_alg_raw binary, tbs_sig_alg_raw binary, signature_oid string, public_key_algorithm string, rsa_bits int, rsa_exp long, common_name string"
)
#: Object identifiers of extensions, key purposes and key algorithms.
BASIC, KEY_USAGE, EKU, SAN, IAN, NAMES, CRL, POLICIES, SKI, AKI, AIA, SIA = (
    "2.5.29.19", "2.5.29.15", "2.5.29.37", "2.5.29.17", "2.5.29.18", "2.5.29.30", "2.5.29.31", "2.5.29.32", "2.5.29.14", "2.5.29.35", "1.3.6.1.5.5.7.1.1", "1.3.6.1.5.5.7.1.11",
)
PURPOSES = {"1.3.6.1.5.5.7.3.1": "serverAuth", "1.3.6.1.5.5.7.3.2": "clientAuth", "1.3.6.1.5.5.7.3.3": "codeSigning", "1.3.6.1.5.5.7.3.4": "emailProtection", "1.3.6.1.5.5.7.3.8": "timeStamping", "1.3.6.1.5.5.7.3.9": "OCSPSigning", "2.5.29.37.0": "any"}
ALGORITHMS = {"1.2.840.113549.1.1.1": "RSA", "1.2.840.10045.2.1": "ECDSA", "1.3.101.112": "Ed25519", "1.2.840.10040.4.1": "DSA"}


def tlv(data: bytes, at: int = 0) -> tuple[int, bytes, bytes, int]:
    """(tag, content, whole, next place) of the element at ``at``."""
    tag, n, head = data[at], data[at + 1], 2
    if n & 0x80:
        k = n & 0x7F
        if not k or k > 4:
            raise ValueError("length")
        n, head = int.from_bytes(data[at + 2 : at + 2 + k], "big"), 2 + k
    end = at + head + n
    if end > len(data):
        raise ValueError("short")
    return tag, data[at + head : end], data[at:end], end


def elements(content: bytes) -> list[tuple[int, bytes, bytes]]:
    out, at = [], 0
    while at < len(content):
        tag, body, whole, at = tlv(content, at)
        out.append((tag, body, whole))
    return out


def oid_text(body: bytes) -> str:
    numbers, n = [], 0
    for b in body:
        n = n << 7 | b & 0x7F
        if not b & 0x80:
            numbers.append(n)
            n = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, [first, numbers[0] - 40 * first, *numbers[1:]]))


def moment(tag: int, body: bytes) -> dt.datetime:
    s = body.decode("ascii").rstrip("Z")
    if tag == 23:
        s = ("19" if int(s[:2]) >= 50 else "20") + s
    return dt.datetime.strptime(s.ljust(14, "0")[:14], "%Y%m%d%H%M%S")


def string_value(tag: int, body: bytes) -> str:
    return body.decode({30: "utf-16-be", 28: "utf-32-be", 12: "utf-8"}.get(tag, "latin-1"), "replace")


def name(body: bytes, whole: bytes) -> dict:
    rdns = []
    for _, rdn, _ in elements(body):
        rdns.append([{"oid": oid_text(o[1]), "tag": v[0], "value": string_value(v[0], v[1])} for o, v in (elements(a)[:2] for _, a, _ in elements(rdn))])
    return {"raw": whole, "rdns": rdns}


def _general_names(body: bytes) -> list[dict]:
    return [{"tag": t & 0x1F, "value": b} for t, b, _ in elements(body)]


def _context_tags(value: bytes) -> list[dict]:
    out = []

    def walk(body, path):
        for t, b, _ in elements(body):
            if t & 0xC0 == 0x80:
                out.append({"path": path, "tag": t & 0x1F})
            if t & 0x20:
                walk(b, f"{path}/{t & 0x1F}" if path else str(t & 0x1F)) if t & 0xC0 == 0x80 else walk(b, path)

    walk(tlv(value)[1], "")
    return out


def empty() -> dict:
    r = {
        "parse_ok": False, "version": 0, "serial": b"", "serial_sign": 0, "not_before": None, "not_after": None, "not_before_tag": 0, "not_after_tag": 0, "validity_period": 0, "key_usage": 0, "is_ca": False,
        "basic_constraints_valid": False, "self_signed": False, "max_path_len": -1, "max_path_len_zero": False, "ski": b"", "aki": b"", "subject": {"raw": b"", "rdns": []}, "issuer": {"raw": b"", "rdns": []},
        "subject_raw": b"", "issuer_raw": b"", "sig_alg_raw": b"", "tbs_sig_alg_raw": b"", "signature_oid": "", "public_key_algorithm": "", "rsa_bits": None, "rsa_exp": None, "common_name": "",
    }
    lists = "ext_key_usage dns_names emails uris ip_addresses ip_texts policy_oids policy_qualifiers notice_text_tags extension_oids extensions ext_uris crl_points permitted_dns excluded_dns permitted_ips excluded_ips"
    return r | {k: [] for k in lists.split()} | {k: {} for k in ("ext_content_count", "ext_context_tags", "general_names", "access_descriptions")}


def _extension(r: dict, oid: str, value: bytes) -> None:
    tag, body, _, _ = tlv(value)
    if tag == 0x30:
        r["ext_content_count"][oid] = len(elements(body))
        r["ext_context_tags"][oid] = _context_tags(value)
    if oid == BASIC:
        parts = elements(body)
        r["basic_constraints_valid"] = True
        r["is_ca"] = any(t == 1 and b != b"\x00" for t, b, _ in parts)
        for t, b, _ in parts:
            if t == 2:
                r["max_path_len"] = int.from_bytes(b, "big")
                r["max_path_len_zero"] = r["max_path_len"] == 0
    elif oid == KEY_USAGE:
        bits = "".join(f"{x:08b}" for x in body[1:])
        r["key_usage"] = sum(1 << i for i, c in enumerate(bits[:9]) if c == "1")
    elif oid == EKU:
        r["ext_key_usage"] = [PURPOSES.get(o, o) for o in (oid_text(b) for _, b, _ in elements(body))]
    elif oid == SKI:
        r["ski"] = body
    elif oid == AKI:
        r["aki"] = next((b for t, b, _ in elements(body) if t & 0x1F == 0), b"")
    elif oid in (SAN, IAN):
        names = r["general_names"][oid] = _general_names(body)
        if oid == SAN:
            text = lambda t: [n["value"].decode("latin-1") for n in names if n["tag"] == t]
            r["emails"], r["dns_names"], r["uris"] = text(1), text(2), text(6)
            r["ip_addresses"] = [n["value"] for n in names if n["tag"] == 7]
            r["ip_texts"] = [str(ipaddress.ip_address(b)) for b in r["ip_addresses"] if len(b) in (4, 16)]
        r["ext_uris"] += [n["value"].decode("latin-1") for n in names if n["tag"] == 6]
    elif oid in (AIA, SIA):
        out = r["access_descriptions"][oid] = []
        for _, a, _ in elements(body):
            (_, m, _), (t, loc, _) = elements(a)[:2]
            out.append({"method": oid_text(m), "tag": t & 0x1F, "location": loc.decode("latin-1")})
        r["ext_uris"] += [a["location"] for a in out if a["tag"] == 6]
    elif oid == CRL:
        for _, point, _ in elements(body):
            relative, issuers = False, 0
            for t, b, _ in elements(point):
                if t & 0x1F == 0:
                    for u, c, _ in elements(b):
                        relative |= u & 0x1F == 1
                        r["ext_uris"] += [x["value"].decode("latin-1") for x in _general_names(c) if x["tag"] == 6] if u & 0x1F == 0 else []
                elif t & 0x1F == 2:
                    issuers = len(elements(b))
            r["crl_points"].append({"name_relative": relative, "n_issuer": issuers})
    elif oid == POLICIES:
        for _, info, _ in elements(body):
            parts = elements(info)
            r["policy_oids"].append(oid_text(parts[0][1]))
            for _, q, _ in (elements(parts[1][1]) if len(parts) > 1 else []):
                own = elements(q)
                r["policy_qualifiers"].append(oid_text(own[0][1]))
                if own[1][0] == 0x30:
                    r["notice_text_tags"] += [t for t, _, _ in elements(own[1][1]) if t != 0x30]
    elif oid == NAMES:
        for t, trees, _ in elements(body):
            side = "permitted" if t & 0x1F == 0 else "excluded"
            for _, sub, _ in elements(trees):
                u, b, _ = elements(sub)[0]
                if u & 0x1F == 2:
                    r[f"{side}_dns"].append(b.decode("latin-1"))
                elif u & 0x1F == 7:
                    r[f"{side}_ips"].append({"ip": b[: len(b) // 2], "mask": b[len(b) // 2 :]})


def certificate(der: bytes | None) -> dict:
    r = empty()
    try:
        parts = elements(tlv(der or b"")[1])
        tbs = elements(parts[0][1])
        r["version"] = 1
        if tbs[0][0] == 0xA0:
            r["version"] = tlv(tbs[0][1])[1][0] + 1
            tbs = tbs[1:]
        serial = tbs[0][1]
        r["serial"] = serial.lstrip(b"\x00") or b"\x00"
        r["serial_sign"] = 0 if not any(serial) else -1 if serial[0] & 0x80 else 1
        r["tbs_sig_alg_raw"], r["sig_alg_raw"] = tbs[1][2], parts[1][2]
        r["signature_oid"] = oid_text(elements(parts[1][1])[0][1])
        r["issuer"], r["subject"] = name(tbs[2][1], tbs[2][2]), name(tbs[4][1], tbs[4][2])
        r["issuer_raw"], r["subject_raw"] = tbs[2][2], tbs[4][2]
        r["self_signed"] = tbs[2][2] == tbs[4][2]
        r["common_name"] = next((a["value"] for rdn in reversed(r["subject"]["rdns"]) for a in rdn if a["oid"] == "2.5.4.3"), "")
        (bt, bv, _), (at, av, _) = elements(tbs[3][1])
        r["not_before_tag"], r["not_after_tag"], r["not_before"], r["not_after"] = bt, at, moment(bt, bv), moment(at, av)
        r["validity_period"] = (r["not_after"] - r["not_before"]).days
        algorithm, key = elements(tbs[5][1])
        r["public_key_algorithm"] = ALGORITHMS.get(oid_text(elements(algorithm[1])[0][1]), "unknown")
        if r["public_key_algorithm"] == "RSA":
            modulus, exponent = elements(tlv(key[1][1:])[1])
            r["rsa_bits"], r["rsa_exp"] = int.from_bytes(modulus[1], "big").bit_length(), min(int.from_bytes(exponent[1], "big"), (1 << 63) - 1)
        for tag, body, _ in tbs[6:]:
            if tag == 0xA3:
                for _, e, _ in elements(tlv(body)[1]):
                    own = elements(e)
                    oid, value = oid_text(own[0][1]), own[-1][1]
                    r["extensions"].append({"oid": oid, "critical": any(t == 1 and b != b"\x00" for t, b, _ in own), "value": value})
                    r["extension_oids"].append(oid)
                    try:
                        _extension(r, oid, value)
                    except (ValueError, IndexError):
                        pass  # an extension that isn't DER is kept by its bytes alone
        r["parse_ok"] = True
    except (ValueError, IndexError, UnicodeDecodeError):
        return empty() | {k: r[k] for k in ("serial", "version")}
    return r


def parsed(rows: DataFrame, der: str = "der") -> DataFrame:
    """All columns and the certificate's, in one vectorised pass."""

    @F.pandas_udf(RECORD)
    def record(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([certificate(x) for x in s])

    return rows.withColumn("_c", record(F.col(der))).select(*rows.columns, "_c.*")
