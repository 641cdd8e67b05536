import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from rulemill.sources import readers


@pytest.mark.skipif(not shutil.which("openssl"), reason="no openssl")
def test_certificates(spark, tmp_path):
    from rulemill.plans import CERTIFICATE, compile_tree, parse
    from rulemill.sources.der import parsed

    ext = ["subjectAltName=DNS:a.org,DNS:*.b.org,IP:1.2.3.4,email:x@a.org,URI:http://u", "keyUsage=critical,digitalSignature,keyEncipherment", "extendedKeyUsage=serverAuth", "basicConstraints=critical,CA:TRUE,pathlen:0", "authorityInfoAccess=OCSP;URI:http://o", "crlDistributionPoints=URI:http://c", "certificatePolicies=2.23.140.1.2.1", "nameConstraints=permitted;DNS:a.org,excluded;IP:10.0.0.0/255.0.0.0"]
    args = [a for e in ext for a in ("-addext", e)]
    subprocess.run(["openssl", "req", "-x509", "-newkey", "rsa:2048", "-nodes", "-keyout", str(tmp_path / "k"), "-out", str(tmp_path / "c.pem"), "-days", "90", "-subj", "/C=DE/ST=BY/O=Org/CN=a.org", *args], check=True, capture_output=True)
    (tmp_path / "bad.pem").write_text("-----BEGIN CERTIFICATE-----\nAAAA\n-----END CERTIFICATE-----\n")
    rows = parsed(readers.pem_certificates(spark, str(tmp_path))).orderBy("path").collect()
    assert [r.parse_ok for r in rows] == [False, True]
    c = rows[1]
    assert (c.version, c.rsa_bits, c.rsa_exp, c.is_ca, c.self_signed, c.max_path_len_zero, c.key_usage, c.validity_period) == (3, 2048, 65537, True, True, True, 5, 90)
    assert c.dns_names == ["a.org", "*.b.org"] and c.ip_texts == ["1.2.3.4"] and c.emails == ["x@a.org"] and c.common_name == "a.org" and c.ext_key_usage == ["serverAuth"]
    assert c.policy_oids == ["2.23.140.1.2.1"] and c.permitted_dns == ["a.org"] and c.excluded_ips[0].mask == b"\xff\x00\x00\x00" and c.crl_points[0].n_issuer == 0
    trees = [("IsRootCA", []), ("SigAlgMatchesTBSSignature", []), ("CommonNameFromSAN", []), ("RDNSequenceHasCountryBefore", ["subject"]), ("SubtreeIPMaskValidCIDR", ["excluded_ips"]), ("SerialNumberPositive", [])]
    cols = [compile_tree(parse({"op": o, "args": a}), CERTIFICATE).alias(o) for o, a in trees]
    got = parsed(readers.pem_certificates(spark, str(tmp_path))).where("parse_ok").select(*cols).first()
    assert all(got)


def test_text_sources(spark, tmp_path):
    (tmp_path / "lint.go").write_text('lint.Register(&lint.X{ Name: "e_rule", Citation: "BR: 7.1", Source: lint.CABF })')
    (tmp_path / "t_test.go").write_text('TestLint("e_rule", "ok.pem") // lint.Pass\n TestLint("e_rule", "bad.pem") // lint.Error')
    got = readers.lint_catalogue(spark, str(tmp_path / "lint.go")).first()
    assert (got.lint_name, got.citation, got.source) == ("e_rule", "BR: 7.1", "CABF")
    e = [(r.lint, r.cert, r.status) for r in readers.test_expectations(spark, str(tmp_path / "t_test.go")).collect()]
    assert e == [("e_rule", "ok.pem", "pass"), ("e_rule", "bad.pem", "error")]
    (tmp_path / "x.jsonl").write_text(json.dumps({"a": 1}) + "\nbroken\n")
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int, _corrupt_record string").where("a is null").count() == 1


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    readers.overwrite_partition(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), p, "k")
    readers.overwrite_partition(spark.createDataFrame([(2, "c")], "k int, v string"), p, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(p).collect()} == {(1, "a"), (2, "c")}
    n, e = spark.createDataFrame([(1, "x")], "id int, node_type string"), spark.createDataFrame([(1, 1, "r")], "src int, dst int, relation string")
    readers.save_graph(n, e, str(tmp_path / "g"))
    assert [d.count() for d in readers.load_graph(spark, str(tmp_path / "g"))] == [1, 1]
    known = spark.createDataFrame([("u",)], "url string").select("url", F.sha2(F.lit("x"), 256).alias("sha256"))
    assert [r.content for r in readers.changed(spark.createDataFrame([("u", "x"), ("u", "y")], "url string, content string"), known).collect()] == ["y"]
    assert "| 1 | x |" in readers.markdown_report("T", {"nodes": n})
