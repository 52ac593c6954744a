"""Scans of trees: engines, binding of calls, typing and redaction of paths, counts and gates."""

from lodestrata.operators import scan
from lodestrata.operators.calls import java_js_findings


def tree(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    return str(folder)


MIXED = {
    "legacy.py": "import hashlib\nhashlib.new('md5', b'x')\n",
    "src/Use.java": 'import javax.crypto.Cipher; class C { void run() throws Exception { Cipher.getInstance("DESede"); } }',
    "own.js": "const crypto = require('node:crypto'); crypto.createHash('sha256');\n",
    "alike.js": "const crypto = { createHash: () => undefined }; crypto.createHash('md5');\n",
    "requirements.txt": "pycrypto==2.6.1\n",
    "deploy/app.yaml": "tls_version: TLSv1.0\n",
}


def test_mixed_tree(spark, tmp_path):
    root = tree(tmp_path, MIXED)
    found, summary = scan.run_scan(spark, root, fail_on="CRITICAL")
    assert {(r.algorithm, r.risk_tier) for r in found.collect()} == {("MD5", "CRITICAL"), ("3DES", "HIGH"), ("SHA-256", "LOW")}
    s = summary.first()
    assert (s.total, s.CRITICAL, s.HIGH, s.MEDIUM, s.LOW, s.UNSCORED, s.violated) == (3, 1, 1, 0, 1, 0, True)
    more, summary = scan.run_scan(spark, root, types=("source", "dependency", "config"), shelf_life=20.0)
    rows = {r.file: r for r in more.collect()}
    assert rows["requirements.txt"].artifact_type == "DEPENDENCY_MANIFEST" and rows["deploy/app.yaml"].algorithm == "TLSv1.0" and rows["deploy/app.yaml"].risk_tier == "UNSCORED"
    assert rows["legacy.py"].assumption_source and rows["legacy.py"].source_context == "SOURCE" and summary.first().total == 5


def test_paths_elsewhere_are_redacted(spark):
    raw = spark.createDataFrame([("/root/a/x.py", "m", "ast", None, None, "MD5", None), ("/other/y.py", "m", "binary_symbol_table", None, None, "MD5", None), ("layer:/etc/z", "m", "x", "CONTAINER_LAYER", "layer:/etc/z", "MD5", None)], "file string, matched_call string, detection_method string, artifact_type string, artifact_ref string, algorithm string, key_size int")
    got = {(r.file, r.artifact_type, r.artifact_ref) for r in scan.prepare(raw, "/root/a").collect()}
    assert got == {("x.py", None, None), ("[redacted]", "BINARY", "m"), ("layer:/etc/z", "CONTAINER_LAYER", "layer:/etc/z")}


JS = r"""
import { createHash as make, createHmac } from "node:crypto";
import web, * as all from 'crypto';
const { createCipheriv: enc, generateKeyPairSync } = require('crypto');
// crypto.createHash('md5')
make('SHA-1'); createHmac("md5", k);
all.createSign('RSA-SHA256');
enc('des-ede3-cbc', k, iv);
generateKeyPairSync('rsa', { modulusLength: 1024 });
require("crypto").createHash(`sha512`);
window.crypto.subtle.generateKey({ name: "AES-GCM", length: 256 }, true, []);
crypto.subtle.digest('SHA-1', x);
make(name); other.createHash('md5');
"""
JAVA = """
import static java.security.MessageDigest.getInstance;
import java.security.KeyPairGenerator;
import javax.crypto.*;
class A { void f() { getInstance("MD5"); KeyPairGenerator.getInstance("RSA").initialize(2048);
  javax.crypto.Cipher.getInstance("AES/GCM/NoPadding"); Cipher.getInstance("DES"); /* Cipher.getInstance("RC4") */ } }
"""


def test_calls_are_bound_to_their_modules(spark):
    rows = [("a.mjs", ".mjs", bytearray(JS.encode())), ("A.java", ".java", bytearray(JAVA.encode())), ("t.tsx", ".tsx", bytearray(b"import c from 'crypto'\nc.createHash('md5')"))]
    got = {(r.file, r.line, r.algorithm, r.primitive, r.key_size) for r in java_js_findings(spark.createDataFrame(rows, "rel_path string, ext string, content binary")).collect()}
    assert got == {
        ("a.mjs", 6, "SHA-1", "hash", None),
        ("a.mjs", 6, "MD5", "mac", None),
        ("a.mjs", 7, "RSA", "signature", None),
        ("a.mjs", 8, "3DES", "block-cipher", None),
        ("a.mjs", 9, "RSA", "asymmetric-keygen", 1024),
        ("a.mjs", 10, "SHA-512", "hash", None),
        ("a.mjs", 11, "AES", "symmetric-keygen", 256),
        ("A.java", 5, "MD5", "hash", None),
        ("A.java", 5, "RSA", "pke", 2048),
        ("A.java", 6, "AES", "block-cipher", None),
        ("t.tsx", 2, "MD5", "hash", None),
    }


def test_configuration_of_a_tree(spark, tmp_path):
    files = {
        "k8s.yaml": "spec:\n  tls_version: TLSv1.0\n  minimum_version: '1.1'\n  cipher_suites: RC4-SHA:DES-CBC3-SHA\n---\nssl_verify: false\nrsa_bits: 1024\n",
        "only/comments.yaml": "# tls_version: TLSv1.0\ndescription: RC4 and MD5 are gone\nnot_rsa_bits: 1024\n",
        "broken.yaml": "a: [",
        "x.json": '["TLSv1.0"]',
        "dist/in.tf": 'locals {\n a = "${var.b}"\n}\nresource "r" "x" {\n rsa_bits = 1024\n list = [1, { insecure = true }]\n}\n',
        ".git/y.yaml": "tls_version: TLSv1.0\n",
    }
    rows = scan.tree_findings(spark, tree(tmp_path, files), ("config",)).collect()
    assert {(r.file, r.algorithm, r.key_size) for r in rows} == {("k8s.yaml", a, s) for a, s in (("TLSv1.0", None), ("TLSv1.1", None), ("RC4", None), ("DES", None), ("TLS", None), ("RSA", 1024))} | {("dist/in.tf", "RSA", 1024), ("dist/in.tf", "TLS", None)}
    assert {r.confidence_band for r in rows} == {"VERIFIED"}
