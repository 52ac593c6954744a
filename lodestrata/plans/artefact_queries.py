"""Queries over files that are made of the test tables' rows: templates and elements, nested modules, old lock files, executables,
certificates and images; with the SQL that states what is found."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binaries, calls, config, dependencies, images
from . import derive
from .scans import _files

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS shape, p_size AS v FROM part), f(file, line, algorithm, language) AS (
SELECT 'r' || id || '/view.jsx', 2, CASE WHEN v % 2 = 0 THEN 'MD5' ELSE 'SHA-1' END, 'javascript' FROM p WHERE shape = 0
UNION ALL SELECT 'r' || id || '/view.jsx', 3, 'SHA-256', 'javascript' FROM p WHERE shape = 0
UNION ALL SELECT 'r' || id || '/text.mjs', 2, 'SHA-512', 'javascript' FROM p WHERE shape = 1
UNION ALL SELECT 'r' || id || '/text.mjs', 3, 'MD5', 'javascript' FROM p WHERE shape = 1 AND v % 3 = 0
UNION ALL SELECT 'r' || id || '/cast.ts', 2, 'RSA', 'typescript' FROM p WHERE shape = 2
) SELECT * FROM f""")
def template_and_element_calls(spark, d):
    rows = derive.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("shape"), F.col("p_size").alias("v"))
    v = F.col("v")
    names = ", ".join(f"n{k}" for k in range(250))
    files = _files(rows, [
        ("view.jsx", "import { " + names + ", createHash as h } from 'crypto';\nexport const A = () => <p title={h('", F.when(v % 2 == 0, "md5").otherwise("sha1"), "')}>h('sha512') it's</p>;\nconst b = <i>{x && <b>h('md5')</b>} {h(`sha256`)}</i>;\n"),
        ("text.mjs", "import c from 'node:crypto';\nconst a = `c.createHash('md5') ${c.createHash('sha512').update(`${y}`)} c.createHash('sha1')`;\n", F.when(v % 3 == 0, "").otherwise("/"), "/c.createHash('sha384')/.test(a) || c.createHash('md5');\n"),
        ("cast.ts", "import * as c from 'crypto'\nconst k = (<any>c).x, m = c.generateKeyPairSync<string>('rsa', {})\n"),
        ("none.jsx", "import c from 'crypto';\nexport const X = () => <p>c.createHash('md5')</p>\n"),
    ])
    return calls.java_js_findings(files.withColumnRenamed("path", "rel_path")).select("file", "line", "algorithm", "language")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 3 AS shape, o_custkey % 3 AS u FROM orders), f(file, algorithm, key_size, matched_call) AS (
SELECT 'r' || id || '/deep.tf', 'RSA', 1024, 'module.own.keys.nested.rsa_bits = 1024' FROM o WHERE shape = 0
UNION ALL SELECT 'r' || id || '/deep.tf', 'TLS', NULL, 'module.own.keys.list.insecure = True' FROM o WHERE shape = 0
UNION ALL SELECT 'r' || id || '/deep.tf', 'TLSv1.' || u, NULL, 'locals.nested.tls_version = TLSv1.' || u FROM o WHERE shape = 0
UNION ALL SELECT 'r' || id || '/wide.tf', 'RSA', 2048, 'resource.key.b.rsa_bits = 2048' FROM o WHERE shape = 1
) SELECT * FROM f""")
def nested_module_settings(spark, d):
    """Values that an expression makes are none: they can't be told from the file."""
    rows = derive.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("shape"), (F.col("o_custkey") % 3).cast("string").alias("u"))
    files = _files(rows, [
        ("deep.tf", 'module "own" "keys" {\n  nested { rsa_bits = 1024 }\n  nested { rsa_bits = var.weak ? 1024 : 2048 }\n  list = [for s in var.l : { insecure = true }]\n  list { insecure = true }\n}\n'.replace("  list = [for s in var.l : { insecure = true }]\n", "  made = [for s in var.l : { insecure = true }]\n") + 'locals {\n  nested = { tls_version = "TLSv1.', F.col("u"), '" }\n}\n'),
        ("wide.tf", 'resource "key" "a" { rsa_bits = 1000 + 24 }\nresource "key" "b" {\n  rsa_bits = 2048 # 1024\n  text = "${f("rsa_bits = 1024")}"\n}\n'),
        ("broken.tf", 'resource "key" "c" { rsa_bits = 1024 \n'),
    ])
    return config.config_findings(files).select("file", "algorithm", "key_size", "matched_call")


@query("""WITH p AS (SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS v, p_partkey % 2 AS shape FROM part), f(file, package_name, package_version) AS (
SELECT 'r' || id || '/package-lock.json', 'md5', v || '.0.1' FROM p
UNION ALL SELECT 'r' || id || '/package-lock.json', 'sha1', '1.1.' || v FROM p
UNION ALL SELECT 'r' || id || '/package-lock.json', 'node-forge', '0.' || v || '.0' FROM p WHERE shape = 1
) SELECT * FROM f""")
def old_lock_files(spark, d):
    rows = derive.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 2).alias("shape"), F.col("p_size").cast("string").alias("v"))
    head = ('{"name": "own", "lockfileVersion": 1, "dependencies": {"left-pad": {"version": "1.3.0", "dependencies": {"md5": {"version": "', F.col("v"), '.0.1", "dependencies": {"sha1": {"version": "1.1.', F.col("v"), '"}}}}}')
    files = _files(rows, [("package-lock.json", *head, "}}"), ("package-lock.json", *head, ', "node-forge": {"version": "0.', F.col("v"), '.0", "requires": {"x": "1"}}}}')])
    return dependencies.dependency_findings(files).select("file", "package_name", "package_version")


@query("""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 4 AS shape FROM supplier), f(file, matched_call, algorithm, detection_method) AS (
SELECT 'bin/' || id, '.dynsym:my_MD5_Init_' || id, 'MD5', 'binary_symbol_table' FROM s WHERE shape = 0
UNION ALL SELECT 'bin/' || id, '.dynsym:RC4', 'RC4', 'binary_symbol_table' FROM s WHERE shape = 0
UNION ALL SELECT 'bin/' || id, '.rodata+0x' || lower(hex(5 + length(CAST(id AS VARCHAR)))), 'AES', 'binary_constant_scan' FROM s WHERE shape = 1
) SELECT * FROM f""")
def executables_of_words(spark, d):
    """Files that begin as ELF and can't be parsed: their words are the symbols, the whole file is one section."""
    s = derive.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).alias("shape"))
    key, elf = F.col("id").cast("string"), F.lit(bytearray(b"\x7fELF"))
    content = (
        F.when(F.col("shape") == 0, F.concat(elf, F.concat(F.lit(" my_MD5_Init_"), key, F.lit(" XRC4X RC4 ")).cast("binary")))
        .when(F.col("shape") == 1, F.concat(elf, F.concat(F.lit(" "), key).cast("binary"), F.lit(bytearray(bytes.fromhex("637c777bf26b6fc53001672bfed7ab76")))))
        .when(F.col("shape") == 2, F.concat(elf, F.concat(F.lit(" nothing_"), key).cast("binary")))
        .otherwise(F.lit(bytearray(b" MD5_Init no executable")))
    )
    files = s.select(F.concat(F.lit("bin/"), key).alias("rel_path"), content.alias("content"))
    return binaries.binary_findings(files).select("file", "matched_call", "algorithm", "detection_method")


def _der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def _certificate(bits: int) -> bytes:
    """A certificate with an RSA key of so many bits and nothing else of interest."""
    number = lambda v: _der(2, v.to_bytes(v.bit_length() // 8 + 1, "big"))
    rsa, sha256 = bytes.fromhex("06092a864886f70d010101"), _der(0x30, bytes.fromhex("06092a864886f70d01010b"))
    key = _der(0x30, _der(0x30, rsa, _der(5)), _der(3, b"\0", _der(0x30, number((1 << bits) - 1), number(65537))))
    return _der(0x30, _der(0x30, _der(0xA0, number(2)), number(7), sha256, _der(0x30), _der(0x30), _der(0x30), key), sha256, _der(3, b"\0\1"))


_LAYERS = """WITH s AS (SELECT s_suppkey AS id, s_suppkey % 3 AS shape FROM supplier), f(image, file, algorithm, key_size, weak_by_default) AS (
SELECT 'i' || id, 'l0:libssl3', 'RSA', NULL, false FROM s
UNION ALL SELECT 'i' || id, 'l0:etc/tls/a.crt', 'RSA', 1024, true FROM s WHERE shape <> 1
UNION ALL SELECT 'i' || id, 'l1:etc/tls/b.der', 'RSA', 2048, false FROM s WHERE shape <> 2
) SELECT image, file, algorithm, CAST(key_size AS INT) AS key_size, weak_by_default FROM f"""


@query(_LAYERS)
def images_of_layers(spark, d):
    """Images of two layers: packages and certificates in the first, of which the second takes some away; one certificate lies in
    a folder that is left out, and one is broken."""
    s = derive.table(spark, d, "supplier").select(F.concat(F.lit("i"), "s_suppkey").alias("image"), (F.col("s_suppkey") % 3).alias("shape"))
    status = b"Package: libssl3\nStatus: install ok installed\nVersion: 3.0.2\n"
    pem = b"-----BEGIN CERTIFICATE-----\nabcde\n-----END CERTIFICATE-----\n"
    entry = lambda k, path, kind, content: F.struct(F.lit(f"l{k}").alias("layer"), F.lit(k).alias("layer_index"), F.lit(path).alias("path"), F.lit(kind).alias("kind"), F.lit(bytearray(content) if content is not None else None).cast("binary").alias("content"))
    always = [entry(0, "var/lib/dpkg/status", "FILE", status), entry(0, "etc/tls/a.crt", "FILE", _certificate(1024)), entry(0, "x/run/c.crt", "FILE", _certificate(1024)), entry(0, "etc/tls/d.pem", "FILE", pem)]
    more = F.when(F.col("shape") == 0, F.array(entry(1, "etc/tls/b.der", "FILE", _certificate(2048)))).when(F.col("shape") == 1, F.array(entry(1, "etc/tls/b.der", "FILE", _certificate(2048)), entry(1, "etc/tls/a.crt", "WHITEOUT", None))).otherwise(F.array(entry(1, "etc/other", "OPAQUE", None)))
    entries = s.select("image", F.explode(F.concat(F.array(*always), more)).alias("e")).select("image", "e.*")
    return images.image_findings(entries).select("image", "file", "algorithm", "key_size", "weak_by_default")
