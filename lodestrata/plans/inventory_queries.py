"""Queries over repositories, scans, findings, reports, agents and bills of materials, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import risk
from ..functions.confidence import legacy
from ..operators import bom, calls, inventory, packages, python_calls
from . import derive
from .scans import _files
from .tables_sql import SCORED_SQL

QUERIES: dict = {}
ORACLES: dict = {}
SCORED = f"{derive.FINDINGS_SQL}, {SCORED_SQL}"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _scored(spark, d):
    return risk.score_findings(derive.findings(spark, d))


ASSETS_SQL = """assets(asset, asset_primitive, functions) AS (VALUES ('MD5', 'hash', 'digest'), ('SHA-1', 'hash', 'digest'), ('SHA-256', 'hash', 'digest'), ('SHA-384', 'hash', 'digest'), ('SHA-512', 'hash', 'digest'), ('HMAC', 'mac', 'mac'),
  ('DES', 'blockCipher', 'encrypt,decrypt'), ('3DES', 'blockCipher', 'encrypt,decrypt'), ('RC4', 'streamCipher', 'encrypt,decrypt'), ('AES', 'blockCipher', 'encrypt,decrypt'), ('AES-256', 'blockCipher', 'encrypt,decrypt'),
  ('RSA', 'publicKeyEncryption', 'encapsulate,decapsulate,sign,verify'), ('ECC', 'other', 'keyGenerate,keyDerive'), ('DSA', 'signature', 'sign,verify'))"""


@query(f"""WITH {SCORED}, {ASSETS_SQL} SELECT scan_id AS scan, 'finding-' || id AS bom_ref, algorithm AS name, algorithm || coalesce('-' || key_size, '') AS version,
  algorithm || ' detected at ' || file || ':' || line || ' (confidence=' || CASE WHEN confidence_band = 'VERIFIED' THEN 'high' ELSE 'unverified' END || ')' AS description,
  coalesce(asset_primitive, 'other') AS primitive, coalesce(functions, '') AS functions, key_size, risk_tier, risk_reason,
  10 + (risk_reason IS NOT NULL)::INT + (recommended_replacement IS NOT NULL)::INT + (recommendation_type IS NOT NULL)::INT + (migration_effort_days IS NOT NULL)::INT + (data_shelf_life_years IS NOT NULL)::INT AS n_properties
  FROM scored LEFT JOIN assets ON algorithm = asset""")
def bom_components(spark, d):
    found = _scored(spark, d).withColumn("confidence", legacy(F.col("confidence_band")))
    c = F.col("component")
    return bom.components(found).select(
        "scan", c["bom-ref"].alias("bom_ref"), c["name"].alias("name"), c["version"].alias("version"), c["description"].alias("description"), F.col("component.cryptoProperties.algorithmProperties.primitive").alias("primitive"),
        F.array_join("component.cryptoProperties.algorithmProperties.cryptoFunctions", ",").alias("functions"), F.col("component.cryptoProperties.algorithmProperties.keySize").alias("key_size"), F.col("tier").alias("risk_tier"), F.col("reason").alias("risk_reason"), F.size("component.properties").alias("n_properties"),
    )


@query("""WITH o AS (SELECT c_custkey AS doc, c_custkey % 7 AS shape FROM customer)
SELECT doc, 'FIELD_INVALID_VALUE' AS code, '/bomFormat' AS path FROM o WHERE shape = 1
UNION ALL SELECT doc, 'FIELD_MISSING', '/version' FROM o WHERE shape = 2
UNION ALL SELECT doc, 'FIELD_WRONG_TYPE', '/components/0/name' FROM o WHERE shape = 3
UNION ALL SELECT doc, 'BOM_REF_DUPLICATE', '/components/1/bom-ref' FROM o WHERE shape = 4
UNION ALL SELECT doc, 'SUMMARY_TIER_MISMATCH', '/x-risk-summary/' || t FROM o, (VALUES ('HIGH'), ('LOW')) AS x(t) WHERE shape = 5
UNION ALL SELECT doc, 'NOT_JSON_SERIALIZABLE', '' FROM o WHERE shape = 6""")
def bom_issues(spark, d):
    o = derive.table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 7).alias("shape"), F.md5(F.col("c_custkey").cast("string")).alias("m"))
    o = derive.dealt(o, "doc")
    at = lambda k, damaged, fine: F.when(F.col("shape") == k, damaged).otherwise(fine)
    part = lambda ref, name: F.concat(F.lit('{"type": "cryptographic-asset", "bom-ref": "'), ref, F.lit('", "name": '), name, F.lit(', "cryptoProperties": {"assetType": "protocol"}, "evidence": {"occurrences": [{"location": "a"}]}, "properties": [{"name": "lodestrata:risk_tier", "value": "HIGH"}]}'))
    serial = F.concat_ws("-", *(F.substring("m", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    text = F.concat(
        F.lit('{"bomFormat": "'), at(1, "Other", "CycloneDX"), F.lit('", "specVersion": "1.6", "serialNumber": "urn:uuid:'), serial, F.lit('"'), at(2, "", ', "version": 1'), F.lit(', "metadata": {"timestamp": "2026-01-02T03:04:05", "tools": []}, "components": ['),
        part(F.lit("a"), at(3, "5", '"n"')), F.lit(", "), part(at(4, "a", "b"), F.lit('"m"')), F.lit('], "x-risk-summary": {"total": 2, "CRITICAL": 0, "HIGH": '), at(5, "1", "2"), F.lit(', "MEDIUM": 0, "LOW": '), at(5, "1", "0"), F.lit(', "UNSCORED": 0}'), at(6, "", "}"),
    )
    return bom.issues(o.select("doc", text.alias("text"))).select("doc", "code", "path")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS shape, p_size AS v FROM part), f(file, line, algorithm, primitive, library, key_size, language, weak_by_default, confidence_score) AS (
SELECT 'r' || id || '/Use.java', 3, 'RSA', 'pke', 'KeyPairGenerator', 1024 + v, 'java', false, 1.00 FROM p WHERE shape = 0
UNION ALL SELECT 'r' || id || '/Use.java', 4, CASE WHEN v % 2 = 0 THEN '3DES' ELSE 'DES' END, 'block-cipher', 'Cipher', NULL, 'java', true, 1.00 FROM p WHERE shape = 0
UNION ALL SELECT 'r' || id || '/use.mjs', 2, CASE WHEN v % 2 = 0 THEN 'MD5' ELSE 'SHA-512' END, 'hash', 'crypto', NULL, 'javascript', v % 2 = 0, 1.00 FROM p WHERE shape = 1
UNION ALL SELECT 'r' || id || '/use.ts', 2, 'RSA', 'asymmetric-keygen', 'crypto', 1024 + v, 'typescript', false, 1.00 FROM p WHERE shape = 2
) SELECT file, line, algorithm, primitive, library, CAST(key_size AS INT) AS key_size, language, weak_by_default, CAST(confidence_score AS DECIMAL(3, 2)) AS confidence_score FROM f""")
def java_js_calls(spark, d):
    rows = derive.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("shape"), F.col("p_size").alias("v"))
    even = F.col("v") % 2 == 0
    bits = (F.col("v") + 1024).cast("string")
    files = _files(rows, [
        ("Use.java", 'import java.security.KeyPairGenerator; import javax.crypto.Cipher;\nclass Use { void f() throws Exception {\n  KeyPairGenerator.getInstance("RSA").initialize(', bits, ');\n  Cipher.getInstance("', F.when(even, "DESede/CBC").otherwise("DES"), '"); // Cipher.getInstance("RC4")\n  other.getInstance("MD5"); } }\n'),
        ("use.mjs", 'import { createHash as h } from "node:crypto";\nexport const x = h(', F.when(even, "'md5'").otherwise('"sha512"'), ").update(y);\n/* h('sha1') */ h(name);\n"),
        ("use.ts", "const { generateKeyPairSync: gen } = require('crypto')\ngen('rsa', { modulusLength: ", bits, ", publicExponent: 3 })\n"),
        ("alike.js", "const crypto = { createHash: () => 1 };\ncrypto.createHash('md5');\n"),
    ])
    out = calls.java_js_findings(files.withColumnRenamed("path", "rel_path"))
    return out.select("file", "line", "algorithm", "primitive", "library", "key_size", "language", "weak_by_default", "confidence_score")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 3 AS shape, p_size AS v FROM part), f(file, line, algorithm, primitive, library, key_size, matched_call, confidence_score) AS (
SELECT 'r' || id || '/use.py', 2, CASE WHEN v % 2 = 0 THEN 'MD5' ELSE 'SHA-256' END, 'hash', 'hashlib', NULL, 'hashlib.' || CASE WHEN v % 2 = 0 THEN 'md5' ELSE 'sha256' END || '(b)', 0.90 FROM p WHERE shape = 0
UNION ALL SELECT 'r' || id || '/use.py', 3, 'SHA-1', 'mac', 'hmac', NULL, 'mac.new(k, m, digestmod=''sha1'')', 1.00 FROM p WHERE shape = 0
UNION ALL SELECT 'r' || id || '/keys.py', 2, 'RSA', 'asymmetric-keygen', 'cryptography', 1024 + v, 'rsa.generate_private_key(65537, key_size=' || (1024 + v) || ')', 1.00 FROM p WHERE shape = 1
UNION ALL SELECT 'r' || id || '/des.py', 2, '3DES', 'encrypt', 'PyCryptodome', NULL, 'D.new(k)', 1.00 FROM p WHERE shape = 2 AND v % 2 = 0
) SELECT file, line, algorithm, primitive, library, CAST(key_size AS INT) AS key_size, matched_call, CAST(confidence_score AS DECIMAL(3, 2)) AS confidence_score FROM f""")
def python_call_findings(spark, d):
    rows = derive.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("shape"), F.col("p_size").alias("v"))
    even = F.col("v") % 2 == 0
    files = _files(rows, [
        ("use.py", "import hashlib, hmac as mac\nhashlib.", F.when(even, "md5").otherwise("sha256"), "(b)  # hashlib.sha1(b)\nmac.new(k, m, digestmod='sha1')\nmac.new('sha1', m)\n"),
        ("keys.py", "from cryptography.hazmat.primitives.asymmetric import rsa\nrsa.generate_private_key(65537, key_size=", (F.col("v") + 1024).cast("string"), ")\n"),
        ("des.py", "from Crypto.Cipher import DES3 as D\n", F.when(even, "D.new(k)").otherwise("def ("), "\n"),
    ])
    out = python_calls.python_findings(files.withColumnRenamed("path", "rel_path"))
    return out.select("file", "line", "algorithm", "primitive", "library", "key_size", "matched_call", "confidence_score")


@query("""SELECT c_custkey AS agent_id, count(o_orderkey) AS report_count, max(o_orderdate) AS last_report_at, arg_max(o_orderkey, {'a': o_orderdate, 'b': o_orderkey}) AS last_report_id,
  CASE WHEN max(o_orderdate) IS NULL THEN 'never_reported' WHEN max(o_orderdate) >= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 2400 HOURS THEN 'recent' ELSE 'stale' END AS delivery_status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def agent_delivery(spark, d):
    reports = derive.table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("agent_id"), F.col("o_orderdate").alias("created_at"))
    agents = derive.table(spark, d, "customer").select(F.col("c_custkey").alias("agent_id"))
    out = inventory.agent_status(agents, reports, F.to_timestamp(F.lit("2001-08-02 00:00:00")), 2400)
    return out.select("agent_id", "report_count", "last_report_at", "last_report_id", "delivery_status")


@query("""WITH t AS (SELECT o_custkey % 97 AS f, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT l_orderkey AS scan_id, l_partkey AS part, l_suppkey % 120 AS fingerprint, status AS triage_status, count(*) AS n FROM lineitem LEFT JOIN t ON f = l_suppkey % 120 GROUP BY ALL""")
def triage_carried_forward(spark, d):
    found = derive.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_partkey").alias("part"), (F.col("l_suppkey") % 120).alias("fingerprint"))
    found = derive.dealt(found, "scan_id", "part", "fingerprint")
    triage = derive.table(spark, d, "orders").select((F.col("o_custkey") % 97).alias("fingerprint"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("triage_id"), F.col("o_orderstatus").alias("status"))
    return inventory.carried_triage(found, triage).groupBy("scan_id", "part", "fingerprint", "triage_status").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT s_suppkey AS repo_id, s_suppkey % 3 AS by, CASE s_suppkey % 3 WHEN 0 THEN 'o' || (s_nationkey % 5) WHEN 1 THEN 'u' || (s_nationkey % 5) ELSE 'n' || (s_nationkey % 5) END AS k FROM supplier),
i AS (SELECT c_custkey AS id, c_custkey % 3 AS by, CASE c_custkey % 3 WHEN 0 THEN 'o' || (c_nationkey % 6) WHEN 1 THEN 'u' || (c_nationkey % 6) ELSE 'n' || (c_nationkey % 6) END AS k FROM customer)
SELECT id, (SELECT min(repo_id) FROM k WHERE k.by = i.by AND k.k = i.k) AS repo_id FROM i""")
def repositories_resolved(spark, d):
    def shaped(table, key, nation, m):
        t = derive.table(spark, d, table)
        n, by = (F.col(nation) % m).cast("string"), F.col(key) % 3
        return t.select(F.col(key).alias("id"), F.when(by == 2, F.concat(F.lit("n"), n)).otherwise("same").alias("name"), F.when(by == 1, F.concat(F.lit("u"), n)).alias("url"), F.when(by == 0, "org").alias("organization_id"), F.when(by == 0, F.concat(F.lit("o"), n)).alias("external_id"))

    known = shaped("supplier", "s_suppkey", "s_nationkey", 5).withColumnRenamed("id", "repo_id")
    return inventory.resolve_repositories(shaped("customer", "c_custkey", "c_nationkey", 6), known).select("id", "repo_id")


@query(f"""WITH {SCORED}, {derive.SCANS_SQL}, t AS (SELECT s.scan_id, any_value(repo_id) AS repo_id, any_value(started_at) AS started_at, count(f.id) AS total, count(*) FILTER (risk_tier = 'CRITICAL') AS critical FROM scans s LEFT JOIN scored f ON f.scan_id = s.scan_id GROUP BY s.scan_id),
e AS (SELECT repo_id, arg_min({{'total': total, 'critical': critical}}, {{'a': started_at, 'b': scan_id}}) AS f, arg_max({{'total': total, 'critical': critical}}, {{'a': started_at, 'b': scan_id}}) AS l FROM t GROUP BY repo_id)
SELECT repo_id, f.total AS first_total, f.critical AS first_critical, l.total AS latest_total, l.critical AS latest_critical, l.total - f.total AS total_change, l.critical - f.critical AS critical_change FROM e""")
def first_and_latest_scan(spark, d):
    from .registry import trend_by_scan

    trend = trend_by_scan(spark, d).join(derive.scans(spark, d).select("scan_id", "started_at"), "scan_id")
    return inventory.first_and_latest(trend)


@query(f"WITH {SCORED}, t AS (SELECT language, CASE WHEN line % 5 > 0 THEN risk_tier END AS risk_tier FROM scored) SELECT language, count(risk_tier) AS total, " + ", ".join(f"count(*) FILTER (risk_tier = '{t}') AS \"{t}\"" for t in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "UNSCORED")) + " FROM t GROUP BY language")
def risk_distribution_by_language(spark, d):
    found = _scored(spark, d).withColumn("risk_tier", F.when(F.col("line") % 5 > 0, F.col("risk_tier")))
    return inventory.risk_distribution(found, "language")


@query(f"WITH {derive.SCANS_SQL} SELECT * FROM scans ORDER BY started_at DESC, scan_id DESC LIMIT 40")
def newest_scans(spark, d):
    return inventory.list_scans(derive.scans(spark, d), limit=40)


@query("""WITH e AS (SELECT user_id AS scan_id, arg_max({'s': CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END, 'at': ts}, {'a': ts, 'b': event_id}) AS x FROM events GROUP BY user_id)
SELECT scan_id, x.s AS status, x.at AS at FROM e""")
def current_scan_states(spark, d):
    state = F.col("event_type")
    state = F.when(state == "signup", "pending").when(state == "purchase", "completed").when(state == "error", "failed").when(state == "view", "running").otherwise(state)
    return inventory.current_scans(derive.table(spark, d, "events").select(F.col("user_id").alias("scan_id"), F.col("ts").alias("at"), F.col("event_id").alias("ordinal"), state.alias("status")))


@query("""SELECT event_id AS scan_id, CAST(0 AS INT) AS ordinal, 'f' || user_id AS file, CAST(CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN 1 ELSE 0 END AS INT) AS line, CASE WHEN event_id % 2 = 0 THEN 'RSA' ELSE 'UNKNOWN' END AS algorithm,
  CASE WHEN event_id % 3 = 0 THEN 'VERIFIED' END AS confidence_band, CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN event_type IN ('click', 'view') THEN 'HIGH' END AS risk_tier FROM events
UNION ALL SELECT event_id, 1, 'UNKNOWN', 0, 'MD5', NULL, 'high', NULL FROM events WHERE event_id % 2 = 1""")
def normalized_output(spark, d):
    e = derive.table(spark, d, "events")
    n = F.col("event_id")
    line = F.when(n % 3 == 0, F.concat(F.lit('"'), "user_id", F.lit('"'))).when(n % 3 == 1, "1.75").otherwise('"1.75"')
    band = F.when(n % 3 == 0, '"verified "').otherwise('"none"')
    tier = F.when(F.col("event_type").isin("click", "view"), '" high"').otherwise('"other"')
    one = F.concat(F.lit('{"path": null, "filePath": " f'), "user_id", F.lit('", "lineno": '), line, F.when(n % 2 == 0, ', "algo": "RSA"').otherwise(""), F.lit(', "confidenceBand": '), band, F.lit(', "confidence": "LOW", "severity": '), tier, F.lit(', "more": [1]}'))
    text = F.when(n % 2 == 0, F.concat(F.lit("["), one, F.lit(", 7]"))).otherwise(F.concat(one, F.lit('\n{"algorithm": "MD5"}\n')))
    items, _ = inventory.scanner_output(e.select(n.alias("scan_id"), text.alias("text")))
    return inventory.normalize(items).select("scan_id", "ordinal", "file", "line", "algorithm", "confidence_band", "confidence", "risk_tier")


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier), f(file, matched_call, library, package_name, package_version) AS (
SELECT 'l' || k || ':libssl3', 'deb:libssl3==3.0.' || v, 'openssl', 'libssl3', '3.0.' || v FROM s WHERE k % 2 = 0
UNION ALL SELECT 'l' || k || ':libgcrypt20-dev', 'deb:libgcrypt20-dev==unknown', 'libgcrypt', 'libgcrypt20-dev', 'unknown' FROM s WHERE k % 2 = 0
UNION ALL SELECT 'l' || k || ':libcrypto3', 'apk:libcrypto3==3.' || v, 'openssl', 'libcrypto3', '3.' || v FROM s WHERE k % 2 = 1
) SELECT *, CAST(0.65 AS DECIMAL(3, 2)) AS confidence_score FROM f""")
def layer_packages(spark, d):
    s = derive.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("string").alias("v"))
    deb = F.concat(F.lit("Package: libssl3\nStatus: install ok installed\nVersion: 3.0."), "v", F.lit("\n\nPackage: bash\nVersion: 5\n\nPackage: libgcrypt20-dev\nSection: x\n\nPackage: openssl\nStatus: deinstall ok config-files\nVersion: 1\n"))
    apk = F.concat(F.lit("C:Q1\nP:libcrypto3\nV:3."), "v", F.lit("\n\nP:musl\nV:1.2\n"))
    rows = s.select(F.concat(F.lit("l"), "k").alias("layer"), F.when(F.col("k") % 2 == 0, "deb").otherwise("apk").alias("ecosystem"), F.when(F.col("k") % 2 == 0, deb).otherwise(apk).cast("binary").alias("content"))
    return packages.package_findings(rows).select("file", "matched_call", "library", "package_name", "package_version", "confidence_score")


@query("""WITH r(role) AS (VALUES ('AUDITOR'), ('DEVELOPER'), ('SECURITY_ADMIN')), a(resource, action, roles) AS (VALUES ('scans', 'create', 'DS'), ('scans', 'read', 'ADS'), ('scans', 'delete', 'S'), ('findings', 'triage', 'DS'), ('agents', 'read', 'AS'), ('agents', 'manage', 'S'), ('scans', 'pause', ''))
SELECT n_nationkey AS who, role, resource, action, contains(roles, substr(role, 1, 1)) AS allowed FROM nation JOIN r ON role = ['AUDITOR', 'DEVELOPER', 'SECURITY_ADMIN'][n_nationkey % 3 + 1], a""")
def permission_checks(spark, d):
    role = F.element_at(F.array(*map(F.lit, ("AUDITOR", "DEVELOPER", "SECURITY_ADMIN"))), F.col("n_nationkey") % 3 + 1)
    asked = F.array(*(F.struct(F.lit(a).alias("resource"), F.lit(b).alias("action")) for a, b in (("scans", "create"), ("scans", "read"), ("scans", "delete"), ("findings", "triage"), ("agents", "read"), ("agents", "manage"), ("scans", "pause"))))
    return inventory.allowed(derive.table(spark, d, "nation").select(F.col("n_nationkey").alias("who"), role.alias("role"), F.inline(asked))).select("who", "role", "resource", "action", "allowed")
