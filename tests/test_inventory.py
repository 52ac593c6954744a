"""Intake, coercion, queries, chains and gates of the inventory."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lodestrata.operators import inventory as inv
from lodestrata.operators import packages


def test_scanner_output_and_coercion(spark):
    texts = [
        (1, '  [{"file": " a.py ", "lineno": "12", "algo": "MD5", "Severity": "high", "confidence band": " verified "}, 3, {"path": "", "file_path": "b", "line": 1.9, "keylength": "x", "confidence_signals": ["p", 2]}]\n'),
        (2, '{"file": "c", "line": true, "tier": "WORST", "criticality": "critical", "confidenceScore": "0.857", "confidence_signals": "[\\"q\\"]"}\n\nnot json\n[1]\n{"x": null}\n{"artifactType": "binary", "package_ecosystem": "NPM", "keysize": 2048}'),
        (3, ""),
    ]
    items, errors = inv.scanner_output(spark.createDataFrame(texts, "scan_id long, text string"))
    assert {tuple(r) for r in errors.collect()} == {(2, 1)}
    got = {(r.scan_id, r.ordinal): r for r in inv.normalize(items).collect()}
    assert set(got) == {(1, 0), (1, 2), (2, 0), (2, 4), (2, 5)}
    a, b, c, none, d = (got[k] for k in sorted(got))
    assert (a.file, a.line, a.algorithm, a.risk_tier, a.confidence_band, a.confidence) == ("a.py", 12, "MD5", "HIGH", "VERIFIED", "high")
    assert (b.file, b.line, b.key_size, b.confidence_signals, b.algorithm) == ("b", 1, None, ["p", "2"], "UNKNOWN")
    assert (c.risk_tier, c.criticality, c.confidence_score, c.confidence_signals) == (None, "CRITICAL", 0.86, ["q"])
    assert (none.file, none.line, none.confidence, none.artifact_type) == ("UNKNOWN", 0, "high", "SOURCE_FILE")
    assert (d.artifact_type, d.package_ecosystem, d.key_size) == ("BINARY", "npm", 2048)
    gate = spark.createDataFrame([(1, None, "high"), (2, None, "low"), (3, "PROBABLE", "low"), (4, "UNVERIFIED", "high"), (5, "", "high")], "id int, confidence_band string, confidence string")
    assert {r.id for r in inv.band_gate(gate, "nonsense").collect()} == {1, 3, 5}


def test_repositories_and_reports(spark):
    known = spark.createDataFrame([(1, "a", None, None, None), (2, "b", "http://x", "o", "e"), (3, "a", None, "o", None), (4, "c", "http://x", None, None)], "repo_id int, name string, url string, organization_id string, external_id string")
    incoming = spark.createDataFrame([("zz", None, "o", "e"), ("a", None, None, None), ("q", "http://x", None, None), ("q", "http://y", "o", None), ("n", None, "o", "")], "name string, url string, organization_id string, external_id string")
    assert [r.repo_id for r in inv.resolve_repositories(incoming, known).orderBy("name", F.desc("url")).collect()] == [1, None, None, 2, 2]
    finding = "array<struct<file:string,line:int,algorithm:string,key_size:int,supplied_shelf_life:double,risk_tier:string>>"
    bundles = spark.createDataFrame([("r1", 1, [("a.py", 1, "RSA", None, 20.0, "LOW")]), ("r1", 2, []), ("r2", 1, [("b.py", 1, "MD5", None, None, "LOW")])], f"report_id string, created_at int, findings {finding}")
    new, scored = inv.ingest(bundles, spark.createDataFrame([("r2",)], "report_id string"))
    assert [tuple(r) for r in new.collect()] == [("r1", 1)]
    assert [(r.risk_tier, r.hndl_exposure) for r in scored.collect()] == [("HIGH", "HIGH")]


def test_audit_chain(spark):
    one = {"action": "lodestrata.read", "actor_ref": "a", "actor_type": "user", "client_ip": None, "detail": json.dumps({"b": 1, "a": "\u00e9"}), "object_id": "17", "object_type": "bom", "occurred_at": "2026-09-21T10:15:30.123456", "outcome": "allowed"}
    text = '{"action":"lodestrata.read","actor_ref":"a","actor_type":"user","client_ip":null,"detail":{"a":"\\u00e9","b":1},"object_id":"17","object_type":"bom","occurred_at":"2026-09-21T10:15:30.123456","organization_id":"o","outcome":"allowed","prev_hash":null}'
    import hashlib

    assert inv.entry_hash({**one, "organization_id": "o", "prev_hash": None}) == hashlib.sha256(text.encode()).hexdigest()
    rows, last = [], {}
    for k in range(40):
        org = ("o", "p")[k % 2]
        e = {"id": k, **one, "organization_id": org, "object_id": str(k), "prev_hash": last.get(org)}
        e["entry_hash"] = last[org] = inv.entry_hash(e)
        rows.append(e)
    rows[11]["outcome"] = "denied"  # changed afterwards
    rows.pop(25)  # taken out: the next one of p no longer follows
    schema = "id long, action string, actor_ref string, actor_type string, client_ip string, detail string, object_id string, object_type string, occurred_at string, organization_id string, outcome string, prev_hash string, entry_hash string"
    df = spark.createDataFrame([tuple(r[x.split()[0]] for x in schema.split(", ")) for r in rows], schema)
    assert {tuple(r) for r in inv.verify_chain(df).collect()} == {("o", True, 20, None, 0), ("p", False, 19, 11, 2)}
    assert [r.id for r in inv.audit_events(df, outcome="denied").collect()] == [11]
    assert [r.id for r in inv.audit_events(df, organization_id="o", after_id=35).collect()] == [36, 38]


def test_agents_triage_and_permissions(spark):
    day = lambda k: dt.datetime(2026, 1, k)
    agents = spark.createDataFrame([("a",), ("b",), ("c",)], "agent_id string")
    reports = spark.createDataFrame([("r1", "a", day(1)), ("r2", "a", day(9)), ("r3", "b", day(2))], "report_id string, agent_id string, created_at timestamp")
    got = {r.agent_id: (r.report_count, r.last_report_id, r.delivery_status) for r in inv.agent_status(agents, reports, F.lit(day(10)), 24).collect()}
    assert got == {"a": (2, "r2", "recent"), "b": (1, "r3", "stale"), "c": (0, None, "never_reported")}
    found = spark.createDataFrame([(1, "f"), (2, "g")], "id int, fingerprint string")
    triage = spark.createDataFrame([("f", 1, day(1), "open"), ("f", 2, day(3), "closed")], "fingerprint string, triage_id int, updated_at timestamp, status string")
    assert {(r.id, r.triage_status) for r in inv.carried_triage(found, triage).collect()} == {(1, "closed"), (2, None)}
    asked = spark.createDataFrame([("AUDITOR", "scans", "read"), ("AUDITOR", "scans", "create"), ("SECURITY_ADMIN", "no", "read")], "role string, resource string, action string")
    assert {(r.resource, r.action, r.allowed) for r in inv.allowed(asked).collect()} == {("scans", "read", True), ("scans", "create", False), ("no", "read", False)}


def test_scans_and_sinks(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, 0, "pending"), (1, 2, 0, "running"), (1, 2, 1, "failed"), (2, 5, 0, "odd")], "scan_id int, at int, ordinal int, status string")
    assert {tuple(r) for r in inv.current_scans(events).collect()} == {(1, "failed", 2), (2, "running", 5)}
    scans = spark.createDataFrame([(1, 7, 3), (2, 7, 3), (3, 8, 9), (4, 7, None)], "scan_id int, repo_id int, started_at int")
    assert [r.scan_id for r in inv.list_scans(scans, 7, 2).collect()] == [2, 1] and [r.scan_id for r in inv.list_scans(scans).collect()] == [3, 2, 1, 4]
    findings = spark.createDataFrame([(1, 1, 'a,"b".py', 3, "MD5", "CRITICAL", False, dt.datetime(2026, 1, 2)), (2, 3, "c.py", 1, "RSA", None, True, dt.datetime(2026, 1, 2))], "id int, scan_id int, file string, line int, algorithm string, risk_tier string, quantum_vulnerable boolean, found_at timestamp")
    left = inv.without_repositories(spark.createDataFrame([(7,)], "repo_id int"), scans.select("repo_id").distinct(), scans, findings)
    assert [x.count() for x in left] == [1, 1, 1]
    inv.write_findings(findings, f"file://{tmp_path}/csv", "csv")
    assert {tuple(r) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/csv").select("File", "`Risk Tier`", "Quantum", "Date").collect()} == {('a,"b".py', "CRITICAL", "No", "2026-01-02"), ("c.py", None, "Yes", "2026-01-02")}
    inv.write_findings(findings, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2
    assert [tuple(r)[1:] for r in inv.risk_distribution(findings.withColumn("k", F.lit(1)), "k").collect()] == [(1, 1, 0, 0, 0, 0)]
    text = inv.remediation_text(findings).where("id = 1").first().prompt
    assert text.startswith("In 'a,\"b\".py', line 3 uses MD5.") and "SHA-256 or BLAKE2" in text


def test_installed_packages(spark):
    deb = "Package: libssl3\nStatus: install ok installed\nVersion: 3.0.11-1\nDescription: x\n Package: not\n\nPackage: libssl3-dev\nStatus: deinstall ok config-files\n\nPackage: openssl\n\nPackage: libgcrypt20_x\nStatus: install ok not-installed\nVersion: 1\n"
    apk = "C:Q1\nP:libcrypto3\nV:3.0.8-r0\nA:x86_64\n\nP:musl\nV:1\n\nP:libssl3-extra\n"
    rpm = b"\x00\x01openssl-libs-3.0.7-16.el9\x00junk-1\xffnss-3.79.0\x00bash-5.1"
    rows = [("l1", "deb", bytearray(deb.encode())), ("l2", "apk", bytearray(apk.encode())), ("l3", "rpm", bytearray(rpm))]
    got = {(r.package_ecosystem, r.package_name, r.package_version, r.library) for r in packages.package_findings(spark.createDataFrame(rows, "layer string, ecosystem string, content binary")).collect()}
    assert got == {("deb", "libssl3", "3.0.11-1", "openssl"), ("deb", "openssl", "unknown", "openssl"), ("deb", "libgcrypt20_x", "1", "libgcrypt"), ("apk", "libcrypto3", "3.0.8-r0", "openssl"), ("apk", "libssl3-extra", "unknown", "openssl"), ("rpm", "openssl-libs", "3.0.7-16.el9", "openssl")}
    paths = spark.createDataFrame([("etc/a",), ("runtime/x",), ("usr/share/doc/y",), ("a/proc/b",), ("usr/lib/z",)], "path string")
    assert {r.path for r in paths.where(packages.kept_path()).collect()} == {"etc/a", "usr/lib/z"}


def test_reports_in_words(spark):
    scans = spark.createDataFrame([(1, "running"), (2, "completed")], "scan_id int, status string")
    found = spark.createDataFrame([("CRITICAL", True), ("HIGH", False), (None, None)], "risk_tier string, quantum_vulnerable boolean")
    lines = [r.line for r in inv.report_lines(scans, found).orderBy("place").collect()]
    assert lines[:3] == ["3 findings in all, 1 scans are running.", "1 are critical; 1 rest on algorithms that quantum computers break.", "CRITICAL: 1 findings, 33.3% of all"] and len(lines) == 7
    assert [r.line for r in inv.report_lines(scans, found.where("false")).collect()][2] == "CRITICAL: 0 findings, 0.0% of all"
    repositories = spark.createDataFrame([(1, "o"), (2, "p"), (3, None)], "repo_id int, organization_id string")
    assert [r.repo_id for r in inv.of_organization(repositories.select("repo_id"), repositories, "o").collect()] == [1]
