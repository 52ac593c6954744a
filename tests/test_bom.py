"""Bills of materials: what is built is valid, and each kind of damage is named."""

import copy
import json

import pytest

from lodestrata.functions import risk
from lodestrata.operators import bom

SCHEMA = "scan_id long, id long, file string, line int, algorithm string, key_size int, confidence string, confidence_band string, supplied_shelf_life double"
ROWS = [(1, 1, "a.py", 3, "MD5", None, "high", "VERIFIED", None), (1, 2, "b.java", 0, "RSA", 1024, "high", "PROBABLE", 20.0), (1, 3, "c.js", 9, "3DES", 0, None, None, None), (1, 4, "tests/d.py", 1, "ECC", None, "unverified", "UNVERIFIED", None), (2, 5, "e.py", 1, "nosuch", None, None, None, None)]


@pytest.fixture(scope="module")
def built(spark):
    scored = risk.score_findings(spark.createDataFrame(ROWS, SCHEMA), "a test")
    scans = spark.createDataFrame([(1, "2026-01-02 03:04:05", "completed"), (2, "2026-01-02 03:04:05", "running"), (3, "2026-01-02 03:04:05", "completed")], "scan_id long, started_at string, status string")
    return {r.scan: json.loads(r.document) for r in bom.documents(scored, scans).collect()}


def test_documents(built):
    assert set(built) == {1, 3} and built[3]["components"] == [] and built[3]["x-risk-summary"]["total"] == 0
    doc = built[1]
    assert doc["x-risk-summary"] == {"total": 4, "CRITICAL": 2, "HIGH": 2, "MEDIUM": 0, "LOW": 0, "UNSCORED": 0}
    md5, rsa, des, ecc = doc["components"]
    assert (rsa["bom-ref"], rsa["version"], rsa["cryptoProperties"]["algorithmProperties"]["keySize"], rsa["description"]) == ("finding-2", "RSA-1024", 1024, "RSA detected at b.java:0 (confidence=high)")
    assert des["version"] == "3DES" and "keySize" not in des["cryptoProperties"]["algorithmProperties"] and md5["cryptoProperties"]["algorithmProperties"]["primitive"] == "hash"
    named = lambda c: {p["name"].split(":")[1]: p["value"] for p in c["properties"]}
    assert named(ecc)["source_context"] == "TEST_ONLY" and named(rsa)["classical_broken"] == "true" and named(rsa)["assumption_source"] == "a test" and "recommended_replacement" in named(md5)


def put(path, value):
    def change(doc):
        at = doc
        for k in path[:-1]:
            at = at[k]
        if value is None:
            del at[path[-1]]
        else:
            at[path[-1]] = value

    return change


DAMAGE = {
    "fine": (lambda d: None, []),
    "format": (put(["bomFormat"], "Other"), [("FIELD_INVALID_VALUE", "/bomFormat")]),
    "no version": (put(["specVersion"], None), [("FIELD_MISSING", "/specVersion")]),
    "serial": (put(["serialNumber"], "urn:uuid:ABC"), [("FIELD_INVALID_VALUE", "/serialNumber")]),
    "number": (put(["version"], "1"), [("FIELD_WRONG_TYPE", "/version")]),
    "time": (put(["metadata", "timestamp"], "yesterday"), [("FIELD_INVALID_VALUE", "/metadata/timestamp")]),
    "components": (put(["components"], {}), [("FIELD_WRONG_TYPE", "/components")]),
    "type": (put(["components", 1, "type"], "library"), [("FIELD_INVALID_VALUE", "/components/1/type")]),
    "empty name": (put(["components", 0, "name"], ""), [("FIELD_INVALID_VALUE", "/components/0/name")]),
    "no places": (put(["components", 0, "evidence", "occurrences"], []), [("FIELD_INVALID_VALUE", "/components/0/evidence/occurrences")]),
    "line": (put(["components", 2, "evidence", "occurrences", 0, "line"], -1), [("FIELD_INVALID_VALUE", "/components/2/evidence/occurrences/0/line")]),
    "value": (put(["components", 2, "properties", 0, "value"], 3), [("FIELD_WRONG_TYPE", "/components/2/properties/0/value")]),
    "no properties of the algorithm": (put(["components", 0, "cryptoProperties", "algorithmProperties"], None), [("FIELD_INVALID_VALUE", "/components/0/cryptoProperties")]),
    "ref": (put(["components", 2, "bom-ref"], "finding-1"), [("BOM_REF_DUPLICATE", "/components/2/bom-ref")]),
    "total": (put(["x-risk-summary", "total"], 5), [("SUMMARY_TOTAL_MISMATCH", "/x-risk-summary/total")]),
    "tier": (put(["x-risk-summary", "LOW"], 1), [("SUMMARY_TIER_MISMATCH", "/x-risk-summary/LOW")]),
    "no tier": (put(["components", 0, "properties", 0, "name"], "other"), [("RISK_TIER_PROPERTY_MISSING", "/components/0/properties"), ("SUMMARY_TIER_MISMATCH", "/x-risk-summary/CRITICAL")]),
    "bad tier": (put(["components", 0, "properties", 0, "value"], "WORST"), [("RISK_TIER_PROPERTY_INVALID", "/components/0/properties"), ("SUMMARY_TIER_MISMATCH", "/x-risk-summary/CRITICAL")]),
    "criticality": (put(["components", 0, "properties", 1, "value"], "NONE"), [("CRITICALITY_PROPERTY_INVALID", "/components/0/properties")]),
    "no summary": (put(["x-risk-summary"], None), []),
}


def test_issues(spark, built):
    texts = {}
    for name, (change, _) in DAMAGE.items():
        doc = copy.deepcopy(built[1])
        change(doc)
        texts[name] = json.dumps(doc)
    texts |= {"no json": "{", "no object": "[1]", "no number": texts["fine"].replace('"version": 1,', '"version": NaN,', 1), "empty": json.dumps(built[3])}
    rows = bom.issues(spark.createDataFrame(list(texts.items()), "doc string, text string")).collect()
    got = {name: sorted((r.code, r.path) for r in rows if r.doc == name) for name in texts}
    want = {name: sorted(x) for name, (_, x) in DAMAGE.items()} | {"no json": [("NOT_JSON_SERIALIZABLE", "")], "no object": [("DOCUMENT_NOT_OBJECT", "")], "no number": [("NOT_JSON_SERIALIZABLE", "")], "empty": []}
    assert got == want


def test_provenance(spark):
    scored = risk.score_findings(spark.createDataFrame(ROWS, SCHEMA))
    scans = spark.createDataFrame([(1, "2026-01-02 03:04:05", "completed", "r1"), (2, "2026-01-02 03:04:05", "completed", None)], "scan_id long, started_at string, status string, report_id string")
    reports = spark.createDataFrame([("r1", "a", "o", "sha256:0")] * 2, "report_id string, agent_id string, organization_id string, bundle_digest string")
    got = {r.scan: json.loads(r.document)[bom.PROVENANCE] for r in bom.documents(scored, scans, reports=reports).collect()}
    assert got == {1: {"origin": "offline-agent-signed-bundle", "report_id": "r1", "agent_id": "a", "organization_id": "o", "bundle_digest": "sha256:0"}, 2: {"origin": "local-api", "integrity": "not-signed-bundle"}}


FINDING = {"file": "a.py", "line": 3, "library": "hashlib", "algorithm": "MD5", "confidence": "high", "risk_tier": "CRITICAL", "risk_reason": "r", "primitive": "hash", "classical_broken": True}


def test_documents_of_files(spark, tmp_path):
    from lodestrata.operators import offline

    def made(findings, summary, as_lines=False):
        text = "\n".join(map(json.dumps, findings)) if as_lines else json.dumps(findings, indent=1)
        (tmp_path / "f.json").write_text(text)
        (tmp_path / "s.json").write_text(json.dumps(summary))
        return offline.document(spark, str(tmp_path / "f.json"), str(tmp_path / "s.json"), "2026-01-02 03:04:05", "org")

    other = FINDING | {"risk_tier": None, "algorithm": "odd", "id": 77}
    summary = {"total": 2, "CRITICAL": 1, "HIGH": 0, "MEDIUM": 0, "LOW": 0, "UNSCORED": 1}
    for as_lines in (False, True):
        text = made([FINDING, other], summary, as_lines)
        doc = json.loads(text)
        assert {c["bom-ref"] for c in doc["components"]} == {"finding-1", "finding-77"} and doc["x-risk-summary"] == summary and doc["metadata"]["properties"][0]["value"] == "org"
        assert bom.issues(spark.createDataFrame([(1, text)], "doc int, text string")).count() == 0
    lacking = {k: v for k, v in FINDING.items() if k not in ("library", "risk_reason")}
    for rows, problem in (([FINDING, lacking], "index 1: missing required field: library"), ([3], "index 0: must be an object"), ([FINDING | {"line": -1}], "invalid line"), ([FINDING | {"line": 1.5}], "invalid line"), ([FINDING | {"file": None}], "invalid file"), ([FINDING | {"risk_tier": "WORST"}], "invalid risk_tier"), ([FINDING | {"risk_tier": 3}], "invalid risk_tier")):
        with pytest.raises(ValueError, match=problem):
            made(rows, summary)
    for off, problem in (({"total": 3}, "total doesn't match"), ({"HIGH": 1}, "HIGH doesn't match"), ({"LOW": None}, "LOW is no count"), ({"LOW": "0"}, "LOW is no count")):
        with pytest.raises(ValueError, match=problem):
            made([FINDING, other], summary | off)
    with pytest.raises(ValueError, match="must be an object"):
        made([FINDING], [])
    with pytest.raises(ValueError, match="summary has no LOW"):
        made([FINDING, other], {k: v for k, v in summary.items() if k != "LOW"})


def test_issues_come_in_order(spark, built):
    doc = copy.deepcopy(built[1])
    doc["bomFormat"], doc["version"], doc["components"][1]["name"], doc["components"][0]["name"] = "x", 0, "", ""
    got = [(r.path, r.code) for r in bom.issues(spark.createDataFrame([(1, json.dumps(doc))], "doc int, text string")).collect()]
    assert got == sorted(got) and len(got) == 4
