"""Bundles: digests, the order of checks, files and streams of them."""

import io
import json

from lodestrata import cli
from lodestrata.operators import bundles, inventory
from tests.test_scan import MIXED, tree


def signed(**changes):
    own = bundles.build("org", "repo", "agent", [{"file": "a.py", "line": 1, "algorithm": "RSA", "data_shelf_life_years": 20.0}, {"file": "é.py", "line": 2, "algorithm": "MD5"}], {"total": 2}, {"b": 1, "a": "é "}, report_id="r1")
    return own | {"signature": "c2ln", "signature_algorithm": "Ed25519"} | changes


def test_canonical_json():
    assert bundles.canonical({"b": [1, 2.50, True, None], "a": {"z": "é", "A": "\n"}}) == '{"a":{"A":"\\n","z":"é"},"b":[1,2.5,true,null]}'.encode()
    own = signed()
    assert own["bundle_digest"] == bundles.digest({k: own[k] for k in reversed(own)}) != bundles.digest(own | {"summary": {"total": 3}})


def test_bundles_are_refused_by_reason(spark, tmp_path):
    files = {
        "a-good": signed(), "b-tampered": signed(summary={"total": 3}), "c-algorithm": signed(signature_algorithm="RSA", bundle_digest="x"), "d-unsigned": signed(signature=None, bundle_digest="x"),
        "e-list": [1], "f-no-id": None, "g-copy": signed(scan_context={}),
    }
    no_id = {k: v for k, v in signed().items() if k != "report_id"}
    files["f-no-id"] = no_id | {"bundle_digest": bundles.digest(no_id)}
    files["g-copy"] |= {"bundle_digest": bundles.digest(files["g-copy"])}
    for name, value in files.items():
        (tmp_path / name).write_text(json.dumps(value, indent=1))
    (tmp_path / "h-large").write_text(json.dumps(signed(extra="x" * (1 << 20))))
    (tmp_path / "i-broken").write_text("{")
    got = bundles.read(spark, str(tmp_path))
    reasons = {r.source.rsplit("/", 1)[1][0]: r.reason for r in got.collect()}
    assert reasons == {"a": None, "b": "digest", "c": "algorithm", "d": "no digest or signature", "e": "no JSON object", "f": "no report id", "g": None, "h": "too large", "i": "no JSON object"}
    reports = bundles.reports(got)
    assert reports.count() == 1
    new, scored = inventory.ingest(reports, spark.createDataFrame([], "report_id string"))
    assert {(r.algorithm, r.hndl_exposure) for r in scored.collect() if r.algorithm == "RSA"} == {("RSA", "HIGH")}
    assert inventory.ingest(reports, new.select("report_id"))[1].count() == 0
    stream = bundles.read_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert {(r.source.rsplit("/", 1)[1][0], r.reason) for r in spark.table("arrived").collect()} == set(reasons.items())


def run(spark, *args):
    out, err = io.StringIO(), io.StringIO()
    return cli.run(spark, cli.parser().parse_args(list(map(str, args))), out, err), out.getvalue(), err.getvalue()


def test_command_line(spark, tmp_path):
    root = tree(tmp_path / "tree", MIXED | {"broken.py": "def (", "bad.json": "{", "pom.xml": "<!DOCTYPE x><project/>"})
    code, out, err = run(spark, root, "--fail-on", "CRITICAL", "--redact-paths")
    assert code == 2 and [(f["finding_id"], f["algorithm"]) for f in json.loads(out)] == [(0, "MD5"), (1, "SHA-256"), (2, "3DES")] and not err
    code, out, _ = run(spark, root, "--fail-on", "CRITICAL", "--summary-only", "--min-confidence", "VERIFIED", "--json-out", tmp_path / "f.json")
    assert code == 2 and json.loads(out)["policy"] == "CRITICAL" and len(json.loads((tmp_path / "f.json").read_text())) == json.loads(out)["summary"]["total"]
    code, out, err = run(spark, root, "--scan-type", "source", "--scan-type", "config", "--scan-type", "dependency", "--problems", "--out", tmp_path / "out")
    assert code == 0 and json.loads(out)["summary"]["total"] == 5
    assert [x.split(": ")[:2] for x in err.splitlines()] == [["[warn] config", "bad.json"], ["[warn] dependency", "pom.xml"], ["[warn] source", "broken.py"]]
    assert run(spark, tmp_path / "absent")[0] == 1 and run(spark, root, "--data-shelf-life-years", -1)[0] == 1
    assert run(spark, root, "--report-bundle", tmp_path / "b.json")[0] == 1
    code, out, _ = run(spark, root, "--report-bundle", tmp_path / "b.json", "--organization-id", "o", "--repository-id", "r", "--agent-id", "a")
    bundle = json.loads((tmp_path / "b.json").read_text())
    assert code == 0 and bundle["bundle_digest"] == bundles.digest(bundle) == json.loads(out)["report_bundle"]["digest"] and len(bundle["findings"]) == 3
