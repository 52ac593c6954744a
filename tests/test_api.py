"""The inventory from a scan to its bill of materials, and the SQL functions."""

import datetime as dt
import json

import pytest

from lodestrata.api import REPOSITORIES, Inventory
from lodestrata.functions import sql
from tests.test_scan import MIXED, tree


def test_inventory(spark, tmp_path):
    inv = Inventory(spark, f"file://{tmp_path}/tables")
    root = tree(tmp_path / "tree", MIXED)
    repo = inv.repository("own", url="http://x")
    assert inv.repository("other", url="http://x") == repo == 1 and inv.repository("third") == 2
    first = inv.run_scan(root, repo)
    second = inv.run_scan(root, repo, types=("source", "dependency", "config"), min_band="UNVERIFIED", shelf_life=20.0)
    assert [r.scan_id for r in inv.list_scans(repo).collect()] == [second, first] and {r.status for r in inv.scans().collect()} == {"completed"}
    state, found, summary = inv.scan_detail(first)
    assert state.count() == 1 and summary.first().total == 3 and all(r.risk_assessment.risk_model_version for r in found.collect())
    page, total, summary = inv.query_findings(second, sort_by="algorithm", limit=2, languages=["python", "java"])
    assert [r.algorithm for r in page.collect()] == ["3DES", "MD5"] and total.first()[0] == 3 and summary.first().total == 5
    one = page.first()
    assert inv.get_finding(second, one.id).file == one.file and "names this fix" in inv.remediate(second, one.id).prompt
    with pytest.raises(LookupError):
        inv.get_finding(first, one.id)
    doc = json.loads(inv.export_bom(second))
    assert doc["x-risk-summary"]["total"] == len(doc["components"]) == 5
    with pytest.raises(LookupError):
        inv.export_bom(99)
    with pytest.raises(Exception):  # noqa: B017  no such folder
        inv.run_scan(str(tmp_path / "absent"), repo)
    assert inv.list_scans(repo, 1).first().status == "failed"
    with pytest.raises(ValueError, match="failed"):
        inv.export_bom(inv.list_scans(repo, 1).first().scan_id)

    bundles = spark.createDataFrame([("r1", dt.datetime(2026, 1, 1), [("a.py", 1, "MD5", None, None)])], "report_id string, created_at timestamp, findings array<struct<file:string,line:int,algorithm:string,key_size:int,supplied_shelf_life:double>>")
    inv.ingest_bundles(bundles)
    inv.ingest_bundles(bundles)
    assert inv.table("reports").count() == inv.table("report_findings").count() == 1


def test_sql_functions(spark):
    sql.register(spark)
    got = spark.sql("SELECT confidence_band(0.85) a, confidence_band(0.599) b, tier_rank('LOW') c, tier_rank(NULL) d, file_criticality('src/author.py') e, file_criticality(NULL) f, package_key('A_.b', 'pypi') g, package_key('A_.b', 'npm') h, exact_version('1.0.0-beta.1') i, exact_version('1.x') j, exact_version('^2') k, exact_version(NULL) l").first()
    assert tuple(got) == ("VERIFIED", "UNVERIFIED", 3, 4, "CRITICAL", "MEDIUM", "a-b", "a_.b", True, False, False, False)


def test_writes_are_whole_or_nothing(spark, tmp_path, monkeypatch):
    """A scan that breaks off between findings and assessments leaves nothing that is read, and its findings are computed once."""
    from pyspark.sql import DataFrameWriter

    from lodestrata.operators import inventory, scan

    inv = Inventory(spark, f"file://{tmp_path}/tables")
    root = tree(tmp_path / "tree", MIXED)
    repo = inv.repository("own")
    parquet = DataFrameWriter.parquet
    computed = []
    persist, prepare = inventory.persist, scan.prepare
    monkeypatch.setattr(scan, "prepare", lambda *a, **k: (computed.append(1), prepare(*a, **k))[1])

    def broken(self, path, *args, **kwargs):
        if path.endswith("/assessments"):
            raise OSError("the store is gone")
        return parquet(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        inv.run_scan(root, repo)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    assert spark.read.parquet(f"file://{tmp_path}/tables/findings").count() == 3 and inv.table("findings").count() == 0
    scan_id = inv.run_scan(root, repo)
    assert inv.table("findings").count() == inv.table("assessments").count() == 3 and len(computed) == 2
    assert {r.status for r in inv.scans().collect()} == {"failed", "completed"}
    again = inv.table("findings").join(inv.table("assessments").drop("scan_id").withColumnRenamed("finding_id", "id"), "id")
    assert not persist(again, inv.committed, f"scan-{scan_id}") and inv.table("findings").count() == 3


def test_intake_of_files_and_streams(spark, tmp_path):
    from tests.test_bundles import signed

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(signed()))
    (folder / "b.json").write_text(json.dumps(signed(summary={})))
    inv = Inventory(spark, f"file://{tmp_path}/tables")
    assert [(r.report_id, r.reason) for r in inv.ingest_folder(str(folder)).collect()] == [("r1", "digest")]
    assert inv.table("reports").count() == 1 and inv.table("report_findings").count() == 2
    for _ in range(2):
        query = inv.ingest_stream(str(folder), f"{tmp_path}/check").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    assert inv.table("reports").count() == 1
    from lodestrata.operators import bundles

    own = signed(report_id="r2")
    (folder / "c.json").write_text(json.dumps(own | {"bundle_digest": bundles.digest(own)}))
    query = inv.ingest_stream(str(folder), f"{tmp_path}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert sorted(r.report_id for r in inv.table("reports").collect()) == ["r1", "r2"] and inv.table("report_findings").count() == 4
    # a report is a scan of its repository, which is found again by the organization and its own id there
    repositories, scans = inv.table("repositories", REPOSITORIES).collect(), inv.list_scans().collect()
    assert [(r.name, r.organization_id, r.external_id) for r in repositories] == [("repo", "org", "repo")] and {s.repo_id for s in scans} == {repositories[0].repo_id} and [s.status for s in scans] == ["completed"] * 2
    _, found, summary = inv.scan_detail(scans[0].scan_id)
    assert {(r.file, r.algorithm, r.risk_assessment.hndl_exposure) for r in found.collect()} == {("a.py", "RSA", "HIGH"), ("é.py", "MD5", "NOT_APPLICABLE")} and summary.first().total == 2
    doc = json.loads(inv.export_bom(scans[0].scan_id))
    assert doc["x-report-provenance"]["origin"] == "offline-agent-signed-bundle" and doc["x-report-provenance"]["report_id"] in ("r1", "r2") and len(doc["components"]) == 2
    scan_id = inv.run_scan(tree(tmp_path / "tree", MIXED), inv.repository("own"))
    assert json.loads(inv.export_bom(scan_id))["x-report-provenance"]["origin"] == "local-api" and inv.list_scans().count() == 3
    reports = bundles.reports(bundles.read(spark, str(folder)))
    assert inv.ingest_bundles(reports, "batch-1") == 0 and inv.table("reports").count() == 2
